"""Visual facts of slides: density, fonts, colours, rotation, hierarchy and peers of their objects, one fact a row.

Objects: deck_id, slide_number, object_id, parent_id, type, text, x, y, w, h,
rotation DOUBLE (null if unknown), font_sizes ARRAY<DOUBLE> (of the text's runs),
font_family STRING, colors ARRAY<STRUCT<role, color>>. Objects that don't count
as content should be left out before. Slides are keyed by (deck_id,
slide_number); slides without objects have no facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import geometry
from .evidence import valid_box

KEY = ["deck_id", "slide_number"]


def _placed(objects: DataFrame) -> DataFrame:
    return objects.where(valid_box())


def _union(objects: DataFrame, name: str) -> DataFrame:
    """(KEY, name): union area of the boxes on each slide."""
    u = geometry.union_area(objects.where("w > 0 and h > 0").withColumn("slide", F.struct(*KEY)))
    return u.select("slide.*", F.col("union_area").alias(name))


def visible_chars(text: Column) -> Column:
    """Characters of a text other than white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def text_density(objects: DataFrame) -> DataFrame:
    """(KEY, n_texts, n_chars, n_words, text_area, chars_per_area) of each slide's objects with text; the last is null without area."""
    has = F.coalesce("text", F.lit("")) != ""
    o = _placed(objects)
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    g = o.groupBy(*KEY).agg(F.count_if(has).alias("n_texts"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"), F.sum(words).alias("n_words"))
    d = g.join(_union(o.where(has), "__a"), KEY, "left").withColumn("text_area", F.coalesce("__a", F.lit(0.0)))
    return d.select(*KEY, "n_texts", "n_chars", "n_words", "text_area", F.round(F.try_divide(F.col("n_chars"), F.col("text_area")), 6).alias("chars_per_area"))


def shape_density(objects: DataFrame) -> DataFrame:
    """(KEY, n_shapes, types MAP<type, count>, n_other_than_text, area_sum, union_area, shapes_per_area) of each slide."""
    o = _placed(objects).withColumn("type", F.coalesce("type", F.lit("unknown")))
    n = o.groupBy(*KEY, "type").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("h")).alias("a"))
    g = n.groupBy(*KEY).agg(F.sum("n").alias("n_shapes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.sum(F.when(F.col("type") != "text", F.col("n")).otherwise(0)).alias("n_other_than_text"), F.round(F.sum("a"), 6).alias("area_sum"))
    d = g.join(_union(o, "__a"), KEY, "left").withColumn("union_area", F.coalesce("__a", F.lit(0.0)))
    return d.select(*KEY, "n_shapes", "types", "n_other_than_text", "area_sum", "union_area", F.round(F.try_divide(F.col("n_shapes"), F.col("union_area")), 6).alias("shapes_per_area"))


def font_observations(objects: DataFrame) -> DataFrame:
    """(KEY, size, weight): the sizes of each text's runs; a text's visible characters are shared by its runs."""
    o = _placed(objects).withColumns({"__s": F.filter("font_sizes", lambda s: s > 0), "__c": visible_chars(F.col("text"))}).where((F.size("__s") > 0) & (F.col("__c") > 0))
    return o.select(*KEY, F.explode("__s").alias("size"), (F.col("__c") / F.size("__s")).alias("weight"))


def font_distribution(objects: DataFrame) -> DataFrame:
    """(KEY, n_sizes, minimum, maximum, mean, median, n_chars, weighted_mean, weighted_median, dominant, dominant_share, weighted_variance).

    Weights are visible characters; the dominant size has most of them, of equal
    ones the lesser; the weighted median is the first size at which half of the
    characters are reached.
    """
    per = font_observations(objects).groupBy(*KEY, "size").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    run, all_ = Window.partitionBy(*KEY).orderBy("size"), Window.partitionBy(*KEY)
    d = per.withColumns({"run": F.sum("weight").over(run), "total": F.sum("weight").over(all_), "mean": F.sum(F.col("weight") * F.col("size")).over(all_) / F.sum("weight").over(all_)})
    lists = F.flatten(F.collect_list(F.array_repeat("size", F.col("n").cast("int"))))
    r = lambda c, name: F.round(c, 6).alias(name)
    top = F.min(F.struct((-F.col("weight")).alias("k"), "size"))
    g = d.groupBy(*KEY).agg(
        F.sum("n").alias("n_sizes"), F.min("size").alias("minimum"), F.max("size").alias("maximum"), r(F.sum(F.col("n") * F.col("size")) / F.sum("n"), "mean"), F.array_sort(lists).alias("__all"), F.sum("weight").alias("__w"),
        r(F.max("mean"), "weighted_mean"), F.min(F.when(F.col("run") >= F.col("total") / 2, F.col("size"))).alias("weighted_median"), top.alias("__top"), r(F.sum(F.col("weight") * (F.col("size") - F.col("mean")) ** 2) / F.sum("weight"), "weighted_variance"),
    )
    half = (F.size("__all") - 1) / 2
    median = (F.get("__all", F.floor(half).cast("int")) + F.get("__all", F.ceil(half).cast("int"))) / 2
    return g.select(*KEY, "n_sizes", "minimum", "maximum", "mean", r(median, "median"), r(F.col("__w"), "n_chars"), "weighted_mean", "weighted_median", F.col("__top.size").alias("dominant"), r(-F.col("__top.k") / F.col("__w"), "dominant_share"), "weighted_variance")


def font_families(objects: DataFrame) -> DataFrame:
    """(KEY, n_families, dominant, counts MAP<family, characters>) of each slide's texts; a text counts at least once, equal families go to the first by name."""
    o = _placed(objects).where(F.col("font_family").isNotNull() & (F.coalesce("text", F.lit("")) != ""))
    n = o.groupBy(*KEY, "font_family").agg(F.sum(F.greatest(F.lit(1), F.length("text"))).alias("n"))
    g = n.groupBy(*KEY).agg(F.count("*").alias("n_families"), F.min(F.struct((-F.col("n")).alias("k"), "font_family")).alias("m"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("font_family", "n")))).alias("counts"))
    return g.select(*KEY, "n_families", F.col("m.font_family").alias("dominant"), "counts")


def color_consistency(objects: DataFrame) -> DataFrame:
    """(KEY, n_colors, n_samples, dominant, dominant_share, palette ARRAY<STRUCT<color, n, roles MAP>>), most frequent colour first, equal ones by name."""
    o = _placed(objects).select(*KEY, F.explode("colors").alias("c")).select(*KEY, "c.role", F.upper("c.color").alias("color")).where("color is not null")
    by_role = o.groupBy(*KEY, "color", "role").agg(F.count("*").alias("n"))
    per = by_role.groupBy(*KEY, "color").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"))
    # maps have no order, so the palette is sorted by its two other fields
    entry = F.struct((-F.col("n")).alias("k"), "color")
    g = per.groupBy(*KEY).agg(F.count("*").alias("n_colors"), F.sum("n").alias("n_samples"), F.array_sort(F.collect_list(entry)).alias("order"), F.map_from_entries(F.collect_list(F.struct("color", "roles"))).alias("roles"))
    palette = F.transform("order", lambda e: F.struct(e["color"].alias("color"), (-e["k"]).alias("n"), F.element_at("roles", e["color"]).alias("roles")))
    return g.select(*KEY, "n_colors", "n_samples", F.col("order")[0]["color"].alias("dominant"), F.round(-F.col("order")[0]["k"] / F.col("n_samples"), 6).alias("dominant_share"), palette.alias("palette"))


def rotations(objects: DataFrame) -> DataFrame:
    """(KEY, n_known, n_rotated, rotated ARRAY<STRUCT<object_id, rotation>>) of each slide; an unknown rotation doesn't count."""
    o = _placed(objects).where(F.col("rotation").isNotNull() & ~F.isnan("rotation"))
    turned = F.when(F.round("rotation", 6) != 0, F.struct("object_id", F.round("rotation", 6).alias("rotation")))
    return o.groupBy(*KEY).agg(F.count("*").alias("n_known"), F.count(turned).alias("n_rotated"), F.array_sort(F.collect_list(turned)).alias("rotated"))


def hierarchy(objects: DataFrame) -> DataFrame:
    """(KEY, parent, children ARRAY, x, y, w, h): each group with children, in its own box or else that around its children."""
    groups = objects.where("type = 'group'").select(*KEY, F.col("object_id").alias("parent"), *[F.when(valid_box(), F.col(c)).alias(f"p{c}") for c in "xywh"])
    kids = objects.where("parent_id is not null").select(*KEY, F.col("parent_id").alias("parent"), "object_id", *[F.when(valid_box(), F.col(c)).alias(c) for c in "xywh"])
    j = groups.join(kids, [*KEY, "parent"])
    g = j.groupBy(*KEY, "parent", "px", "py", "pw", "ph").agg(F.array_sort(F.collect_list("object_id")).alias("children"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return g.select(*KEY, "parent", "children", F.coalesce("px", "x0").alias("x"), F.coalesce("py", "y0").alias("y"), F.coalesce("pw", F.col("x1") - F.col("x0")).alias("w"), F.coalesce("ph", F.col("y1") - F.col("y0")).alias("h"))


def peers(objects: DataFrame, least: int = 3) -> DataFrame:
    """(KEY, type, w, h, rotation, objects ARRAY): at least ``least`` objects of one type, size and rotation; an unknown rotation is one of its own."""
    o = _placed(objects).select(*KEY, "object_id", F.coalesce("type", F.lit("unknown")).alias("type"), F.round("w", 12).alias("w"), F.round("h", 12).alias("h"), F.round("rotation", 12).alias("rotation"))
    return o.groupBy(*KEY, "type", "w", "h", "rotation").agg(F.array_sort(F.collect_list("object_id")).alias("objects")).where(F.size("objects") >= least)


def slide_facts(objects: DataFrame) -> DataFrame:
    """(KEY, fact_type, value STRING of JSON): all facts of all slides in one table, to be joined or written as they are."""
    kinds = {
        "text_density": text_density, "shape_density": shape_density, "font_size_distribution": font_distribution, "font_family_distribution": font_families, "color_consistency": color_consistency, "rotation_distribution": rotations,
        "shape_hierarchy": hierarchy, "shape_peer_group": peers,
    }
    out = None
    for name, f in kinds.items():
        d = f(objects)
        d = d.select(*KEY, F.lit(name).alias("fact_type"), F.to_json(F.struct(*[c for c in d.columns if c not in KEY])).alias("value"))
        out = d if out is None else out.unionByName(d)
    return out
