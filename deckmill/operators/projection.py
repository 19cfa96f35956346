"""From the objects of packages to the slides that ``metrics`` scores.

Objects are marked as chrome or content once (``evidence.chrome_reasons``); what
is left is gathered by slide: text blocks in reading position, one visual for
each image file on a slide, tables, the title, and the geometry measures. All
joins are keyed by deck and slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lineage import cut
from . import content, evidence, metrics

KEY = ["deck_id", "slide_number"]
#: Names of image roles in a visual, roles that are noise, and the least confidence of text read from an image.
ROLES = {"diagram": "diagram_candidate", "screenshot": "screenshot", "chart": "chart", "evidence_image": "evidence_image", "logo": "logo", "decorative_image": "decorative"}
NOISE, SURE_TEXT = ("logo", "decorative"), 0.65


def object_assets(objects: DataFrame, slide_parts: DataFrame, rels: DataFrame, assets: DataFrame) -> DataFrame:
    """(deck_id, slide_number, object_id, asset_id, part, sha256): each object with the files that its relationships point at; objects without a file are left out.

    slide_parts: deck_id, slide_number, part. rels and assets as of ``packages``.
    """
    o = objects.select(*KEY, "object_id", F.explode("rel_ids").alias("rel_id")).join(slide_parts.select(*KEY, F.col("part").alias("source_part")), KEY)
    r = rels.where("resolved_target is not null").select("deck_id", "source_part", "rel_id", F.col("resolved_target").alias("part"))
    return o.join(r, ["deck_id", "source_part", "rel_id"]).join(assets.select("deck_id", "asset_id", "part", "sha256"), ["deck_id", "part"]).select(*KEY, "object_id", "asset_id", "part", "sha256").distinct()


def referenced_assets(assets: DataFrame, links: DataFrame) -> DataFrame:
    """The assets that some object shows (semi join)."""
    return assets.join(links.select("deck_id", "asset_id").distinct(), ["deck_id", "asset_id"], "left_semi")


def text_blocks(kept: DataFrame) -> DataFrame:
    """(KEY, blocks, visible_text) of the content texts with an area, from top to bottom and left to right."""
    t = kept.where((F.col("type") == "text") & (F.trim(F.coalesce("text", F.lit(""))) != "") & evidence.valid_box() & (F.col("w") * F.col("h") > 0))
    g = t.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("y", "x", "object_id", F.trim("text").alias("text"), "w", "h"))).alias("l"))
    blocks = F.transform("l", lambda b: F.struct(b["object_id"].alias("object_id"), b["text"].alias("text"), *[b[k].alias(k) for k in "xywh"]))
    return g.select(*KEY, blocks.alias("blocks"), F.array_join(F.transform("l", lambda b: b["text"]), "\n").alias("visible_text"))


def visuals(kept: DataFrame, links: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(KEY, visuals): one for each image file that a slide shows as content, in the hull of its places; noise is left out.

    texts: (deck_id, asset_id, text, confidence, status) read from images. A visual
    is extracted if its file has verified text of enough confidence, else of low
    confidence.
    """
    uses = links.groupBy("deck_id", "asset_id").agg(F.count("*").alias("uses"))
    i = kept.where((F.col("type") == "image") & evidence.valid_box() & (F.col("w") * F.col("h") > 0)).join(links.select(*KEY, "object_id", "asset_id", "part", "sha256"), [*KEY, "object_id"]).join(uses, ["deck_id", "asset_id"])
    role = evidence.image_role(F.concat_ws(" ", "name", "text", "part"), F.col("uses"))
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    i = i.withColumn("role", F.coalesce(F.try_element_at(names, role["role"]), F.lit("unknown")))
    g = i.groupBy(*KEY, "asset_id", "sha256").agg(F.min_by("role", "object_id").alias("role"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    g = g.withColumns({"w": F.col("r") - F.col("x"), "h": F.col("b") - F.col("y")})
    g = g.where(~F.col("role").isin(*NOISE) & ((F.col("role") != "unknown") | (F.col("w") * F.col("h") >= 0.04) | ~evidence.near_edge()))
    if texts is None:
        g = g.withColumn("ocr_text", F.lit(None).cast("string"))
    else:
        sure = texts.where((F.col("status") == "verified") & (F.col("confidence") >= SURE_TEXT) & (F.trim("text") != "")).groupBy("deck_id", "asset_id").agg(F.max_by("text", "confidence").alias("ocr_text"))
        g = g.join(sure, ["deck_id", "asset_id"], "left")
    item = F.struct("asset_id", "role", F.when(F.col("ocr_text").isNotNull(), "extracted").otherwise("low_confidence").alias("content_status"), "sha256", "ocr_text", F.lit(True).alias("scoring_relevant"), "x", "y", "w", "h")
    fields = ("role", "content_status", "sha256", "ocr_text", "scoring_relevant", "x", "y", "w", "h")
    v = g.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return v.select(*KEY, F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("visuals"))


def slide_rows(objects: DataFrame, links: DataFrame, texts: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """The slides of ``metrics.SLIDE``, one row for every slide with objects.

    objects: those of ``packages.objects`` (font_size or font_sizes may lack);
    links: of ``object_assets``; statuses: (deck_id, slide_number, statuses
    ARRAY<STRING>) of the stages that looked at a slide.
    """
    # read by every part below, so it is made and written once
    marked, links = cut(evidence.chrome_reasons(cut(objects))), cut(links)
    if "font_size" not in marked.columns:
        marked = marked.withColumn("font_size", F.array_max("font_sizes") if "font_sizes" in marked.columns else F.lit(None).cast("double"))
    kept = evidence.content_objects(marked)
    keep = kept.select(*KEY, "object_id").withColumn("__kept", F.lit(True))
    smallest = F.array_min("font_sizes") if "font_sizes" in marked.columns else F.col("font_size")
    flagged = marked.join(keep, [*KEY, "object_id"], "left").select(*KEY, "object_id", "type", "text", "x", "y", "w", "h", smallest.alias("font_size"), F.col("__kept").isNull().alias("excluded"))
    measures = cut(metrics.slide_measures(flagged))
    titles = evidence.titles(marked).select(*KEY, F.col("object_id").alias("title_id"), F.col("text").alias("title"))
    tables = kept.where("type = 'table'").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("object_id", "x", "y", "w", "h"))).alias("tables"))
    d = measures.join(text_blocks(kept), KEY, "left").join(visuals(kept, links, texts), KEY, "left").join(tables, KEY, "left").join(titles, KEY, "left")
    d = d.join(statuses, KEY, "left") if statuses is not None else d.withColumn("statuses", F.array().cast("array<string>"))
    d = d.withColumn("visible_text", F.coalesce("visible_text", F.lit("")))
    diagram = F.exists(F.coalesce("visuals", F.array().cast(d.schema["visuals"].dataType)), lambda v: v["role"] == "diagram_candidate")
    return d.withColumn("slide_type", slide_type(F.col("visible_text"), diagram))


def slide_type(text: Column, has_diagram: Column) -> Column:
    """The kind that a slide's text tells, else architecture if it shows a diagram, else content."""
    return F.coalesce(content.first_match(F.lower(tx.squeeze(text)), content.SLIDE_TYPES), F.when(has_diagram, "architecture"), F.lit("content"))
