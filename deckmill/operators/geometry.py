"""Layout facts of boxes on slides: overlap, union area, gaps, alignment, spacing.

Boxes are rows (slide, id, x, y, w, h) in slide units, 0..1 being the slide. All
operators work on every slide at once; a slide's boxes meet only each other, so
each join and window is keyed by slide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tolerances in slide units.
ALIGNED, NEARLY_ALIGNED, FACING = 0.005, 0.05, 0.75
SPACING_ROW, SPACING_SPREAD = 0.01, 0.05


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def edges(df: DataFrame) -> DataFrame:
    """Boxes with right and bottom edge and area."""
    return df.withColumns({"r": F.col("x") + F.col("w"), "b": F.col("y") + F.col("h"), "area": F.col("w") * F.col("h")})


#: Cells along a side of the slide; boxes meet cell by cell, so that a slide with very many boxes is spread and far boxes never meet.
GRID = 16


def cell(v: Column, grid: int = GRID) -> Column:
    """The cell of a coordinate; everything beyond the slide falls into one cell on each side."""
    return F.greatest(F.lit(-1), F.least(F.lit(grid), F.floor(v * grid).cast("int")))


def overlap_pairs(df: DataFrame) -> DataFrame:
    """(slide, first_id, second_id, intersection, of_smaller, iou) of boxes that truly intersect.

    The left edge of one of two such boxes lies within the other's width: a box
    stands once, in the strip of its left edge, and meets the boxes that cover
    this strip and start before it. So a pair is made once, and a box is copied
    into strips, never into cells of both axes.
    """
    e = edges(df)
    own = e.withColumn("strip", cell(F.col("x")))
    wide = e.withColumn("strip", F.explode(F.sequence(cell(F.col("x")), cell(F.col("r")))))
    p, q = (d.select("slide", "strip", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "x", "y", "r", "b", "area")]) for d, k in ((wide, "p"), (own, "q")))
    before = (F.col("p_x") < F.col("q_x")) | ((F.col("p_x") == F.col("q_x")) & (F.col("p_id") < F.col("q_id")))
    d = p.join(q, ["slide", "strip"]).where(before & (F.col("q_x") < F.col("p_r"))).withColumns({"sx": span("x", "r"), "sy": span("y", "b")}).where("sx > 0 and sy > 0").withColumn("i", F.col("sx") * F.col("sy"))
    smaller, union = F.least("p_area", "q_area"), F.col("p_area") + F.col("q_area") - F.col("i")
    return d.select("slide", F.least("p_id", "q_id").alias("first_id"), F.greatest("p_id", "q_id").alias("second_id"), F.round("i", 6).alias("intersection"), F.round(F.col("i") / smaller, 6).alias("of_smaller"), F.round(F.col("i") / union, 6).alias("iou"))


def span(lo: str, hi: str) -> Column:
    """Length that two boxes share along an axis, e.g. ``span("x", "r")``; negative for a gap."""
    return F.least(F.col(f"p_{hi}"), F.col(f"q_{hi}")) - F.greatest(F.col(f"p_{lo}"), F.col(f"q_{lo}"))


def alignment_mismatch(df: DataFrame) -> DataFrame:
    """(slide, first_id, second_id, edge, distance): facing boxes of which an edge is nearly but not quite aligned; the closest edge.

    Boxes are joined on strips of an edge's coordinate as wide as the farthest
    mismatch: only boxes whose edge lies in the same or the next strip meet.
    """
    e = edges(df).where("w > 0 and h > 0")
    lines = (("left", F.col("x")), ("right", F.col("r")), ("center_x", F.col("x") + F.col("w") / 2), ("top", F.col("y")), ("bottom", F.col("b")), ("center_y", F.col("y") + F.col("h") / 2))
    long = e.withColumn("l", F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), v.alias("v")) for k, v in lines]))).withColumn("strip", F.floor(F.col("l.v") / NEARLY_ALIGNED).cast("bigint"))
    side = lambda d, k: d.select("slide", F.col("l.edge").alias("edge"), "strip", F.col("l.v").alias(f"{k}_v"), *[F.col(c).alias(f"{k}_{c}") for c in ("id", "x", "y", "w", "h", "r", "b")])
    around = long.withColumn("strip", F.explode(F.array(F.col("strip") - 1, F.col("strip"), F.col("strip") + 1)))
    d = side(long, "p").join(side(around, "q"), ["slide", "edge", "strip"]).where("p_id < q_id").withColumn("d", F.abs(F.col("p_v") - F.col("q_v")))
    facing = F.when(F.col("edge").isin("left", "right", "center_x"), span("x", "r") / F.least("p_w", "q_w")).otherwise(span("y", "b") / F.least("p_h", "q_h"))
    m = d.where((facing >= FACING) & (F.col("d") > ALIGNED) & (F.col("d") <= NEARLY_ALIGNED)).groupBy("slide", "p_id", "q_id").agg(F.min(F.struct("d", "edge")).alias("m"))
    return m.select("slide", F.col("p_id").alias("first_id"), F.col("q_id").alias("second_id"), "m.edge", F.round("m.d", 6).alias("distance"))


def slabs(df: DataFrame) -> DataFrame:
    """(slide, k, x0, x1): the vertical strips between neighbouring edges of the boxes clipped to the slide."""
    e = df.select("slide", F.explode(F.array(clip(F.col("x")), clip(F.col("x") + F.col("w")), F.lit(0.0), F.lit(1.0))).alias("x0")).distinct()
    w = Window.partitionBy("slide").orderBy("x0")
    return e.select("slide", F.row_number().over(w).alias("k"), "x0", F.lead("x0").over(w).alias("x1")).where("x1 > x0")


def covered(df: DataFrame) -> DataFrame:
    """(slide, k, x0, x1, top, bottom, reach): the boxes that cross each strip, with how far down the boxes above them reach."""
    c = df.select("slide", clip(F.col("x")).alias("l"), clip(F.col("x") + F.col("w")).alias("r"), clip(F.col("y")).alias("top"), clip(F.col("y") + F.col("h")).alias("bottom")).where("r > l and bottom > top")
    d = slabs(df).join(c, "slide").where((F.col("l") <= F.col("x0")) & (F.col("r") >= F.col("x1")))
    w = Window.partitionBy("slide", "k").orderBy("top", "bottom").rowsBetween(Window.unboundedPreceding, -1)
    return d.select("slide", "k", "x0", "x1", "top", "bottom", F.coalesce(F.max("bottom").over(w), F.lit(0.0)).alias("reach"))


def union_area(df: DataFrame) -> DataFrame:
    """(slide, n_boxes, union_area): area of the slide that is covered by boxes."""
    new = F.greatest(F.lit(0.0), F.col("bottom") - F.greatest("top", "reach")) * (F.col("x1") - F.col("x0"))
    area = covered(df).groupBy("slide").agg(F.sum(new).alias("a"))
    return df.groupBy("slide").agg(F.count("*").alias("n_boxes")).join(area, "slide", "left").select("slide", "n_boxes", F.round(F.coalesce("a", F.lit(0.0)), 6).alias("union_area"))


def empty_regions(df: DataFrame, most: int = 64) -> DataFrame:
    """(slide, place, x0, x1, top, bottom, area): empty rectangles as high as their strips allow, largest first, ``most`` of a slide."""
    c = covered(df)
    between = c.where(F.col("top") > F.col("reach")).select("slide", "k", "x0", "x1", F.col("reach").alias("g0"), F.col("top").alias("g1"))
    ends = c.groupBy("slide", "k").agg(F.max("bottom").alias("g0"))
    below = slabs(df).join(ends, ["slide", "k"], "left").select("slide", "k", "x0", "x1", F.coalesce("g0", F.lit(0.0)).alias("g0"), F.lit(1.0).alias("g1")).where("g1 > g0")
    w = Window.partitionBy("slide", "g0", "g1").orderBy("k")
    runs = between.unionByName(below).withColumn("run", F.col("k") - F.row_number().over(w))
    g = runs.groupBy("slide", "g0", "g1", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    g = g.withColumn("area", F.round((F.col("x1") - F.col("x0")) * (F.col("g1") - F.col("g0")), 6))
    by = Window.partitionBy("slide").orderBy(F.col("area").desc(), "g0", "x0", "x1", "g1")
    g = g.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)
    return g.select("slide", "place", *[F.round(a, 6).alias(b) for a, b in (("x0", "x0"), ("x1", "x1"), ("g0", "top"), ("g1", "bottom"))], "area")


def margins(df: DataFrame) -> DataFrame:
    """(slide, left, top, right, bottom, occupied_w, occupied_h): distances of the boxes' hull from the slide's edges; negative beyond it."""
    e = edges(df).groupBy("slide").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("r").alias("r"), F.max("b").alias("b"))
    one = F.lit(1.0)
    out = {"left": F.col("x"), "top": F.col("y"), "right": one - F.col("r"), "bottom": one - F.col("b"), "occupied_w": F.col("r") - F.col("x"), "occupied_h": F.col("b") - F.col("y")}
    return e.select("slide", *[F.round(v, 6).alias(k) for k, v in out.items()])


def clipping(df: DataFrame) -> DataFrame:
    """(slide, id, sides, outside_share) of the boxes that leave the slide."""
    e = edges(df)
    inside = (clip(F.col("r")) - clip(F.col("x"))) * (clip(F.col("b")) - clip(F.col("y")))
    sides = F.concat_ws(",", F.when(F.col("x") < 0, "left"), F.when(F.col("y") < 0, "top"), F.when(F.col("r") > 1, "right"), F.when(F.col("b") > 1, "bottom"))
    return e.select("slide", "id", sides.alias("sides"), F.round(F.coalesce(F.try_divide(F.col("area") - inside, F.col("area")), F.lit(0.0)), 6).alias("outside_share")).where("sides <> ''")


def whitespace_balance(df: DataFrame) -> DataFrame:
    """(slide, whitespace, horizontal, vertical, balance): how evenly the covered area lies in the halves of the slide; 1 is even."""
    half = lambda x, y, w, h, name: F.struct(F.lit(name).alias("part"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + w).alias("x1"), F.lit(y + h).alias("y1"))
    parts = F.array(half(0.0, 0.0, 1.0, 1.0, "all"), half(0.0, 0.0, 0.5, 1.0, "l"), half(0.5, 0.0, 0.5, 1.0, "r"), half(0.0, 0.0, 1.0, 0.5, "t"), half(0.0, 0.5, 1.0, 0.5, "b"))
    cut = lambda c, lo, hi: F.greatest(lo, F.least(hi, c))
    d = df.select("*", F.explode(parts).alias("q"))
    x0, x1 = cut(F.col("x"), F.col("q.x0"), F.col("q.x1")), cut(F.col("x") + F.col("w"), F.col("q.x0"), F.col("q.x1"))
    y0, y1 = cut(F.col("y"), F.col("q.y0"), F.col("q.y1")), cut(F.col("y") + F.col("h"), F.col("q.y0"), F.col("q.y1"))
    d = d.select(F.struct("slide", "q.part").alias("slide"), "id", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    a = union_area(d).select("slide.slide", "slide.part", "union_area")
    p = a.groupBy("slide").pivot("part", ["all", "l", "r", "t", "b"]).agg(F.first("union_area"))
    even = lambda i, j: F.coalesce(F.lit(1.0) - F.try_divide(F.abs(F.col(i) - F.col(j)), F.col(i) + F.col(j)), F.lit(1.0))
    p = p.select("slide", (F.lit(1.0) - F.col("all")).alias("ws"), even("l", "r").alias("hb"), even("t", "b").alias("vb"))
    return p.select("slide", F.round("ws", 6).alias("whitespace"), F.round("hb", 6).alias("horizontal"), F.round("vb", 6).alias("vertical"), F.round((F.col("hb") + F.col("vb")) / 2, 6).alias("balance"))


def anchored(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """``df`` with ``anchor``: values sorted within ``keys`` open a new cluster when they exceed the cluster's first by more than the tolerance.

    The anchor is the first value, not the one before, so this is a fold over
    each group's sorted distinct values, which are what it holds in memory.
    """
    values = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("vs"))
    fold = F.aggregate(
        "vs", F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<v:double,a:double>>").alias("out")),
        lambda s, v: F.struct(
            F.when(s["at"].isNull() | (v - s["at"] > tolerance), v).otherwise(s["at"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(v.alias("v"), F.when(s["at"].isNull() | (v - s["at"] > tolerance), v).otherwise(s["at"]).alias("a")))).alias("out"),
        ),
        lambda s: s["out"],
    )
    at = values.select(*keys, F.explode(fold).alias("e")).select(*keys, F.col("e.v").alias(value), F.col("e.a").alias("anchor"))
    return df.join(at, [*keys, value])


def alignment_groups(df: DataFrame) -> DataFrame:
    """(slide, edge, anchor, n_boxes, first_id, last_id): sets of two or more boxes that share an edge or centre line."""
    e = edges(df)
    lines = {"left": F.col("x"), "center_x": F.col("x") + F.col("w") / 2, "right": F.col("r"), "top": F.col("y"), "center_y": F.col("y") + F.col("h") / 2, "bottom": F.col("b")}
    long = e.select("slide", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), F.round(v, 6).alias("v")) for k, v in lines.items()])).alias("l")).select("slide", "id", "l.edge", "l.v")
    g = anchored(long, ["slide", "edge"], "v", ALIGNED + 1e-9).groupBy("slide", "edge", "anchor").agg(F.count("*").alias("n_boxes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return g.where("n_boxes >= 2")


def equal_spacing(df: DataFrame) -> DataFrame:
    """(slide, row_at, id_1, id_2, id_3, gap): three neighbours in a row with equal gaps."""
    e = df.withColumn("cy", F.round(F.col("y") + F.col("h") / 2, 6))
    rows = anchored(e, ["slide"], "cy", SPACING_ROW + 1e-9)
    w = Window.partitionBy("slide", "anchor").orderBy("x", "id")
    n = lambda c, k: F.lead(c, k).over(w)
    d = rows.select("slide", "anchor", F.col("id").alias("id_1"), n("id", 1).alias("id_2"), n("id", 2).alias("id_3"), (n("x", 1) - F.col("x") - F.col("w")).alias("g1"), (n("x", 2) - n("x", 1) - n("w", 1)).alias("g2")).where("id_3 is not null")
    mean = (F.col("g1") + F.col("g2")) / 2
    ok = (F.least("g1", "g2") >= -ALIGNED) & (mean > ALIGNED) & (F.abs(F.col("g1") - F.col("g2")) <= F.greatest(F.lit(ALIGNED), SPACING_SPREAD * mean))
    return d.where(ok).select("slide", F.col("anchor").alias("row_at"), "id_1", "id_2", "id_3", F.round(mean, 6).alias("gap"))


def peer_groups(df: DataFrame, least: int = 3, digits: int = 2) -> DataFrame:
    """(slide, w, h, n_boxes, first_id): boxes of one size on a slide."""
    g = df.groupBy("slide", F.round("w", digits).alias("w"), F.round("h", digits).alias("h")).agg(F.count("*").alias("n_boxes"), F.min("id").alias("first_id"))
    return g.where(F.col("n_boxes") >= least)


def nearest_box(df: DataFrame, within: float = 0.08) -> DataFrame:
    """(slide, id, nearest_id, distance): for each box's centre the nearest other box, at most ``within`` away; ties go to the lower id."""
    e, grid = edges(df), max(1, int(1 / within))
    p = e.select("slide", "id", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    p = p.withColumns({"cx": cell(F.col("px"), grid), "cy": cell(F.col("py"), grid)})
    reach = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo) - within, grid), cell(F.col(hi) + within, grid)))
    q = e.select("slide", F.col("id").alias("other"), "x", "y", "r", "b").withColumn("cx", reach("x", "r")).withColumn("cy", reach("y", "b"))
    dx = F.greatest(F.col("x") - F.col("px"), F.col("px") - F.col("r"), F.lit(0.0))
    dy = F.greatest(F.col("y") - F.col("py"), F.col("py") - F.col("b"), F.lit(0.0))
    d = p.join(q, ["slide", "cx", "cy"]).where("id <> other").withColumn("d", F.round(F.sqrt(dx * dx + dy * dy), 6))
    m = d.groupBy("slide", "id").agg(F.min(F.struct("d", "other")).alias("m"))
    return m.select("slide", "id", F.col("m.other").alias("nearest_id"), F.col("m.d").alias("distance")).where(F.col("distance") <= within)


def reading_order(df: DataFrame) -> DataFrame:
    """(slide, reading_order): left_to_right if the boxes' tops hardly spread, top_to_bottom if their left edges do, else unknown."""
    g = df.groupBy("slide").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("sy"), (F.max("x") - F.min("x")).alias("sx"), F.median("h").alias("mh"), F.median("w").alias("mw"))
    rule = F.when(F.col("n") < 2, "unknown").when(F.col("sy") <= F.greatest(F.lit(0.04), 1.5 * F.col("mh")), "left_to_right").when(F.col("sx") <= F.greatest(F.lit(0.04), 1.5 * F.col("mw")), "top_to_bottom").otherwise("unknown")
    return g.select("slide", rule.alias("reading_order"))
