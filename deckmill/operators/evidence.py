"""Evidence records: predicates on slide objects, roles, statuses, record ids, unions and contracts.

An evidence record is (deck_id, slide_number, object_id, fact_type, status,
confidence, ...). Ids of records are unique within a deck, so every key has the deck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold

STATUSES = ("verified", "partial", "unverified", "failed", "not_requested", "not_applicable")
#: Limits of the chrome and role rules in slide units.
EDGE, BACKGROUND_AREA, SMALL, FOOT, HEAD, LARGE = 0.08, 0.92, 0.05, 0.80, 0.18, 0.35
#: Words in an object's label that name its role, in order of priority.
ROLE_WORDS = {
    "logo": ["logo", "brand", "emblem", "badge"], "screenshot": ["screenshot", "screen shot", "mockup", "user interface"], "diagram": ["diagram", "flowchart", "architecture", "workflow", "process"],
    "chart": ["chart", "graph", "plot", "histogram"], "evidence_image": ["evidence", "result", "output", "test"], "decorative_image": ["decorative", "background", "ornament", "texture"],
}


def near_edge(tolerance: float = EDGE) -> Column:
    """Whether the box comes close to a side of the slide."""
    return (F.col("x") <= tolerance) | (F.col("y") <= tolerance) | (F.col("x") + F.col("w") >= 1 - tolerance) | (F.col("y") + F.col("h") >= 1 - tolerance)


def valid_box() -> Column:
    """Four finite numbers, width and height not negative."""
    ok = (F.col("w") >= 0) & (F.col("h") >= 0)
    for c in "xywh":
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce(ok, F.lit(False))


#: Fixed value: a text that is nothing but a page number.
PAGE_NUMBER = r"^(?:(?:page|slide)\s*)?\d+(?:\s*(?:/|of)\s*\d+)?$"


def page_number(text: Column) -> Column:
    """Whether the text is nothing but a page number."""
    return fold(text).rlike(PAGE_NUMBER)


def chrome_reasons(objects: DataFrame) -> DataFrame:
    """``objects`` with ``reasons``: why an object is slide chrome rather than content; empty for content.

    A text's repetitions are counted over its deck, so a deck's result doesn't depend on other decks.
    """
    t = objects.withColumn("__t", fold(F.coalesce("text", F.lit(""))))
    n = t.where("__t <> ''").groupBy("deck_id", "__t").agg(F.count_distinct("slide_number").alias("__n"))
    slides = objects.groupBy("deck_id").agg(F.count_distinct("slide_number").alias("__slides"))
    d = t.join(n, ["deck_id", "__t"], "left").join(slides, "deck_id")
    label, area = fold(F.coalesce("name", F.lit(""))), F.col("w") * F.col("h")
    often = F.col("__n") >= F.greatest(F.lit(3), F.ceil(0.6 * F.col("__slides")))
    badge = label.rlike(r"(?:^|\W)(?:logo|badge|emblem|watermark)(?:\W|$)") & (near_edge() | (area <= SMALL))
    reasons = F.array_compact(F.array(
        F.when(label.rlike(r"(?:^|\W)master(?:\W|$)"), "master"),
        F.when(label.rlike(r"(?:^|\W)background(?:\W|$)") | ((F.col("__t") == "") & (F.col("type") == "shape") & (area >= BACKGROUND_AREA) & (F.col("z_order") <= 2)), "background"),
        F.when(F.col("placeholder").isin("ftr", "dt", "sldNum"), "footer"), F.when(page_number(F.col("text")), "page_number"),
        F.when((F.col("__n") >= 2) & (F.col("y") >= FOOT), "repeated_footer"), F.when(badge, "badge"), F.when(often & ((F.col("y") <= HEAD) | (F.col("y") >= FOOT)), "template_noise"),
    ))
    return d.withColumn("reasons", reasons).drop("__t", "__n", "__slides")


def content_objects(marked: DataFrame) -> DataFrame:
    """Objects without a reason; text whose only reason is being a badge stays too."""
    return marked.where((F.size("reasons") == 0) | ((F.col("type") == "text") & (F.size(F.array_except("reasons", F.array(F.lit("badge")))) == 0)))


def titles(marked: DataFrame) -> DataFrame:
    """(deck_id, slide_number, object_id, text, score): the best title of each slide among its content texts in the upper part or in a title's or subtitle's placeholder.

    Only a title's placeholder gives points; font_size, if there, is the largest of the text's runs.
    """
    kind = F.lower(F.coalesce("placeholder", F.lit("")))
    d = marked.where((F.size("reasons") == 0) & (F.col("type") == "text") & (F.trim("text") != "") & (kind.isin("title", "ctrtitle", "subtitle") | (F.col("y") <= 0.38)))
    font = F.col("font_size") if "font_size" in marked.columns else F.lit(0.0)
    chars = F.length(F.regexp_replace("text", r"(?U)\s+", ""))
    score = F.when(kind.isin("title", "ctrtitle"), 100.0).otherwise(0.0) + F.greatest(F.lit(0.0), 32 - 64 * F.col("y")) + F.least(F.coalesce(font, F.lit(0.0)), F.lit(48.0)) / 4 + F.least(chars, F.lit(80)) / 16
    w = Window.partitionBy("deck_id", "slide_number").orderBy(F.col("score").desc(), "y", "x", "object_id")
    d = d.withColumn("score", F.round(score, 12)).withColumn("__k", F.row_number().over(w)).where("__k = 1")
    return d.select("deck_id", "slide_number", "object_id", "text", "score")


def image_role(label: Column, uses: Column) -> Column:
    """STRUCT<role, confidence> of an image object from its label, size, place and uses in the deck."""
    low, area = fold(F.coalesce(label, F.lit(""))), F.col("w") * F.col("h")
    out = F.when((uses >= 2) & (area <= SMALL) & near_edge(), F.struct(F.lit("logo").alias("role"), F.lit(0.9).alias("confidence")))
    for role, words in ROLE_WORDS.items():
        out = out.when(low.rlike(r"(?:^|\W)(?:" + "|".join(words) + r")(?:\W|$)"), F.struct(F.lit(role).alias("role"), F.lit(0.85).alias("confidence")))
    return out.when(area >= LARGE, F.struct(F.lit("evidence_image").alias("role"), F.lit(0.35).alias("confidence"))).otherwise(F.struct(F.lit("unknown").alias("role"), F.lit(0.0).alias("confidence")))


def meaningful(role: Column) -> Column:
    """Whether an image says something: by its role, and of an unknown role unless it is small and at the edge."""
    return ~role.isin("logo", "decorative_image", "unknown") | ((role == "unknown") & ((F.col("w") * F.col("h") >= 0.04) | ~near_edge()))


def merged_status(statuses: Column) -> Column:
    """The status of several pieces of evidence: all verified, any failed among none verified, some of each, or nothing asked for."""
    has = lambda s: F.array_contains(statuses, s)
    asked = F.filter(statuses, lambda s: ~s.isin("not_requested", "not_applicable"))
    return (
        F.when(F.size(asked) == 0, F.when(has("not_requested"), "not_requested").otherwise("not_applicable"))
        .when(F.forall(asked, lambda s: s == "verified"), "verified").when(has("verified") | has("partial"), "partial").when(has("failed"), "failed").otherwise("unverified")
    )


def record_ids(facts: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """``facts`` with evidence_id: prefix, slide, type, and a number within the deck and type by slide and ``order``."""
    w = Window.partitionBy("deck_id", "fact_type").orderBy("slide_number", *order)
    return facts.withColumn("evidence_id", F.format_string(f"{prefix}-slide-%02d-%s-%04d", "slide_number", "fact_type", F.row_number().over(w)))


def union_facts(*facts: DataFrame) -> DataFrame:
    """Facts of several types in one table; fields that a type lacks are null."""
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def contract_violations(evidence: DataFrame, slides: DataFrame, objects: DataFrame) -> DataFrame:
    """(deck_id, evidence_id, rule) of records that break the contract: unknown status, confidence out of 0..1, missing slide or object, repeated id."""
    e = evidence.join(slides.select("deck_id", "slide_number").distinct().withColumn("__s", F.lit(True)), ["deck_id", "slide_number"], "left")
    e = e.join(objects.select("deck_id", "object_id").distinct().withColumn("__o", F.lit(True)), ["deck_id", "object_id"], "left")
    twice = evidence.groupBy("deck_id", "evidence_id").agg(F.count("*").alias("n")).where("n > 1").select("deck_id", "evidence_id", F.lit("repeated_id").alias("rule"))
    rules = F.array_compact(F.array(
        F.when(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), F.lit("unknown_status")), F.when(F.isnan("confidence") | ~F.col("confidence").between(0.0, 1.0), F.lit("confidence_range")),
        F.when(F.col("__s").isNull(), F.lit("missing_slide")), F.when(F.col("object_id").isNotNull() & F.col("__o").isNull(), F.lit("missing_object")),
    ))
    return e.select("deck_id", "evidence_id", F.explode(rules).alias("rule")).unionByName(twice)


def colors(objects: DataFrame, keys: list[str], color: str) -> DataFrame:
    """(keys, n_colors, dominant, dominant_share): a group's palette; ties go to the first colour by name."""
    n = objects.where(F.col(color).isNotNull()).groupBy(*keys, F.upper(color).alias("__c")).agg(F.count("*").alias("__n"))
    g = n.groupBy(*keys).agg(F.count("*").alias("n_colors"), F.min(F.struct((-F.col("__n")).alias("k"), F.col("__c").alias("c"))).alias("m"), F.sum("__n").alias("s"))
    return g.select(*keys, "n_colors", F.col("m.c").alias("dominant"), F.round(-F.col("m.k") / F.col("s"), 6).alias("dominant_share"))


def inherited(shape: DataFrame, levels: list[DataFrame], keys: list[str], fields: list[str]) -> DataFrame:
    """``shape`` with each field from the first level that has it, and ``<field>_from``: 0 for the shape itself, then the level's number."""
    out = shape
    for i, level in enumerate(levels, 1):
        out = out.join(level.select(*keys, *[F.col(f).alias(f"__{i}_{f}") for f in fields]), keys, "left")
    for f in fields:
        cols = [F.col(f), *[F.col(f"__{i}_{f}") for i in range(1, len(levels) + 1)]]
        came = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(cols)])
        out = out.withColumn(f"{f}_from", came).withColumn(f, F.coalesce(*cols))
    return out.drop(*[f"__{i}_{f}" for i in range(1, len(levels) + 1) for f in fields])
