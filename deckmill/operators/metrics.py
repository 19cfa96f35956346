"""Metrics and scores of whole decks.

Input is one row per slide (``SLIDE``): its blocks, visuals and tables as nested
columns and its measures as numbers. Everything about a slide is computed within
its row (``measured``), so that only numbers are shuffled: once, by deck
(``deck_metrics``). Scores (``component_scores``, ``evaluated``) are columns over
a deck's row. A measure that is missing is null, is left out of means, and is
counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import content, geometry

BOX = "x:double,y:double,w:double,h:double"
#: Columns of a slide.
SLIDE = (
    "deck_id long, slide_number int, slide_type string, title_id string, title string, visible_text string,"
    f" blocks array<struct<object_id:string,text:string,{BOX}>>, visuals array<struct<role:string,content_status:string,sha256:string,ocr_text:string,scoring_relevant:boolean,{BOX}>>, tables array<struct<object_id:string,{BOX}>>,"
    " statuses array<string>, text_density double, small_text_ratio double, overlap_ratio double, clipping_rate double, occupied_area_ratio double, whitespace_area_ratio double, largest_empty_region_ratio double, whitespace_balance double, visual_area_ratio double"
)
#: Measures whose mean over the slides is a metric of the deck.
MEANS = ("text_density", "small_text_ratio", "overlap_ratio", "clipping_rate", "occupied_area_ratio", "whitespace_area_ratio", "largest_empty_region_ratio", "visual_area_ratio")
#: Target area of visuals; white space and empty region that are no excess; spread of density that leaves no consistency; balance below which a slide is weak.
TARGET_AREA, EXCESS_WHITE, LARGE_EMPTY, DENSITY_SPREAD, WEAK_BALANCE = 0.25, 0.35, 0.20, 0.20, 0.60
#: Roles that explain nothing, and those that are evidence; terms of links to a prototype.
IDLE_ROLES, EVIDENCE_ROLES = ("unknown", "decorative", "template"), ("screenshot", "evidence_image", "chart", "diagram_candidate")
PROTOTYPE_TERMS = ("demo", "prototype", "github.com", "gitlab.com", "bitbucket.org", "figma.com", "youtube.com", "youtu.be")
#: Points of the components of the two groups of scores, and the weights of the groups.
PROPOSAL = {"problem_statement_alignment": 20.0, "solution_clarity": 20.0, "technical_feasibility": 15.0, "innovation": 10.0, "prototype_evidence": 5.0}
DECK = {"text_visual_balance": 8.0, "content_structure": 5.0, "readability": 5.0, "narrative_flow": 4.0, "visual_relevance_coherence": 5.0, "layout_space_usage": 3.0}
PROPOSAL_WEIGHT, DECK_WEIGHT, MISSING_POINTS = 0.70, 0.30, 10.0

_SCORE = "struct<score:double,confidence:double,n_missing:int>"


def _r(c: Column, places: int = 6) -> Column:
    """Rounded half up; what binary fractions lack of a half is made up for."""
    return F.round(c + 1e-9, places)


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _items(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + f(x))


def visible_area() -> Column:
    """Areas of a slide's blocks, visuals and tables added up, each side and the sum at most 1."""
    area = lambda b: F.coalesce(_clip(b["w"]) * _clip(b["h"]), F.lit(0.0))
    return F.least(F.lit(1.0), sum((_sum(F.col(c), area) for c in ("blocks", "visuals", "tables")), F.lit(0.0)))


def balance(body_chars: Column, label_chars: Column) -> Column:
    """How well a slide's text and visuals go together: points off for too much text, visuals without words, missing visuals and missing explanation."""
    density, area = F.coalesce(_clip(F.col("text_density")), F.lit(0.0)), F.coalesce(_clip(F.col("visual_area_ratio")), F.lit(0.0))
    much_text = F.when(body_chars > 0, _clip((density - 0.32) / 0.48)).otherwise(0.0)
    bare = _clip((area - 0.70) / 0.30) * _clip((90.0 - body_chars) / 90.0)
    wants = F.lower("slide_type").isin("architecture", "process", "results", "comparison") | (body_chars >= 180)
    lacks = F.when(F.coalesce(wants, F.lit(False)) & (area < 0.08), F.least(F.lit(1.0), (0.08 - area) / 0.08)).otherwise(0.0)
    words = body_chars + label_chars
    unexplained = F.when((area >= 0.25) & (words < 55), F.least(F.lit(1.0), (55.0 - words) / 55.0)).otherwise(0.0)
    return _clip(1.0 - 0.50 * much_text - 0.25 * bare - 0.15 * lacks - 0.10 * unexplained)


def relevance() -> Column:
    """Whether a slide's visuals explain something and are told with confidence; a slide without visuals gets a fixed middle value."""
    n = F.size("visuals")
    useful = F.size(F.filter("visuals", lambda v: ~F.coalesce(v["role"], F.lit("")).isin(*IDLE_ROLES)))
    unsure = F.size(F.filter("visuals", lambda v: F.coalesce(v["content_status"] == "low_confidence", F.lit(False))))
    return F.when(n == 0, F.lit(0.35)).otherwise(_clip(0.75 * useful / n + 0.25 * (1.0 - 0.5 * unsure / n)))


def coverage(shows: Column) -> Column:
    """Area of visuals against its target; null without any measure."""
    area = F.coalesce(F.col("visual_area_ratio"), F.when(shows, F.col("__area")))
    return F.least(F.lit(1.0), _clip(area) / TARGET_AREA)


def space(shows: Column) -> Column:
    """Use of a slide's space: points off for white space and a single empty region beyond what margins need; null without any measure."""
    white = F.coalesce(F.col("whitespace_area_ratio"), 1.0 - _clip(F.col("occupied_area_ratio")), F.when(shows, 1.0 - F.col("__area")))
    largest = F.coalesce(F.col("largest_empty_region_ratio"), white)
    over = lambda v, limit: F.greatest(F.lit(0.0), (_clip(v) - limit) / (1.0 - limit))
    return F.greatest(F.lit(0.0), 1.0 - 0.65 * over(white, EXCESS_WHITE) - 0.35 * over(largest, LARGE_EMPTY))


def measured(slides: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The numbers of each slide that the metrics of its deck need, and the columns to ``keep``. Null collections are empty; nothing is shuffled."""
    kinds = {c.name: c.dataType.simpleString() for c in slides.schema if c.name in ("blocks", "visuals", "tables", "statuses")}
    d = slides.withColumns({c: _items(c, k) for c, k in kinds.items()})
    body = F.filter("blocks", lambda b: (tx.squeeze(b["text"]) != "") & ~b["object_id"].eqNullSafe(F.coalesce(F.col("title_id"), F.lit("\x00"))))
    body = F.transform(body, lambda b: tx.squeeze(b["text"]))
    pictures = (F.size("visuals") > 0) | (F.size("tables") > 0)
    d = d.withColumn("__s", F.explode(F.array(content.structure(body, pictures))))
    # columns of their own, so that no expression over them holds their text again
    d = d.withColumns({
        "__text": F.lower(tx.squeeze(F.concat_ws(" ", "title", "visible_text"))), "__folded": tx.fold(F.coalesce("visible_text", F.lit(""))),
        "__labels": _sum(F.col("visuals"), lambda v: F.coalesce(F.length(tx.squeeze(v["ocr_text"])), F.lit(0))), "__area": visible_area(),
    })
    text, folded, labels = F.col("__text"), F.col("__folded"), F.col("__labels")
    return d.select(
        *keep, "deck_id", "slide_number", F.coalesce("slide_type", F.lit("")).alias("slide_type"), (tx.squeeze(F.coalesce("title", F.lit(""))) != "").cast("int").alias("titled"), *MEANS, "whitespace_balance", "__s.*",
        content.first_match(text, content.PHASES).alias("phase"), (text == "").alias("blank"), _r(balance(F.col("__s.chars"), labels), 6).alias("balance"), _r(relevance(), 6).alias("relevance"),
        _r(coverage(pictures), 6).alias("coverage"), _r(space(pictures | (F.size("blocks") > 0)), 6).alias("space"),
        _r(content.visible_share(F.col("statuses"), (folded != "") | pictures | (F.size("blocks") > 0)), 6).alias("visibility"),
        F.when(folded != "", F.xxhash64(folded)).alias("text_hash"), F.transform(F.filter("visuals", lambda v: F.coalesce(v["sha256"], F.lit("")) != ""), lambda v: v["sha256"]).alias("hashes"),
        F.size(F.filter("visuals", lambda v: v["role"].isin(*EVIDENCE_ROLES) & F.coalesce(v["scoring_relevant"], F.lit(True)))).alias("n_evidence"),
    )


def deck_metrics(measures: DataFrame) -> DataFrame:
    """One row per deck: every metric, rounded to six places, ``missing_<measure>`` for the slides without it, and counts. One shuffle, by deck."""
    mean = lambda c, name: _r(F.avg(c), 6).alias(name)
    known = ~F.col("slide_type").isin("", "unknown")
    hashes = F.flatten(F.collect_list("hashes"))
    g = measures.groupBy("deck_id").agg(
        mean("titled", "title_coverage"), *[mean(c, c) for c in MEANS], *[F.count_if(F.col(c).isNull()).cast("int").alias(f"missing_{c}") for c in MEANS],
        _r(F.stddev_pop("text_density"), 6).alias("content_density_variation"), *content.structure_aggregates(), _r(F.try_divide(F.sum("n_filler"), F.sum("n_blocks")), 6).alias("generic_filler_ratio"),
        mean("balance", "text_visual_balance"), F.count_if(F.col("balance") < WEAK_BALANCE).cast("int").alias("n_unbalanced"), mean("coverage", "visual_coverage"), mean("space", "space_usage"),
        mean(known.cast("int"), "slide_type_coverage"), mean("visibility", "evidence_visibility"), F.count("text_hash").alias("__texts"), F.size(F.collect_set("text_hash")).alias("__distinct"),
        F.avg("relevance").alias("__relevance"), F.size(hashes).alias("__files"), F.size(F.array_distinct(hashes)).alias("__unlike"), F.sum("n_evidence").cast("int").alias("n_evidence_images"), *content.flow_aggregates(),
    )
    repeats = F.coalesce(F.try_divide(F.col("__files") - F.col("__unlike"), F.col("__files")), F.lit(0.0))
    g = g.withColumns({
        "duplicate_content": _r(F.try_divide(F.col("__texts") - F.col("__distinct"), F.col("__texts")), 6),
        "visual_relevance_coherence": _r(F.col("__relevance") * (1.0 - 0.15 * repeats), 6),
    })
    keep = [c for c in g.columns if not c.startswith("__") and not c.startswith("at_") and c not in ("first", "last", "flow_signal")]
    flow = content.flow_scores(g, [*keep])
    n = len(content.PHASES)
    return flow.withColumnRenamed("coverage", "__c").withColumns({"narrative_flow": F.col("flow"), "n_phases_missing": (n - _r(F.col("__c") * n)).cast("int")}).drop("__c", "ordered", "opening", "closing", "flow")


def _record(score: Column, missing: Column, confidence: Column | None = None) -> Column:
    """A component's score of 100, its confidence, and how many pieces of evidence it lacks; a null score has no confidence."""
    sure = F.when(score.isNotNull(), F.when(missing > 0, 0.75).otherwise(1.0)) if confidence is None else confidence
    return F.struct(_r(score, 6).alias("score"), sure.alias("confidence"), missing.cast("int").alias("n_missing")).cast(_SCORE)


def component_scores() -> dict[str, Column]:
    """The components of a deck's quality from the columns of ``deck_metrics``."""
    c, none = F.col, F.lit(0)
    filler = F.least(F.lit(8.0), 10.0 * F.coalesce(c("generic_filler_ratio"), F.lit(0.0)))
    structure = F.greatest(F.lit(0.0), 100.0 * c("structure_score") - filler)
    readable = 100.0 * (0.35 * c("title_coverage") + 0.25 * (1.0 - c("small_text_ratio")) + 0.20 * (1.0 - c("overlap_ratio")) + 0.20 * (1.0 - c("clipping_rate")))
    spread = 1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("content_density_variation")) / DENSITY_SPREAD)
    layout = 100.0 * (0.60 * _clip(c("space_usage")) + 0.20 * spread + 0.20 * (1.0 - _clip(c("overlap_ratio"))))
    whole = c("space_usage").isNotNull() & c("content_density_variation").isNotNull() & c("overlap_ratio").isNotNull()
    lacks = sum([c(k).isNull().cast("int") for k in ("space_usage", "content_density_variation", "overlap_ratio")], none)
    return {
        "text_visual_balance": _record(100.0 * c("text_visual_balance"), c("n_unbalanced")),
        "content_structure": _record(structure, none),
        "readability": _record(readable, F.when(readable.isNotNull(), c("missing_small_text_ratio") + c("missing_overlap_ratio") + c("missing_clipping_rate")).otherwise(0)),
        "narrative_flow": _record(100.0 * c("narrative_flow"), c("n_phases_missing")),
        "visual_relevance_coherence": _record(100.0 * c("visual_relevance_coherence"), none),
        "layout_space_usage": _record(F.when(whole, layout), lacks, F.when(whole, 1.0)),
    }


def group_score(components: dict, points: dict[str, float], per_missing: float = MISSING_POINTS) -> Column:
    """STRUCT<score, confidence, unpenalized, penalty> of weighted components (``_record``); null if a weighted one has no score.

    A component loses ``per_missing`` for each piece of evidence it lacks, down to 0.
    """
    total = sum(points.values())
    weights = {k: v / total for k, v in points.items() if v > 0}
    whole, score, sure, off = F.lit(True), F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k, w in weights.items():
        r = components[k]
        lost = F.least(r["score"], per_missing * F.coalesce(r["n_missing"], F.lit(0)))
        whole, score, sure, off = whole & r["score"].isNotNull(), score + w * (r["score"] - lost), sure + w * F.coalesce(r["confidence"], F.lit(0.0)), off + w * lost
    some = lambda v: F.when(F.coalesce(whole, F.lit(False)), _r(v, 6))
    return F.struct(some(score).alias("score"), some(sure).alias("confidence"), some(score + off).alias("unpenalized"), some(off).alias("penalty"))


def evaluated(metrics: DataFrame, answers: DataFrame | None = None, per_missing: float = MISSING_POINTS) -> DataFrame:
    """(deck_id, proposal, deck_quality, final STRUCT<score, confidence>, status): the scores of every deck.

    answers: (deck_id, scores MAP<STRING, STRUCT<score, confidence, n_missing>>,
    rendered BOOLEAN, penalty_points DOUBLE), one row a deck, for instance from a
    scoring model. They give the proposal's components; a deck's own components
    and its penalty are taken from them only if they were given on all of its
    rendered slides. Without an answer a deck has no proposal score and no final
    score, and its status is REVIEW.
    """
    if answers is None:
        d = metrics.withColumns({"scores": F.lit(None).cast(f"map<string,{_SCORE}>"), "rendered": F.lit(False), "penalty_points": F.lit(0.0)})
    else:
        d = metrics.join(answers.select("deck_id", F.col("scores").cast(f"map<string,{_SCORE}>").alias("scores"), F.coalesce("rendered", F.lit(False)).alias("rendered"), F.coalesce("penalty_points", F.lit(0.0)).alias("penalty_points")), "deck_id", "left")
    given = lambda k: F.try_element_at("scores", F.lit(k))
    own = component_scores()
    seen = F.coalesce("rendered", F.lit(False))
    parts = {k: given(k) for k in PROPOSAL} | {k: F.when(seen & given(k)["score"].isNotNull(), given(k)).otherwise(v) for k, v in own.items()}
    fields = ("score", "confidence", "n_missing")
    # flat columns, so that a group's sum doesn't hold a component's expression several times
    d = d.withColumns({f"__{k}_{f}": v[f] for k, v in parts.items() for f in fields})
    flat = {k: {f: F.col(f"__{k}_{f}") for f in fields} for k in parts}
    d = d.select("deck_id", F.when(seen, F.col("penalty_points")).otherwise(0.0).alias("off"), group_score(flat, PROPOSAL, per_missing).alias("proposal"), group_score(flat, DECK, per_missing).alias("deck_quality"))
    points = _r(F.col("deck_quality.score") * DECK_WEIGHT, 6)
    d = d.withColumn("deck_quality", F.col("deck_quality").withField("score", _r(F.greatest(F.lit(0.0), points - F.col("off")) / DECK_WEIGHT, 6)))
    final = _r(F.col("proposal.score") * PROPOSAL_WEIGHT, 6) + _r(F.col("deck_quality.score") * DECK_WEIGHT, 6)
    sure = PROPOSAL_WEIGHT * F.col("proposal.confidence") + DECK_WEIGHT * F.col("deck_quality.confidence")
    both = F.struct(_r(final, 6).alias("score"), F.when(final.isNotNull(), _r(sure, 6)).alias("confidence"))
    return d.select("deck_id", "proposal", "deck_quality", both.alias("final"), F.when(final.isNull(), "REVIEW").otherwise("SCORED").alias("status"))


def prototype_links(links: DataFrame) -> DataFrame:
    """(deck_id, n_links, n_prototype_links) of each deck's distinct external targets."""
    hit = F.lit(False)
    for t in PROTOTYPE_TERMS:
        hit = hit | F.contains(F.lower("target"), F.lit(t))
    return links.groupBy("deck_id").agg(F.count("*").alias("n_links"), F.count_if(hit).alias("n_prototype_links"))


def slide_measures(objects: DataFrame) -> DataFrame:
    """(deck_id, slide_number, MEANS..., whitespace_balance, ...) of every slide from its content objects.

    objects: (deck_id, slide_number, object_id, type, text, x, y, w, h, font_size,
    excluded BOOLEAN). Areas are union areas of boxes clipped to the slide; text
    is small below 10 points. A slide of excluded objects only is empty.
    """
    slide = F.concat_ws("/", "deck_id", "slide_number")
    o = objects.withColumn("slide", slide).where("not coalesce(excluded, false)")
    positive = "w > 0 and h > 0"
    area = lambda d, name: geometry.union_area(d.where(positive)).select("slide", F.col("union_area").alias(name))
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    pictures = o.where(F.col("type").isin("image", "chart", "smartart", "table"))
    boxes = o.select("slide", F.col("object_id").alias("id"), "x", "y", "w", "h")
    overlap = geometry.overlap_pairs(boxes).groupBy("slide").agg(F.sum("intersection").alias("__overlap"))
    clipped = geometry.clipping(boxes).groupBy("slide").agg(F.count("*").alias("__clipped"))
    empty = geometry.empty_regions(boxes, 1).select("slide", F.col("area").alias("largest_empty_region_ratio"))
    white = geometry.whitespace_balance(boxes).select("slide", F.col("balance").alias("whitespace_balance"))
    small = F.when((F.col("type") == "text") & has_text, (F.coalesce("font_size", F.lit(99.0)) < 10).cast("int"))
    base = objects.withColumn("slide", slide).groupBy("slide", "deck_id", "slide_number").agg(F.count_if(~F.coalesce("excluded", F.lit(False))).alias("n_objects"))
    j = base.join(o.groupBy("slide").agg(F.avg(small).alias("__small")), "slide", "left")
    for d in (area(o, "__occupied"), area(o.where(has_text), "__text"), area(pictures, "__visual"), overlap, clipped, empty, white):
        j = j.join(d, "slide", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "deck_id", "slide_number", _clip(z("__text")).alias("text_density"), z("__small").alias("small_text_ratio"), _r(F.least(F.lit(1.0), z("__overlap") / F.greatest(z("__occupied"), F.lit(1e-9))), 6).alias("overlap_ratio"),
        _r(_clip(z("__clipped") / F.greatest(F.col("n_objects"), F.lit(1))), 6).alias("clipping_rate"), z("__occupied").alias("occupied_area_ratio"), _r(1.0 - z("__occupied"), 6).alias("whitespace_area_ratio"),
        "largest_empty_region_ratio", "whitespace_balance", z("__visual").alias("visual_area_ratio"),
    )
