"""The engine's queries, each over whole tables; ``oracle`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as tx
from ..functions.ship import shipped
from ..operators import accuracy, content, evidence, geometry, matching, metrics, responses, scoring
from ..sources import reports
from ..sources.tables import norm_hash, table
from .oracle import SQL

#: Parameters of the queries: thresholds and weights are data of the caller.
BUCKETS = {"A - Excellent": 85.0, "B - Strong": 70.0, "C - Promising": 55.0}
LOWEST = "D - Needs work"
#: Where the time of the scorings is parted for the merge.
HALF = "2025-06-20"
WEIGHTS = {"proposal": 70.0, "deck": 30.0}
STAGES = ["native", "rendered", "ocr", "vision"]


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes for the layout operators: a label is a slide, a vector a box."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    return table(s, d, "embeddings").select(F.col("label").alias("slide"), F.col("vec_id").alias("id"), (0.5 + e(1)).alias("x"), (0.5 + e(2)).alias("y"), F.abs(e(3)).alias("w"), F.abs(e(4)).alias("h"))


def _blocks(s, d):
    return content.blocks(table(s, d, "slides"))


def _latest(s, d):
    """Each submission's latest scoring."""
    return scoring.latest(table(s, d, "submissions"), ["ps_id", "submission_id"], "scored_at", ["final_score", "proposal_score", "deck_quality_score", "status", "deck_id"])


def overlap_pairs(s, d):
    return geometry.overlap_pairs(_boxes(s, d))


def alignment_mismatch(s, d):
    return geometry.alignment_mismatch(_boxes(s, d))


def union_area(s, d):
    return geometry.union_area(_boxes(s, d))


def empty_regions(s, d):
    return geometry.empty_regions(_boxes(s, d))


def margins(s, d):
    return geometry.margins(_boxes(s, d))


def clipping(s, d):
    b = _boxes(s, d)
    return geometry.clipping(b.withColumns({"w": F.col("w") * 4, "h": F.col("h") * 4}))


def whitespace_balance(s, d):
    return geometry.whitespace_balance(_boxes(s, d))


def alignment_groups(s, d):
    return geometry.alignment_groups(_boxes(s, d))


def equal_spacing(s, d):
    return geometry.equal_spacing(_boxes(s, d))


def peer_groups(s, d):
    return geometry.peer_groups(_boxes(s, d))


def nearest_box(s, d):
    return geometry.nearest_box(_boxes(s, d))


def box_reading_order(s, d):
    return geometry.reading_order(_boxes(s, d))


def text_profile(s, d):
    return content.text_profile(_blocks(s, d))


def content_structure(s, d):
    return content.content_structure(table(s, d, "slides"))


def filler_ratio(s, d):
    return content.filler_ratio(table(s, d, "slides"))


def filler_terms(s, d):
    """Phrases of filler and broad claims by the blocks that hold them."""
    return content.term_counts(_blocks(s, d), [*content.FILLER, *content.BROAD])


def ambiguous_claims(s, d):
    return content.ambiguous_claims(_blocks(s, d))


def narrative_flow(s, d):
    return content.narrative_flow(table(s, d, "slides"))


def slide_types(s, d):
    """Slides by the kind that their text tells."""
    return content.slide_kinds(table(s, d, "slides")).groupBy("slide_type").agg(F.count("*").alias("n_slides"), F.count_distinct("deck_id").alias("n_decks"))


def duplicate_content(s, d):
    return content.duplicate_content(table(s, d, "slides"))


def weighted_median_words(s, d):
    """Per deck the number of words of a block at which half of the characters are reached."""
    return content.weighted_median(content.text_profile(_blocks(s, d)), ["deck_id"], "words", "chars")


def evidence_visibility(s, d):
    return content.evidence_visibility(table(s, d, "slides"), STAGES)


def link_dedup(s, d):
    return content.links(table(s, d, "slides"))


def slide_titles(s, d):
    """The first non-blank block of each slide, cut to 40 characters."""
    b = _blocks(s, d).groupBy("slide_key").agg(F.min_by("text", "block_no").alias("t"))
    return b.select("slide_key", tx.brief(F.col("t"), 40).alias("title"))


def media_registry(s, d):
    """Assets of a deck numbered by part name."""
    a = table(s, d, "assets").select("deck_id", "asset_id", "part_name", norm_hash(F.col("sha256")).alias("file_hash")).distinct()
    r = scoring.ranked(a, "deck_id", [F.col("part_name"), F.col("asset_id")], F.lit(True), "n")
    return r.select("deck_id", "asset_id", F.format_string("asset-%04d", "n").alias("ordinal_id"), "file_hash")


def repeated_media(s, d):
    """Files in more than one deck, with their uses."""
    a = table(s, d, "assets").dropDuplicates(["deck_id", "asset_id"]).select("deck_id", norm_hash(F.col("sha256")).alias("file_hash")).where("file_hash is not null")
    per = a.groupBy("file_hash", "deck_id").agg(F.count("*").alias("n"))
    return per.groupBy("file_hash").agg(F.count("*").alias("n_decks"), F.sum("n").alias("n_uses")).where("n_decks > 1")


def media_relevance(s, d):
    """Per deck the share of its files that repeat another, and the score that this leaves."""
    a = table(s, d, "assets").dropDuplicates(["deck_id", "asset_id"]).select("deck_id", norm_hash(F.col("sha256")).alias("h")).where("h is not null")
    g = a.groupBy("deck_id", "h").agg(F.count("*").alias("n")).groupBy("deck_id").agg(F.sum("n").alias("n_files"), F.sum(F.col("n") - 1).alias("n_repeats"))
    r = F.col("n_repeats") / F.col("n_files")
    return g.select("deck_id", "n_files", F.round(r, 6).alias("repeat_ratio"), F.round(1 - 0.15 * r, 6).alias("relevance"))


def media_types(s, d):
    """Most frequent content type of each deck; ties go to the first by name."""
    a = table(s, d, "assets").dropDuplicates(["deck_id", "asset_id"]).where("content_type is not null")
    g = a.groupBy("deck_id", "content_type").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    m = g.groupBy("deck_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "content_type")).alias("m"), F.count("*").alias("n_types"), F.sum("bytes").alias("bytes"))
    return m.select("deck_id", F.col("m.content_type").alias("content_type"), "n_types", "bytes")


def noise_reasons(s, d):
    """Why an asset isn't worth a look: reasons in a fixed order, assets without one left out."""
    a = table(s, d, "assets").dropDuplicates(["deck_id", "asset_id"]).withColumn("h", norm_hash(F.col("sha256")))
    uses = a.where("h is not null").groupBy("h", "deck_id").agg(F.lit(1).alias("x")).groupBy("h").agg(F.count("*").alias("n_decks")).where("n_decks >= 5")
    j = a.join(uses, "h", "left")
    reasons = F.concat_ws(",", F.when(F.col("size_bytes") < 20000, "small"), F.when(F.col("n_decks") >= 5, "repeated"), F.when(F.col("h").isNull(), "no_hash"), F.when(F.col("content_type").isNull(), "no_type"))
    return j.select("deck_id", "asset_id", reasons.alias("reasons")).where("reasons <> ''")


def problem_ids(s, d):
    """Statement ids as read from decks, normalised, with the slug of the deck's name."""
    x = table(s, d, "decks").select("deck_id", "deck_name", "ps_id").distinct()
    return x.select("deck_id", tx.problem_id(F.col("ps_id")).alias("ps_norm"), tx.slug(F.col("deck_name"), "deck").alias("slug"))


def problem_resolver(s, d):
    """Decks by whether their normalised statement id has a statement."""
    x = table(s, d, "decks").select("deck_id", tx.problem_id(F.col("ps_id")).alias("k")).distinct()
    p = table(s, d, "problems").select(tx.problem_id(F.col("ps_id")).alias("k"), "title").distinct()
    j = x.join(p, "k", "left")
    return j.groupBy("k").agg(F.count("*").alias("n_decks"), F.max("title").alias("title"), F.max(F.when(F.col("title").isNull(), "unresolved").otherwise("resolved")).alias("state"))


def _named_decks(s, d):
    """(deck_id, deck_name, text) of every deck that has a record or slides."""
    k = table(s, d, "decks").dropDuplicates(["deck_id"]).select("deck_id", "deck_name")
    return k.join(content.deck_texts(table(s, d, "slides")), "deck_id", "full")


def inferred_problem(s, d):
    """The statement id of every deck: as its slides' text names it, else its file's name, else UNASSIGNED."""
    return _named_decks(s, d).select("deck_id", tx.named_problem(F.col("text"), F.col("deck_name")).alias("ps_inferred"))


def inferred_team(s, d):
    """The team of every deck: as its slides' text names it, else its file's name without suffix."""
    return _named_decks(s, d).select("deck_id", tx.named_team(F.col("text"), F.col("deck_name")).alias("team"))


def problem_weights(s, d):
    p = table(s, d, "problems").dropDuplicates(["problem_key"])
    return scoring.normalised_weights(p)


def leaderboard(s, d):
    """Every submission's latest scoring with bucket and place within its statement."""
    x = _latest(s, d).withColumns({c: scoring.finite(F.col(c)) for c in ("final_score", "proposal_score", "deck_quality_score")})
    eligible = F.col("final_score").isNotNull() & (F.col("status") != "failed")
    zero = [F.coalesce(c, F.lit(0.0)).desc() for c in ("final_score", "proposal_score", "deck_quality_score")]
    r = scoring.ranked(x, "ps_id", [*zero, F.lower("submission_id"), F.col("submission_id")], F.coalesce(eligible, F.lit(False)))
    return r.select("ps_id", "submission_id", "final_score", scoring.bucket(F.col("final_score"), BUCKETS, LOWEST, "REVIEW").alias("bucket"), "place")


def leaderboard_lines(s, d):
    """Every submission's line of its statement's leaderboard."""
    b = leaderboard(s, d).join(_latest(s, d).select("ps_id", "submission_id", "status"), ["ps_id", "submission_id"])
    line = reports.board_line(F.col("place"), F.col("submission_id"), F.col("ps_id"), F.col("bucket"), F.col("final_score"), F.col("status"))
    return b.select("ps_id", "submission_id", line.alias("line"))


def bucket_counts(s, d):
    return leaderboard(s, d).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("final_score"), 4).alias("mean_score"))


def score_summary(s, d):
    """Spread of a statement's final scores."""
    x = _latest(s, d).withColumn("f", scoring.finite(F.col("final_score")))
    g = x.groupBy("ps_id").agg(F.count("*").alias("n"), F.count("f").alias("n_scored"), F.avg("f").alias("a"), F.stddev_pop("f").alias("sd"), F.median("f").alias("m"), F.min("f").alias("lowest"), F.max("f").alias("highest"))
    return g.select("ps_id", "n", "n_scored", F.round("a", 4).alias("mean_score"), F.round("sd", 4).alias("deviation"), F.round("m", 4).alias("median_score"), "lowest", "highest")


def weighted_group(s, d):
    """Proposal and deck scores of each submission as one weighted score; each missing team name costs points."""
    x = scoring.latest(table(s, d, "submissions"), ["ps_id", "submission_id"], "scored_at", ["proposal_score", "deck_quality_score", "team"])
    parts = F.array(F.struct(F.lit("proposal").alias("component"), scoring.finite(F.col("proposal_score")).alias("v")), F.struct(F.lit("deck").alias("component"), scoring.finite(F.col("deck_quality_score")).alias("v")))
    long = x.select("ps_id", "submission_id", "team", F.explode(parts).alias("p")).select("ps_id", "submission_id", "team", "p.component", "p.v")
    return scoring.weighted_group(long, ["ps_id", "submission_id"], "component", "v", WEIGHTS, F.col("team").isNull().cast("int"))


def _calibration(s, d):
    x = _latest(s, d).select((scoring.finite(F.col("proposal_score")) / 100).alias("confidence"), scoring.finite(F.col("final_score")).alias("f")).where("f is not null")
    return x.select("confidence", (F.col("f") >= 60).alias("correct"))


def calibration_bins(s, d):
    return scoring.calibration_bins(_calibration(s, d), "confidence", "correct")


def calibration_error(s, d):
    return scoring.calibration_error(_calibration(s, d), "confidence", "correct")


def _next_slides(s, d):
    """Text of a slide and of the deck's next one."""
    x = content.once(table(s, d, "slides")).select("slide_key", "deck_id", "slide_number", F.coalesce(F.array_join("text", " "), F.lit("")).alias("t"))
    n = x.select("deck_id", (F.col("slide_number") - 1).alias("slide_number"), F.col("t").alias("u"))
    return x.join(n, ["deck_id", "slide_number"]).select("slide_key", "t", "u")


def word_prf(s, d):
    return matching.word_overlap(_next_slides(s, d), "slide_key", "t", "u")


def character_error(s, d):
    """Edit distance of a slide's first block to that of the deck's next slide, counted in code points."""
    b = _blocks(s, d).where("block_no = 0").select("slide_key", "deck_id", "slide_number", F.col("text").alias("t")).dropDuplicates(["slide_key"])
    n = b.select("deck_id", (F.col("slide_number") - 1).alias("slide_number"), F.col("t").alias("u"))
    return matching.character_error(b.join(n, ["deck_id", "slide_number"]), "slide_key", "t", "u")


def completeness(s, d):
    """Decks without any file, and decks of files that have no record."""
    return matching.completeness(table(s, d, "decks").select("deck_id"), table(s, d, "assets").select("deck_id"), ["deck_id"])


def contract_violations(s, d):
    """Rows that break a rule of the tables, by rule."""
    n = content.once(table(s, d, "slides")).groupBy("deck_id").agg(F.count("*").alias("n"))
    k = table(s, d, "decks").dropDuplicates(["deck_id"])
    x = k.join(n, "deck_id", "left")
    a = matching.violations(x, {"slide_count_differs": F.col("slide_count") != F.coalesce("n", F.lit(0)), "no_slides": F.col("n").isNull(), "no_slide_count": F.col("slide_count").isNull(), "no_statement": F.col("ps_id").isNull()}, ["deck_id"])
    orphans = table(s, d, "assets").select("deck_id").distinct().join(k.select("deck_id"), "deck_id", "left_anti").select(F.lit("asset_without_deck").alias("rule"), "deck_id")
    return a.unionByName(orphans).groupBy("rule").agg(F.count("*").alias("n"), F.min("deck_id").alias("first_deck"))


def upsert_scores(s, d):
    """Each submission's scores after the rows scored in the later half of the time were merged into those of the earlier half; a merged row replaces the older one."""
    x = scoring.latest(table(s, d, "submissions").withColumn("part", F.when(F.col("scored_at") < F.lit(HALF).cast("timestamp_ntz"), 0).otherwise(1)), ["ps_id", "submission_id", "part"], "scored_at", ["final_score", "status"])
    side = lambda n: x.where(F.col("part") == n).select("ps_id", "submission_id", "scored_at", scoring.finite(F.col("final_score")).alias("final_score"), "status")
    m = matching.upsert(side(0), side(1), ["ps_id", "submission_id"])
    return matching.upsert(m, side(1), ["ps_id", "submission_id"])


def as_of_view(s, d):
    """Each purchase with the value of the user's last view before or at its time."""
    e = table(s, d, "events")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", F.col("value").alias("paid"))
    v = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return matching.as_of(p, v, "user_id", "ts", "value", "seen").select("event_id", F.round("paid", 6).alias("paid"), F.round("seen", 6).alias("seen"))


def media_components(s, d):
    """Decks that share a file, directly or through others; a file links its decks to the least of them, so its links grow with its decks."""
    a = table(s, d, "assets").select("deck_id", norm_hash(F.col("sha256")).alias("h")).where("h is not null and deck_id is not null").distinct()
    n = a.groupBy("h").agg(F.count("*").alias("n"), F.min("deck_id").alias("u")).where("n >= 2")
    e = a.join(n, "h").select("u", F.col("deck_id").alias("v")).where("u < v")
    return matching.components(e, "u", "v").select(F.col("node").alias("deck_id"), "component")


def shared_hashes(s, d):
    """Set operations on the files of two source formats."""
    a = table(s, d, "assets").select("deck_id", norm_hash(F.col("sha256")).alias("h")).where("h is not null")
    k = table(s, d, "decks").select("deck_id", F.lower("source_format").alias("f")).distinct()
    j = a.join(k, "deck_id").select("h", "f")
    x, y = j.where("f = 'pdf'").select("h"), j.where("f <> 'pdf'").select("h")
    sets = {"both": x.intersect(y), "pdf_only": x.exceptAll(y.distinct()).distinct().join(y.distinct(), "h", "left_anti"), "any": x.union(y).distinct()}
    out = None
    for name, q in sets.items():
        g = q.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = g if out is None else out.unionByName(g)
    return out


def grounding(s, d):
    """Share of a statement's requirements of which a word of six letters or more stands in its title or description."""
    p = table(s, d, "problems").dropDuplicates(["problem_key"]).select("ps_id", F.lower(F.concat_ws(" ", "title", "description")).alias("t"), F.explode("requirements").alias("r"))
    w = F.regexp_extract_all(F.lower("r.description"), F.lit("[a-z]{6,}"), F.lit(0))
    p = p.withColumn("ok", F.exists(w, lambda x: F.contains(F.col("t"), x)).cast("int"))
    return p.groupBy("ps_id").agg(F.count("*").alias("n_requirements"), F.round(F.avg("ok"), 6).alias("grounded"))


def deck_profile(s, d):
    """A deck's counts from three tables, each aggregated before it is joined."""
    k = table(s, d, "decks").dropDuplicates(["deck_id"]).select("deck_id", F.lower("source_format").alias("source_format"), F.coalesce("aspect_ratio", F.round(F.col("width") / F.nullif(F.col("height"), F.lit(0)), 12)).alias("aspect"))
    sl = content.once(table(s, d, "slides")).groupBy("deck_id").agg(F.count("*").alias("n_slides"), F.sum(F.when(F.size("text") > 0, F.size("text")).otherwise(0)).alias("n_blocks"))
    a = table(s, d, "assets").dropDuplicates(["deck_id", "asset_id"]).groupBy("deck_id").agg(F.count("*").alias("n_assets"), F.sum("size_bytes").alias("bytes"))
    j = k.join(sl, "deck_id", "left").join(a, "deck_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("deck_id", "source_format", F.round("aspect", 6).alias("aspect"), z("n_slides"), z("n_blocks"), z("n_assets"), z("bytes"))


def late_deliveries(s, d):
    """Rows by the days between scoring and loading."""
    x = table(s, d, "submissions").groupBy("ps_id", "submission_id", "scored_at").agg(F.min("loaded_at").alias("loaded_at"))
    days = F.datediff(F.col("loaded_at"), F.col("scored_at"))
    kind = F.when(F.col("loaded_at") < F.col("scored_at"), "before").when(days <= 1, "in time").when(days <= 7, "within a week").otherwise("late")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def event_windows(s, d):
    """Tumbling windows of an hour over the events, as the streaming query sums them."""
    from ..streaming.windows import windowed

    return windowed(table(s, d, "events"))


def event_sessions(s, d):
    """Sessions of a user's events with gaps of at most half an hour."""
    from ..streaming.windows import sessions

    return sessions(table(s, d, "events"))


def deck_flow(s, d):
    """Whether a deck shows a flow: true on any slide, else false on any, else unknown; with the first known direction."""
    x = content.once(table(s, d, "slides"))
    known = F.col("flow_direction").isNotNull() & (F.col("flow_direction") != "unknown")
    g = x.groupBy("deck_id").agg(F.bool_or("flow_present").alias("flow_present"), F.min(F.when(known, F.struct("slide_number", "flow_direction"))).alias("m"), F.count_if(known).alias("n_known"))
    return g.select("deck_id", "flow_present", F.col("m.flow_direction").alias("direction"), "n_known")


def merged_visibility(s, d):
    """Slides by the status that their four stages have together."""
    x = content.once(table(s, d, "slides")).select(evidence.merged_status(F.array(*[F.col(f"visibility.{k}") for k in STAGES])).alias("status"), "deck_id")
    return x.groupBy("status").agg(F.count("*").alias("n_slides"), F.count_distinct("deck_id").alias("n_decks"))


def stage_statuses(s, d):
    """Slides by stage and status."""
    x = content.once(table(s, d, "slides")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"visibility.{k}").alias("status")) for k in STAGES])).alias("v"))
    return x.groupBy("v.stage", "v.status").agg(F.count("*").alias("n"))


def positional_words(s, d):
    """Words of a slide that the deck's next slide has too, occurrence by occurrence."""
    n = _next_slides(s, d)
    side = lambda c: n.select("slide_key", F.posexplode(tx.words(F.lower(c))).alias("n", "text"))
    m = accuracy.positional_matches(side("t"), side("u"), ["slide_key"])
    return m.groupBy("slide_key").agg(F.count("*").alias("n_matched"), F.sum(F.abs(F.col("reference_n") - F.col("hypothesis_n"))).alias("shift"))


def statement_recall(s, d):
    """Requirements of a deck's statement of which the description stands in the deck's text."""
    k = table(s, d, "decks").select("deck_id", tx.problem_id(F.col("ps_id")).alias("k")).distinct()
    p = table(s, d, "problems").dropDuplicates(["problem_key"]).select(tx.problem_id(F.col("ps_id")).alias("k"), F.explode("requirements.description").alias("text"))
    return accuracy.text_recall(k.join(p, "k").select("deck_id", "text"), _blocks(s, d).select("deck_id", "text"), "deck_id")


def slide_labels(s, d):
    """Slides labelled like pages: two in small Roman numerals, the rest in numbers from 1 with a prefix."""
    x = content.once(table(s, d, "slides")).select("deck_id", F.col("slide_number").alias("page")).distinct()
    e = x.select("deck_id").distinct().select("deck_id", F.explode(F.array(F.struct(F.lit(1).alias("page"), F.lit("r").alias("style"), F.lit("").alias("prefix")), F.struct(F.lit(3).alias("page"), F.lit("D").alias("style"), F.lit("p").alias("prefix")))).alias("e"))
    return labels.page_labels(x, e.select("deck_id", "e.page", "e.style", "e.prefix", F.lit(1).alias("first")))


def selected_slides(s, d):
    """Slides of a selection, and the selected numbers that a deck lacks."""
    x = content.once(table(s, d, "slides")).select("deck_id", "slide_number").distinct()
    want = x.select("deck_id").distinct().select("deck_id", F.explode(labels.selection(F.lit("1-2, 5"))).alias("slide_number"))
    j = want.join(x.withColumn("there", F.lit(1)), ["deck_id", "slide_number"], "left")
    return j.groupBy("deck_id").agg(F.count("there").alias("n_there"), (F.count("*") - F.count("there")).alias("n_missing"))


def format_mismatch(s, d):
    """Decks by format and by whether the file's suffix says the same."""
    x = table(s, d, "decks").dropDuplicates(["deck_id"]).select(F.lower("source_format").alias("source_format"), F.lower(F.regexp_extract("deck_name", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"))
    return x.groupBy("source_format", (F.col("source_format") == F.col("suffix")).alias("same")).agg(F.count("*").alias("n"))


def findings(s, d):
    """What is strong, weak or unknown about each submission's latest scores."""
    x = _latest(s, d)
    parts = F.array(*[F.struct(F.lit(c).alias("name"), scoring.finite(F.col(c)).alias("v")) for c in ("final_score", "proposal_score", "deck_quality_score")])
    long = x.select(F.concat_ws("/", "ps_id", "submission_id").alias("submission"), F.explode(parts).alias("p")).select("submission", "p.name", "p.v")
    return responses.findings(long, "submission", "name", "v")


def _measures(s, d):
    """The slides as ``metrics`` wants them. The tables hold no boxes: text fills the slide in proportion to its length and a flow is a visual on a third of it."""
    x = table(s, d, "slides")
    texts = F.coalesce("text", F.array().cast("array<string>"))
    blocks = F.transform(texts, lambda t, i: F.struct(i.cast("string").alias("object_id"), t.alias("text"), *[F.lit(None).cast("double").alias(k) for k in "xywh"]))
    first = F.get(F.filter("blocks", lambda b: tx.squeeze(b["text"]) != ""), F.lit(0))
    density = F.least(F.lit(1.0), F.length(F.array_join("text", " ")) / 1200.0)
    x = x.withColumns({"blocks": blocks, "visible_text": F.coalesce(F.array_join("text", " "), F.lit("")), "statuses": F.array(*[F.col(f"visibility.{k}") for k in STAGES]), "text_density": F.round(density, 6)})
    kind = F.coalesce(content.first_match(F.lower(tx.squeeze(F.col("visible_text"))), content.SLIDE_TYPES), F.lit("content"))
    area = F.when(F.col("flow_present"), 0.3).otherwise(0.0)
    x = x.withColumns({"title_id": first["object_id"], "title": first["text"], "slide_type": kind, "visual_area_ratio": area, "whitespace_area_ratio": F.round(1.0 - F.col("text_density"), 6), "visuals": F.array().cast("array<struct<role:string,content_status:string,sha256:string,ocr_text:string,scoring_relevant:boolean,x:double,y:double,w:double,h:double>>"), "tables": F.array().cast("array<struct<object_id:string,x:double,y:double,w:double,h:double>>")})
    zero = {c: F.lit(0.0) for c in ("small_text_ratio", "overlap_ratio", "clipping_rate", "occupied_area_ratio")}
    x = x.withColumns(zero | {c: F.lit(None).cast("double") for c in ("largest_empty_region_ratio", "whitespace_balance")})
    return metrics.measured(x, ("slide_key",)).dropDuplicates(["slide_key"])


def deck_metrics(s, d):
    """The metrics of every deck."""
    m = metrics.deck_metrics(_measures(s, d))
    return m.select("deck_id", "title_coverage", "text_density", "missing_text_density", "content_density_variation", "structure_score", "generic_filler_ratio", "text_visual_balance", "n_unbalanced", "visual_coverage", "space_usage", "evidence_visibility", "duplicate_content", "visual_relevance_coherence", "narrative_flow", "n_phases_missing")


def deck_scores(s, d):
    """Components, group scores and final score of every deck; the proposal's components are its best proposal score."""
    m = metrics.deck_metrics(_measures(s, d))
    best = table(s, d, "submissions").select("deck_id", scoring.finite(F.col("proposal_score")).alias("p")).where("deck_id is not null").groupBy("deck_id").agg(F.max("p").alias("p"))
    record = F.struct(F.col("p").alias("score"), F.when(F.col("p").isNotNull(), 0.8).alias("confidence"), F.lit(0).alias("n_missing"))
    answers = best.select("deck_id", F.create_map(*[x for k in metrics.PROPOSAL for x in (F.lit(k), record)]).alias("scores"), F.lit(False).alias("rendered"), F.lit(0.0).alias("penalty_points"))
    e = metrics.evaluated(m, answers)
    return e.select("deck_id", F.col("proposal.score").alias("proposal_score"), F.col("deck_quality.score").alias("deck_score"), F.col("deck_quality.penalty").alias("deck_penalty"), F.col("deck_quality.confidence").alias("deck_confidence"), F.col("final.score").alias("final_score"), F.col("final.confidence").alias("final_confidence"), "status")


_QUERIES = (
    overlap_pairs, alignment_mismatch, union_area, empty_regions, margins, clipping, whitespace_balance, alignment_groups, equal_spacing, peer_groups, nearest_box, box_reading_order,
    text_profile, content_structure, filler_ratio, filler_terms, ambiguous_claims, narrative_flow, slide_types, duplicate_content, weighted_median_words, evidence_visibility, link_dedup, slide_titles,
    media_registry, repeated_media, media_relevance, media_types, noise_reasons, problem_ids, problem_resolver, inferred_problem, inferred_team, problem_weights, leaderboard, leaderboard_lines, bucket_counts,
    score_summary, weighted_group, calibration_bins, calibration_error, word_prf, character_error, completeness, contract_violations, upsert_scores, as_of_view, media_components, shared_hashes, grounding,
    deck_profile, late_deliveries, event_windows, event_sessions,
    deck_flow, merged_visibility, stage_statuses, positional_words, statement_recall, slide_labels, selected_slides, format_mismatch, findings,
    deck_metrics, deck_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
