"""Checking, gating and reusing the answers of optional models, and findings about scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics

#: What a text recogniser's status may be, and the enumerations and limits of a vision answer.
OCR_STATUSES = ("ok", "ocr_unavailable", "ocr_failed")
IMAGE_ROLES = ("diagram", "screenshot", "chart", "evidence_image", "logo", "decorative_image", "unknown")
DIRECTIONS = ("left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top", "unknown")
BOX_STATUSES = ("verified", "partial", "unverified")
VISION_FIELDS = ("schema_version", "image_role", "summary", "slide_reading_order", "diagram_flow_direction", "flow_present", "nodes", "edges", "observations")
VISION = (
    "struct<schema_version:string,image_role:string,summary:string,slide_reading_order:string,diagram_flow_direction:string,flow_present:boolean,nodes:array<struct<id:string,label:string,bbox:array<double>,status:string>>,"
    "edges:array<struct<source:string,target:string,label:string,direction:string,status:string>>,observations:array<struct<type:string,objects:array<string>,description:string,confidence:double>>>"
)
#: Score below which something is weak and from which it is strong; limits of the diagnostics.
WEAK, STRONG, FEW_VISUALS, POOR_SPACE, MUCH_FILLER = 60.0, 85.0, 0.35, 0.65, 0.25
#: Titles of findings.
NOT_SCORED, GAP, SCORED, VISUALS, SPACE, FILLED, NO_PROPOSAL = " not scored", "Evidence gap: ", "%s: %.0f/100", "Limited visual support", "Unbalanced space usage", "Generic filler detected", "Proposal strength not assessed"


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def ocr_errors(results: DataFrame) -> DataFrame:
    """``results`` (status, words, lines ARRAY<STRUCT<text, x, y, w, h, confidence>>, confidence) with ``errors``: what makes a recogniser's result unusable; empty for a usable one."""
    broken = lambda items: F.exists(items, lambda i: ~_finite(F.coalesce(i["x"] + i["y"] + i["w"] + i["h"], F.lit(0.0))) | ~_finite(F.coalesce(i["confidence"], F.lit(0.0))))
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("status").isin(*OCR_STATUSES), F.lit(False)), "status"), F.when(F.col("words").isNull() | F.col("lines").isNull(), "collections"),
        F.when(F.col("confidence").isNotNull() & ~(_finite(F.col("confidence")) & F.col("confidence").between(0.0, 1.0)), "confidence"), F.when(F.coalesce(broken("words") | broken("lines"), F.lit(False)), "not_finite"),
    ))
    return results.withColumn("errors", errors)


def vision_errors(answers: DataFrame, json: str = "response", version: str = "1", most_nodes: int = 200, most_edges: int = 400, most_observations: int = 100) -> DataFrame:
    """``answers`` with ``errors`` (what breaks the contract of a vision answer, empty for a usable one) and ``answer``, the parsed one.

    Fields must be exactly those of the contract, ids of nodes unique, edges
    between them, boxes four shares of the slide, confidences within 0 and 1.
    """
    a = answers.withColumns({"answer": F.when(F.json_object_keys(F.col(json)).isNotNull(), F.from_json(F.col(json), VISION)), "__keys": F.json_object_keys(F.col(json))})
    x = F.col("answer")
    want = F.array(*[F.lit(k) for k in VISION_FIELDS])
    share = lambda b: b.isNotNull() & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull() & v.between(0.0, 1.0))
    ids = F.transform(x["nodes"], lambda n: n["id"])
    ok = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "fields": ok((F.size(F.array_except(want, "__keys")) == 0) & (F.size(F.array_except("__keys", want)) == 0)), "version": ok(x["schema_version"] == version), "role": ok(x["image_role"].isin(*IMAGE_ROLES)),
        "direction": ok(x["slide_reading_order"].isin(*DIRECTIONS) & x["diagram_flow_direction"].isin(*DIRECTIONS)), "summary": x["summary"].isNotNull(),
        "limits": ok((F.size(x["nodes"]) <= most_nodes) & (F.size(x["edges"]) <= most_edges) & (F.size(x["observations"]) <= most_observations)),
        "node_ids": ok((F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda i: i.isNotNull() & (i != ""))),
        "nodes": ok(F.forall(x["nodes"], lambda n: n["label"].isNotNull() & F.coalesce(n["status"].isin(*BOX_STATUSES), F.lit(False)) & share(n["bbox"]))),
        "edges": ok(F.forall(x["edges"], lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]) & F.coalesce(e["direction"].isin(*DIRECTIONS) & e["status"].isin(*BOX_STATUSES), F.lit(False)) & e["label"].isNotNull())),
        "observations": ok(F.forall(x["observations"], lambda o: o["type"].isNotNull() & o["description"].isNotNull() & o["objects"].isNotNull() & F.coalesce(o["confidence"].between(0.0, 1.0), F.lit(False)))),
    }
    errors = F.array_compact(F.array(*[F.when(~v, k) for k, v in rules.items()]))
    return a.withColumn("errors", F.when(x.isNull() | F.col("__keys").isNull(), F.array(F.lit("not_json"))).otherwise(errors)).drop("__keys")


def promoted(answers: DataFrame, least: float = 0.75) -> DataFrame:
    """``answers`` (answer, errors, n_dropped) with ``status``: verified for a diagram of which all nodes and edges are verified, with enough mean confidence and nothing dropped; else partial; failed with errors."""
    x = F.col("answer")
    every = lambda c: F.coalesce(F.forall(c, lambda i: i["status"] == "verified"), F.lit(False))
    seen = F.transform(x["observations"], lambda o: o["confidence"])
    mean = F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, v: a + v), F.size(seen))
    whole = (x["image_role"] == "diagram") & (F.size(x["nodes"]) > 0) & every(x["nodes"]) & every(x["edges"]) & (mean >= least) & (F.coalesce("n_dropped", F.lit(0)) == 0)
    return answers.withColumn("status", F.when(F.size("errors") > 0, "failed").when(F.coalesce(whole, F.lit(False)), "verified").otherwise("partial"))


def open_circuit(requests: DataFrame, keys: list[str], order: str, failed: str, limit: int = 3) -> DataFrame:
    """``requests`` with ``allowed``: false once ``limit`` requests in a row have failed before; the circuit stays open for the rest of the run."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    run = w.rowsBetween(-limit, -1)
    tripped = (F.count("*").over(run) == limit) & (F.sum(F.col(failed).cast("int")).over(run) == limit)
    d = requests.withColumn("__t", tripped.cast("int"))
    return d.withColumn("allowed", ~((F.coalesce(F.max("__t").over(before), F.lit(0)) == 1) | (F.col("__t") == 1))).drop("__t")


def cache_misses(inputs: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """The distinct inputs whose hash the cache lacks: what still has to be asked."""
    return inputs.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def reused(inputs: DataFrame, cache: DataFrame, fresh: DataFrame, key: str = "content_hash") -> DataFrame:
    """Every input with its answer, from the cache or the fresh answers, and ``cache_hit``; null where neither has one."""
    old = cache.dropDuplicates([key]).withColumn("cache_hit", F.lit(True))
    new = fresh.dropDuplicates([key]).join(old.select(key), key, "left_anti").withColumn("cache_hit", F.lit(False))
    return inputs.join(old.unionByName(new, allowMissingColumns=True), key, "left")


def ocr_gate(images: DataFrame, least_pixels: int = 64, largest: int = 20_000_000) -> DataFrame:
    """``images`` (content_type, width, height, size) with ``skip``: why a recogniser needn't see one, null if it should."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    skip = F.when(~kind.rlike("^image/(png|jpe?g|gif|bmp|webp|tiff)$"), "unsupported_type").when(F.col("width").isNull() | F.col("height").isNull(), "unknown_size")
    return images.withColumn("skip", skip.when(F.least("width", "height") < least_pixels, "too_small").when(F.col("size") > largest, "too_large"))


def unique_refs(records: DataFrame, keys: list[str], refs: str) -> DataFrame:
    """(keys, refs): the distinct references of a group's records in order; nulls and blanks don't count."""
    r = records.select(*keys, F.explode(refs).alias("r")).where("r is not null and trim(r) <> ''").distinct()
    return r.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias(refs))


def findings(metric_rows: DataFrame, proposal: DataFrame | None = None) -> DataFrame:
    """(deck_id, kind, category, title, value): what is strong, weak or unknown about each deck.

    Components without a score are ambiguous; with missing evidence or below WEAK
    they are weak, from STRONG on strong. Few visuals, poor use of space and much
    filler are weak besides. proposal: (deck_id, scores MAP) as for
    ``metrics.evaluated``; a deck without it has one ambiguous finding more.
    """
    parts = F.map_from_arrays(F.array(*[F.lit(k) for k in metrics.DECK]), F.array(*metrics.component_scores().values()))
    d = metric_rows.select("deck_id", "visual_coverage", "space_usage", "generic_filler_ratio", parts.alias("own"))
    kind = lambda r: F.when(r["score"].isNull(), "ambiguous").when((r["n_missing"] > 0) | (r["score"] < WEAK), "weakness").when(r["score"] >= STRONG, "strength")
    title = lambda k, r: F.when(r["score"].isNull(), F.concat(k, F.lit(NOT_SCORED))).when(r["n_missing"] > 0, F.concat(F.lit(GAP), k)).otherwise(F.format_string(SCORED, k, r["score"]))

    def listed(rows, scores):
        e = rows.select("deck_id", F.explode(scores).alias("category", "r"))
        name = F.concat(F.upper(F.substring("category", 1, 1)), F.replace(F.expr("substring(category, 2)"), F.lit("_"), F.lit(" ")))
        return e.select("deck_id", kind(F.col("r")).alias("kind"), "category", title(name, F.col("r")).alias("title"), F.col("r.score").alias("value")).where("kind is not null")

    diagnostics = F.array_compact(F.array(
        F.when(F.col("visual_coverage") < FEW_VISUALS, F.struct(F.lit("visual_coverage").alias("category"), F.lit(VISUALS).alias("title"), F.col("visual_coverage").alias("value"))),
        F.when(F.col("space_usage") < POOR_SPACE, F.struct(F.lit("space_usage").alias("category"), F.lit(SPACE).alias("title"), F.col("space_usage").alias("value"))),
        F.when(F.col("generic_filler_ratio") >= MUCH_FILLER, F.struct(F.lit("deck_quality").alias("category"), F.lit(FILLED).alias("title"), F.col("generic_filler_ratio").alias("value"))),
    ))
    out = listed(d, "own").unionByName(d.select("deck_id", F.explode(diagnostics).alias("f")).select("deck_id", F.lit("weakness").alias("kind"), "f.*"))
    none = lambda rows: rows.select("deck_id", F.lit("ambiguous").alias("kind"), F.lit("proposal_strength").alias("category"), F.lit(NO_PROPOSAL).alias("title"), F.lit(None).cast("double").alias("value"))
    if proposal is None:
        return out.unionByName(none(d))
    given = proposal.select("deck_id", F.map_filter("scores", lambda k, v: k.isin(*metrics.PROPOSAL)).alias("s"))
    return out.unionByName(listed(given, "s")).unionByName(none(d.join(given.where(F.col("s").isNotNull()), "deck_id", "left_anti")))


def limited(found: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` findings of each deck and kind: weaknesses from the worst, strengths from the best score."""
    order = F.when(F.col("kind") == "strength", -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("deck_id", "kind").orderBy(order.asc_nulls_last(), "category", "title")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
