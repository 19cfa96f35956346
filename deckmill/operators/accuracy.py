"""Agreement of extracted decks with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold
from .matching import components
from .scoring import prf


def positional_matches(reference: DataFrame, hypothesis: DataFrame, keys: list[str], text: str = "text", order: str = "n") -> DataFrame:
    """(keys, text, occurrence, reference_n, hypothesis_n): the k-th of equal words on one side goes with the k-th on the other; each is used once."""
    def numbered(d, name):
        w = Window.partitionBy(*keys, text).orderBy(order)
        return d.select(*keys, text, F.row_number().over(w).alias("occurrence"), F.col(order).alias(name))

    return numbered(reference, "reference_n").join(numbered(hypothesis, "hypothesis_n"), [*keys, text, "occurrence"])


def text_recall(expected: DataFrame, actual: DataFrame, key: str, text: str = "text", order: str | None = None) -> DataFrame:
    """(key, n_expected, n_found, recall): expected texts that are part of one of the key's texts, case and white space aside; nothing expected is 1.

    Each of the key's texts stands for one expected text: taken in order, an
    expected text uses up the first free one that holds it. Without ``order`` the
    texts themselves are the order. A key's texts are compared in one row.
    """
    def listed(d, name):
        f = d.select(key, fold(F.col(text)).alias("t"), (F.col(order) if order else F.lit(0)).alias("o")).where("t <> ''")
        return f.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("l")).select(key, F.transform("l", lambda x: x["t"]).alias(name))

    e, a = listed(expected, "e"), listed(actual, "a")
    every = expected.select(key).union(actual.select(key)).distinct().join(e, key, "left").join(a, key, "left")
    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce("a", none).alias("free"), F.lit(0).alias("n"))

    def step(acc, x):
        at = F.array_position(F.transform(acc["free"], lambda t: F.contains(t, x)), True)
        rest = F.filter(acc["free"], lambda t, i: i + 1 != at)
        return F.struct(F.when(at > 0, rest).otherwise(acc["free"]).alias("free"), (acc["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"))

    n, f = F.size(F.coalesce("e", none)), F.aggregate(F.coalesce("e", none), start, step, lambda acc: acc["n"])
    d = every.select(key, n.alias("n_expected"), f.alias("n_found"))
    return d.select(key, F.col("n_expected").cast("bigint").alias("n_expected"), F.col("n_found").cast("bigint").alias("n_found"), F.round(F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_expected")), 6).alias("recall"))


def edge_agreement(reference: DataFrame, predicted: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_expected, n_predicted, n_matched, precision, recall, f1, direction): verified predicted edges whose ends are matched nodes, against the labelled ones.

    An edge is matched whichever way it points; direction is the share of matches that point the same way.
    """
    m = nodes.select(*keys, F.col("hypothesis_id").alias("h"), F.col("reference_id").alias("r"))
    p = predicted.where("status = 'verified'").select(*keys, "source", "target").distinct()
    j = p.join(m.withColumnsRenamed({"h": "source", "r": "a"}), [*keys, "source"], "left").join(m.withColumnsRenamed({"h": "target", "r": "b"}), [*keys, "target"], "left")
    und = lambda x, y: [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]
    r = reference.select(*keys, *und("source", "target"), F.col("source").alias("rs")).dropDuplicates([*keys, "u", "v"])
    q = j.where("a is not null and b is not null").select(*keys, *und("a", "b"), F.col("a").alias("ps")).dropDuplicates([*keys, "u", "v"])
    hit = r.join(q, [*keys, "u", "v"]).groupBy(*keys).agg(F.count("*").alias("n_matched"), F.avg((F.col("rs") == F.col("ps")).cast("int")).alias("same"))
    ne, np_ = r.groupBy(*keys).agg(F.count("*").alias("n_expected")), p.groupBy(*keys).agg(F.count("*").alias("n_predicted"))
    g = ne.join(np_, keys, "full").join(hit, keys, "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return g.select(*keys, z("n_expected").alias("n_expected"), z("n_predicted").alias("n_predicted"), z("n_matched").alias("n_matched"), *prf(z("n_matched"), z("n_predicted"), z("n_expected")), F.round("same", 6).alias("direction"))


def connectivity(nodes: DataFrame, reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """(agreement): share of node pairs on which both graphs agree whether they are connected.

    nodes: (node); edges: (a, b). Pairs are counted from the sizes of components
    and of their intersections, so none is listed.
    """
    def placed(edges, name):
        c = components(edges, "a", "b").select("node", F.col("component").alias(name))
        return nodes.select("node").distinct().join(c, "node", "left").select("node", F.coalesce(name, F.col("node")).alias(name))

    d = placed(reference, "r").join(placed(predicted, "p"), "node")
    pairs = lambda *by: d.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("_".join(by) or "all"))
    one = pairs("r").join(pairs("p"), F.lit(True)).join(pairs("r", "p"), F.lit(True)).join(d.agg((F.count("*") * (F.count("*") - 1) / 2).alias("all")), F.lit(True))  # one row each
    agree = F.col("all") - F.col("r") - F.col("p") + 2 * F.col("r_p")
    return one.select(F.round(F.coalesce(F.try_divide(agree, F.col("all")), F.lit(1.0)), 6).alias("agreement"))


#: Fixed value: farthest difference of a native and a rendered box in any of their four numbers.
SAME_BOX = 0.005


def object_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(deck_id, n, object_id, iou): the object that each expected one (deck_id, n, object_id, slide_number, type, text, x, y, w, h) means.

    With an id it means that object or none; without, the first by order of the
    same slide and type whose text holds the expected text. iou is null unless
    both have boxes. actual has an ``order``.
    """
    box = lambda d, k: d.select("*", F.struct("x", "y", F.col("w"), F.col("h")).alias(f"__{k}")).drop("x", "y", "w", "h")
    e, a = box(expected, "e"), box(actual, "a")
    a = a.select("deck_id", F.col("object_id").alias("found"), F.col("slide_number").alias("s"), F.col("type").alias("t"), fold(F.coalesce("text", F.lit(""))).alias("body"), "order", "__a")
    named = e.where("object_id is not null").join(a, "deck_id").where("object_id = found").select("deck_id", "n", "found", "order", "__e", "__a")
    like = e.where("object_id is null").withColumn("__t", fold(F.coalesce("text", F.lit(""))))
    alike = like.join(a, (like["deck_id"] == a["deck_id"]) & (F.col("slide_number") == F.col("s")) & (F.col("type") == F.col("t"))).where(F.contains("body", F.col("__t"))).select(like["deck_id"], "n", "found", "order", "__e", "__a")
    best = named.unionByName(alike).groupBy("deck_id", "n").agg(F.min_by(F.struct("found", "__e", "__a"), F.struct("order", "found")).alias("m"))
    j = expected.select("deck_id", "n").join(best, ["deck_id", "n"], "left")
    return j.select("deck_id", "n", F.col("m.found").alias("object_id"), F.when(F.col("m.__e.w").isNotNull() & F.col("m.__a.w").isNotNull(), _iou(F.col("m.__e"), F.col("m.__a"))).alias("iou"))


def _iou(p: Column, q: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(p["x"] + p["w"], q["x"] + q["w"]) - F.greatest(p["x"], q["x"]))
    h = F.greatest(F.lit(0.0), F.least(p["y"] + p["h"], q["y"] + q["h"]) - F.greatest(p["y"], q["y"]))
    union = p["w"] * p["h"] + q["w"] * q["h"] - w * h
    return F.when(union != 0, w * h / union).otherwise((p == q).cast("double"))


def extraction_accuracy(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(deck_id, n_expected, object_recall, box_accuracy): of decks with expected objects; the accuracy is the mean overlap of matches with boxes, 1 without any."""
    m = object_matches(expected, actual)
    return m.groupBy("deck_id").agg(F.count("*").alias("n_expected"), F.round(F.avg(F.col("object_id").isNotNull().cast("int")), 6).alias("object_recall"), F.round(F.coalesce(F.avg("iou"), F.lit(1.0)), 6).alias("box_accuracy"))


def resolution(expected: DataFrame | None, actual: DataFrame, key: str, resolved: Column) -> DataFrame:
    """(deck_id, share): how many of a deck's expected keys exist and are resolved; without expectations, of all that it has; 1 for none."""
    a = actual.groupBy("deck_id", key).agg(F.bool_or(F.coalesce(resolved, F.lit(False))).alias("ok"))
    base = a if expected is None else expected.select("deck_id", key).distinct().join(a, ["deck_id", key], "left")
    return base.groupBy("deck_id").agg(F.round(F.avg(F.coalesce("ok", F.lit(False)).cast("int")), 6).alias("share"))


def geometry_mismatches(native: DataFrame, rendered: DataFrame, tolerance: float = SAME_BOX) -> DataFrame:
    """(deck_id, slide_number, native_id, reason, max_delta) of native boxes that the rendering lacks or has elsewhere; groups aren't compared.

    Both sides: deck_id, slide_number, native_id, x, y, w, h; native has a type.
    """
    key = ["deck_id", "slide_number", "native_id"]
    n = native.where("native_id is not null and w is not null and coalesce(type, '') <> 'group'").dropDuplicates(key)
    r = rendered.select(*key, *[F.col(c).alias(f"r{c}") for c in "xywh"]).dropDuplicates(key)
    delta = F.round(F.greatest(*[F.abs(F.col(c) - F.col(f"r{c}")) for c in "xywh"]), 12)
    j = n.join(r, key, "left").withColumn("max_delta", delta)
    reason = F.when(F.col("rx").isNull(), "missing_rendered_object").when(F.col("max_delta") > tolerance, "bbox_delta_exceeds_tolerance")
    return j.select(*key, reason.alias("reason"), "max_delta").where("reason is not null")


def geometry_verification(native: DataFrame, rendered: DataFrame, tolerance: float = SAME_BOX) -> DataFrame:
    """(deck_id, slide_number, n_native, n_matched, n_missing, n_moved, coverage, status) of every slide with native objects: partial if the rendering lacks one, else verified."""
    m = geometry_mismatches(native, rendered, tolerance).groupBy("deck_id", "slide_number").agg(F.count_if(F.col("reason") == "missing_rendered_object").alias("miss"), F.count_if(F.col("reason") != "missing_rendered_object").alias("moved"))
    n = native.where("native_id is not null and w is not null and coalesce(type, '') <> 'group'").groupBy("deck_id", "slide_number").agg(F.count_distinct("native_id").alias("n_native"))
    miss = F.coalesce("miss", F.lit(0))
    return n.join(m, ["deck_id", "slide_number"], "left").select("deck_id", "slide_number", "n_native", (F.col("n_native") - miss).alias("n_matched"), miss.alias("n_missing"), F.coalesce("moved", F.lit(0)).alias("n_moved"), F.round((F.col("n_native") - miss) / F.col("n_native"), 6).alias("coverage"), F.when(miss > 0, "partial").otherwise("verified").alias("status"))


def run_evaluation(labels: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_targets, n_invalid, role_accuracy, reading_order_accuracy, flow_accuracy, grounding, hallucination_rate, n_requests, n_cached, cache_rate, cost, seconds): a run of a vision model against labels.

    labels: keys, target, image_role, reading_order, flow_present, flow_direction,
    null where not labelled. records: keys, target, status, the same fields,
    valid BOOLEAN, grounding_score, hallucinated, cache_hit, cost, seconds. An
    accuracy is over the labelled and valid targets, null without any; a target
    without a valid record is invalid.
    """
    fields = ("image_role", "reading_order", "flow_present", "flow_direction")
    r = records.groupBy(*keys, "target").agg(F.max_by(F.struct("valid", *fields), F.coalesce("valid", F.lit(False))).alias("r"))
    j = labels.join(r, [*keys, "target"], "left").withColumn("ok", F.coalesce("r.valid", F.lit(False)))
    hit = lambda c: F.when(F.col("ok") & F.col(c).isNotNull(), F.col(c).eqNullSafe(F.col(f"r.{c}")).cast("int"))
    mean = lambda c, name: F.round(c, 6).alias(name)
    flow = F.try_divide(F.coalesce(F.sum(hit("flow_present")), F.lit(0)) + F.coalesce(F.sum(hit("flow_direction")), F.lit(0)), F.count(hit("flow_present")) + F.count(hit("flow_direction")))
    a = j.groupBy(*keys).agg(F.count("*").alias("n_targets"), F.count_if(~F.col("ok")).alias("n_invalid"), mean(F.avg(hit("image_role")), "role_accuracy"), mean(F.avg(hit("reading_order")), "reading_order_accuracy"), mean(flow, "flow_accuracy"))
    # grounding counts only for labelled targets, telemetry for all records
    g = records.join(labels.select(*keys, "target").distinct(), [*keys, "target"], "left_semi").where("valid").groupBy(*keys).agg(mean(F.avg("grounding_score"), "grounding"), mean(F.try_divide(F.count_if(F.col("hallucinated") & F.col("grounding_score").isNotNull()), F.count("grounding_score")), "hallucination_rate"))
    t = records.groupBy(*keys).agg(F.count_if(~F.col("status").isin("not_requested", "not_applicable")).alias("n_requests"), F.count_if("cache_hit").alias("n_cached"), mean(F.count_if("cache_hit") / F.count("*"), "cache_rate"), mean(F.coalesce(F.sum("cost"), F.lit(0.0)), "cost"), mean(F.coalesce(F.sum("seconds"), F.lit(0.0)), "seconds"))
    return a.join(g, keys, "left").join(t, keys, "left")
