"""Before and after a vision model: which images are worth a question, what it is told, and what of its answer stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze
from . import evidence
from .checks import VISION_FIELDS

#: Shares of a slide below which an image is small or tiny and above which it fills the slide; words that it may have; terms of marks; least confidence of text.
SIDE, SMALL, TINY, FULL, SURE_TEXT = 0.22, 0.04, 0.01, 0.65, 0.65
MARKS, NOISE_ROLES = ("logo", "watermark", "brand"), ("logo", "decorative_image", "decorative", "template")
CHROME, EDGE_CHROME, EDGE_LABEL = ("logo", "watermark", "page number", "slide number"), ("brand", "template", "footer"), 24
#: Most objects and facts that a model is told of, and the most characters of a text.
MOST_OBJECTS, MOST_FACTS, MOST_CHARS, MOST_OBSERVATIONS = 96, 64, 500, 64


def _any(c: Column, terms) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def noise_reasons(placed: DataFrame, texts: DataFrame, n_edges: DataFrame, roles: DataFrame) -> DataFrame:
    """(deck_id, asset_id, reasons): why an image file isn't worth a question; empty if it is.

    placed: (deck_id, slide_number, asset_id, x, y, w, h), every place of every
    file. texts: (deck_id, asset_id, text, n_words), n_edges: (deck_id, asset_id,
    n_edges) of its diagram, roles: (deck_id, asset_id, role); any may lack a file.
    """
    key = ["deck_id", "asset_id"]
    area = F.col("w") * F.col("h")
    g = placed.groupBy(*key).agg(
        F.count_distinct("slide_number").alias("n_slides"), F.bool_or((F.greatest("w", "h") < SIDE) | (area < SMALL)).alias("small"), F.bool_and(area < TINY).alias("tiny"), F.bool_or(evidence.near_edge()).alias("corner"), F.bool_or(area > FULL).alias("full"),
    )
    d = g.join(texts.groupBy(*key).agg(F.max("n_words").alias("words"), F.max(F.lower("text")).alias("text")), key, "left").join(n_edges.groupBy(*key).agg(F.sum("n_edges").alias("edges")), key, "left").join(roles.groupBy(*key).agg(F.min("role").alias("role")), key, "left")
    words, bare, again = F.coalesce("words", F.lit(0)), F.coalesce("edges", F.lit(0)) == 0, F.col("n_slides") >= 2
    c = F.col
    reasons = F.array_compact(F.array(
        F.when(again & c("small") & (words <= 6) & bare, "repeated_small_corner_asset"), F.when(again & c("full") & (words == 0) & bare, "repeated_full_slide_template_asset"), F.when(c("small") & c("corner") & (words <= 2) & bare, "decorative_or_logo_asset"),
        F.when(c("small") & c("corner") & _any(F.coalesce("text", F.lit("")), MARKS), "recognized_logo_or_watermark_text"), F.when(c("tiny") & (words <= 3) & bare, "tiny_low_information_asset"), F.when(c("role").isin(*NOISE_ROLES) & bare, "deterministic_role_noise"),
    ))
    return d.select(*key, reasons.alias("reasons"))


def selected(noise: DataFrame, texts: DataFrame, graphs: DataFrame, mismatched: DataFrame, unsupported: DataFrame) -> DataFrame:
    """(deck_id, asset_id, selected, reasons): images to be asked about, with what is unclear about them in order; the others with their noise.

    graphs: (deck_id, asset_id, n_edges, verified_share, direction) of diagrams; mismatched and unsupported: (deck_id, asset_id)
    on slides whose rendering differs, or with node diagrams that can't be read.
    """
    key = ["deck_id", "asset_id"]
    sure = texts.where((F.col("status") == "verified") & (F.col("confidence") >= SURE_TEXT)).select(*key).distinct().withColumn("sure", F.lit(True))
    g = graphs.groupBy(*key).agg(F.count("*").alias("graphs"), F.bool_or((F.col("n_edges") == 0) | (F.coalesce("verified_share", F.lit(0.0)) <= 0)).alias("missing"), F.bool_or(F.col("direction") == "unknown").alias("unclear"))
    mark = lambda d, name: d.select(*key).distinct().withColumn(name, F.lit(True))
    d = noise.join(sure, key, "left").join(g, key, "left").join(mark(mismatched, "differs"), key, "left").join(mark(unsupported, "smart"), key, "left")
    why = F.array_sort(F.array_compact(F.array(
        F.when(F.col("sure").isNull(), "low_or_missing_ocr_confidence"), F.when(F.col("graphs").isNull(), "image_role_unknown"), F.when(F.col("missing"), "diagram_edges_missing"), F.when(F.col("unclear"), "diagram_flow_direction_unclear"),
        F.when(F.col("differs"), "native_visual_disagreement"), F.when(F.col("smart"), "unsupported_smartart_interpretation"),
    )))
    quiet = F.size("reasons") > 0
    return d.select(*key, (~quiet).alias("selected"), F.when(quiet, F.concat(F.array(F.lit("noise_filtered")), "reasons")).otherwise(why).alias("reasons"))


def told(objects: DataFrame) -> DataFrame:
    """(deck_id, slide_number, context): what a model is told of a slide, as JSON: its first objects in drawing order, long texts cut. Groups and shapes without text are left out."""
    o = objects.where(~F.col("type").isin("group", "shape") | (F.coalesce("text", F.lit("")) != ""))
    o = o.withColumn("__n", F.row_number().over(Window.partitionBy("deck_id", "slide_number").orderBy("z_order", "object_id"))).where(F.col("__n") <= MOST_OBJECTS)
    text = F.when(F.length("text") > MOST_CHARS, F.concat(F.substring("text", 1, MOST_CHARS), F.lit("..."))).otherwise(F.col("text"))
    item = F.struct("__n", "object_id", "parent_id", "type", "x", "y", "w", "h", text.alias("text"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda i: i.dropFields("__n"))
    return o.groupBy("deck_id", "slide_number").agg(F.to_json(rows).alias("context"))


def _chrome(n: Column) -> Column:
    label = F.lower(squeeze(F.coalesce(n["label"], F.lit(""))))
    number = F.trim(F.regexp_replace(label, "^(?:page )?(?:slide )?", ""), F.lit(" -:#"))
    box = n["bbox"]
    at = lambda i: F.get(box, F.lit(i))
    edge = (at(0) <= 0.08) | (at(1) <= 0.08) | (at(0) + at(2) >= 0.92) | (at(1) + at(3) >= 0.92)
    return (label != "") & (label.rlike("^[0-9]+$") | number.rlike("^[0-9]+$") | _any(label, CHROME) | (F.coalesce(edge, F.lit(False)) & (F.length(label) <= EDGE_LABEL) & _any(label, EDGE_CHROME)))


def conservative(answers: DataFrame, keep_status: bool = False) -> DataFrame:
    """``answers`` with the slide's chrome taken out of ``answer``, and n_noise_nodes, n_lost_edges, n_downgraded.

    Nodes that are page numbers, logos or marks go, with the edges that touch them,
    and all nodes of an image that is itself noise. A model's own word doesn't
    verify: nodes become partial at most, edges unverified, unless ``keep_status``;
    and that there is no flow is only unknown.
    """
    x = F.col("answer")
    noise = F.coalesce(x["image_role"].isin(*NOISE_ROLES), F.lit(False))
    gone = F.transform(F.filter(x["nodes"], lambda n: noise | _chrome(n)), lambda n: n["id"])
    d = answers.withColumn("__gone", gone)
    stay = F.filter(x["nodes"], lambda n: ~F.array_contains("__gone", n["id"]))
    ids = F.transform(stay, lambda n: n["id"])
    nodes = stay if keep_status else F.transform(stay, lambda n: n.withField("status", F.when(n["status"] == "verified", "partial").otherwise(n["status"])))
    whole = F.filter(x["edges"], lambda e: F.array_contains(ids, e["source"]) & F.array_contains(ids, e["target"]))
    edges = whole if keep_status else F.transform(whole, lambda e: e.withField("status", F.lit("unverified")))
    note = F.struct(F.lit("noise_filtered").alias("type"), F.array_sort("__gone").alias("objects"), F.lit("Logos, page numbers or decoration were left out of the graph.").alias("description"), F.lit(1.0).alias("confidence"))
    seen = F.slice(F.when(F.size("__gone") > 0, F.concat(x["observations"], F.array(note))).otherwise(x["observations"]), 1, MOST_OBSERVATIONS)
    n_down = F.lit(0) if keep_status else F.size(F.filter(stay, lambda n: n["status"] == "verified"))
    clean = F.struct(*[{"nodes": nodes, "edges": edges, "observations": seen, "flow_present": F.when(x["flow_present"], True)}.get(f, x[f]).alias(f) for f in VISION_FIELDS])
    return d.withColumns({"n_noise_nodes": F.size("__gone"), "n_lost_edges": F.size(x["edges"]) - F.size(whole), "n_downgraded": n_down, "answer": F.when(x.isNotNull(), clean)}).drop("__gone")


def grounding(answers: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_nodes, n_grounded, node_score, n_edges, n_grounded_edges, edge_score, checks): how much of an answer has an anchor in what is known.

    context: (key, ids ARRAY<STRING> of native objects, texts ARRAY<STRING> of
    objects, recognisers and graphs). A node is grounded by its id or by a label
    that holds, or is part of, such a text; an edge by both of its ends. An answer
    without nodes or edges is fully grounded in them. It proves nothing: it audits.
    """
    none = F.array().cast("array<string>")
    norm = lambda t: F.lower(squeeze(F.coalesce(t, F.lit(""))))
    d = answers.join(context, key, "left").withColumns({"__ids": F.coalesce("ids", none), "__texts": F.filter(F.transform(F.coalesce("texts", none), norm), lambda t: F.length(t) >= 2)})
    x = F.col("answer")
    nodes = F.coalesce(x["nodes"], F.array().cast("array<struct<id:string,label:string,bbox:array<double>,status:string>>"))
    anchored = F.filter(nodes, lambda n: F.array_contains("__ids", n["id"]) | ((norm(n["label"]) != "") & F.exists("__texts", lambda t: F.contains(t, norm(n["label"])) | F.contains(norm(n["label"]), t))))
    d = d.withColumn("__ok", F.transform(anchored, lambda n: n["id"]))
    edges = F.coalesce(x["edges"], F.array().cast("array<struct<source:string,target:string,label:string,direction:string,status:string>>"))
    good = F.filter(edges, lambda e: F.array_contains("__ok", e["source"]) & F.array_contains("__ok", e["target"]))
    d = d.select(*key, F.size(nodes).alias("n_nodes"), F.size("__ok").alias("n_grounded"), F.size(edges).alias("n_edges"), F.size(good).alias("n_grounded_edges"))
    share = lambda a, b: F.round(F.when(F.col(b) == 0, 1.0).otherwise(F.col(a) / F.col(b)), 6)
    checks = F.array_compact(F.array(F.when(F.col("n_grounded") < F.col("n_nodes"), "ungrounded_node_claim"), F.when(F.col("n_grounded_edges") < F.col("n_edges"), "ungrounded_edge_claim")))
    return d.select(*key, "n_nodes", "n_grounded", share("n_grounded", "n_nodes").alias("node_score"), "n_edges", "n_grounded_edges", share("n_grounded_edges", "n_edges").alias("edge_score"), checks.alias("checks"))


def object_label(objects: DataFrame) -> DataFrame:
    """``objects`` with ``label``: name, text and placeholder, lower-cased and squeezed, by which roles are told."""
    return objects.withColumn("label", F.lower(squeeze(F.concat_ws(" ", "name", "text", "placeholder"))))
