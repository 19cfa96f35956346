"""From files of decks to ranked submissions, all decks at once.

A file that can't be read, or has no slides, comes out as a failed submission
with its error; it never ends the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lineage import cut
from ..operators import metrics, projection, scoring
from ..sources import packages, pdf, reports, semantics

BUCKETS, LOWEST, UNKNOWN = {"A - Excellent": 85.0, "B - Strong": 70.0, "C - Promising": 55.0}, "D - Needs work", "REVIEW"


def extracted(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of the files (path, format, content): sources, errors, slides, objects, assets, links, texts.

    Packages give objects; PDF files give a slide for each page, with its texts
    and images as objects. Parts are written once, as every table reads them.
    """
    parts = cut(packages.read_packages(files))
    facts = cut(pdf.read_pdfs(files))
    good = parts.where("error is null")
    rels = cut(packages.relationships(good))
    order = cut(packages.slide_order(good, rels))
    shapes = cut(semantics.resolved_colors(packages.objects(good, order), semantics.themes(good)))
    assets = packages.media(good, rels)
    links = projection.object_assets(shapes, order, rels, assets)
    spans = pdf.spans(facts).select("deck_id", F.col("page").alias("slide_number"), F.format_string("slide-%02d-object-%04d", "page", "n").alias("object_id"), F.lit("text").alias("type"), "text", "x", "y", "w", "h", F.array("size").alias("font_sizes"), F.col("n").alias("z_order"))
    drawn = pdf.images(facts).select("deck_id", F.col("page").alias("slide_number"), F.format_string("slide-%02d-object-%04d", "page", "n").alias("object_id"), F.lit("image").alias("type"), "x", "y", "w", "h", F.col("n").alias("z_order"))
    objects = shapes.unionByName(spans, allowMissingColumns=True).unionByName(drawn, allowMissingColumns=True)
    texts = packages.slide_texts(shapes).unionByName(pdf.page_texts(facts))
    slides = order.select("deck_id", "slide_number").unionByName(pdf.pages(facts).select("deck_id", F.col("page").alias("slide_number")))
    read = good.select("deck_id", "path").union(facts.where("kind = 'page'").select("deck_id", "path")).distinct()
    failed = parts.where("error is not null").select("deck_id", "path", "error").union(facts.where("kind in ('error', 'encrypted')").select("deck_id", "path", F.coalesce("text", "kind")))
    unknown = files.where("format is null").select(F.sha2("content", 256).alias("deck_id"), "path", F.lit("unknown format").alias("error"))
    return {"sources": read, "errors": failed.union(unknown), "slides": slides, "objects": objects, "assets": assets, "links": links, "texts": texts}


def submissions(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, deck_id, submission_id, ps_id, team, error) of every file: the statement and the team as its text names them, else its name."""
    t = tables["texts"].groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide_number", F.array_join("text", "\n").alias("t")))).alias("l")).select("deck_id", F.array_join("l.t", "\n").alias("text"))
    every = tables["sources"].withColumn("error", F.lit(None).cast("string")).unionByName(tables["errors"])
    name = F.substring_index("path", "/", -1)
    d = every.join(t, "deck_id", "left").withColumn("name", name)
    empty = tables["slides"].select("deck_id").distinct().withColumn("has", F.lit(True))
    d = d.join(empty, "deck_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("has").isNull(), "no slides")))
    return d.select("path", "deck_id", tx.slug(tx.stem(F.col("name")), "submission").alias("submission_id"), tx.named_problem(F.col("text"), F.col("name")).alias("ps_id"), tx.named_team(F.col("text"), F.col("name")).alias("team"), "error")


def ranked(tables: dict[str, DataFrame], answers: DataFrame | None = None, problems: DataFrame | None = None) -> dict[str, DataFrame]:
    """The board, its lines, metrics and evaluations of the extracted decks. answers: as for ``metrics.evaluated``; problems: (ps_id, title)."""
    rows = projection.slide_rows(tables["objects"], tables["links"])
    m = cut(metrics.deck_metrics(metrics.measured(rows)))
    e = cut(metrics.evaluated(m, answers))
    s = submissions(tables).join(e.select("deck_id", F.col("final.score").alias("final_score"), F.col("proposal.score").alias("proposal_score"), F.col("deck_quality.score").alias("deck_quality_score"), F.col("status").alias("s")), "deck_id", "left")
    s = s.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.lower(F.coalesce("s", F.lit("review"))))).drop("s")
    zero = [F.coalesce(c, F.lit(0.0)).desc() for c in ("final_score", "proposal_score", "deck_quality_score")]
    board = scoring.ranked(s, "ps_id", [*zero, F.lower("submission_id"), F.col("path")], F.col("final_score").isNotNull() & (F.col("status") != "failed"))
    board = board.withColumn("bucket", scoring.bucket(F.col("final_score"), BUCKETS, LOWEST, UNKNOWN))
    title = problems.select("ps_id", F.col("title").alias("problem_title")).dropDuplicates(["ps_id"]) if problems is not None else None
    board = board.join(title, "ps_id", "left") if title is not None else board.withColumn("problem_title", F.lit(None).cast("string"))
    board = cut(board)
    return {"board": board, "lines": reports.leaderboard(board), "metrics": m, "evaluations": e}


def run(spark: SparkSession, paths: list[str], out: str, answers: DataFrame | None = None, problems: DataFrame | None = None) -> None:
    """Extracts, scores and ranks the decks under ``paths`` and writes every table as parquet under ``out``."""
    tables = extracted(packages.discover(spark, paths))
    for name, df in (tables | ranked(tables, answers, problems)).items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
