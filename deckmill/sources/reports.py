"""Reports as rows: a report's lines in their order, so that no task holds a leaderboard of any size in one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import brief
from ..operators import metrics
from .sinks import cell

#: Headings, heads of the tables and lines of the reports.
STATEMENT, REPORT, SCORECARD, TITLE, NO_TITLE = "## Problem Statement `%s`", "# Deck Evaluation Report", "## Scorecard", "- Title: ", "Unavailable"
REVIEW_LINE, SCORE_LINE = "- Final score: `REVIEW` (a complete weighted score was not available)", "- Final score: `%.2f/100` (proposal `%.2f/70` + deck `%.2f/30`)"
BOARD_HEAD = ("| Rank | Submission | Team | Bucket | Score | Status |", "| ---: | --- | --- | --- | ---: | --- |")
SCORE_HEAD = ("| Metric | Score | Points |", "| --- | ---: | ---: |")


def number(c: Column, missing: str) -> Column:
    """Two decimals, without a grouping sign."""
    return F.when(c.isNull(), missing).otherwise(F.format_string("%.2f", c.cast("double")))


def board_line(place: Column, submission: Column, team: Column, bucket: Column, score: Column, status: Column) -> Column:
    """A submission's line of a leaderboard; REVIEW without a place, N/A without a score."""
    rank = F.coalesce(place.cast("string"), F.lit("REVIEW"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", rank, cell(submission), cell(team), cell(bucket), number(score, "N/A"), cell(status)), F.lit(" |"))


def leaderboard(board: DataFrame) -> DataFrame:
    """(ps_id, section, place, submission_id, line): the lines of every statement's leaderboard, to be read in the order of the first four columns, nulls last.

    board: ps_id, submission_id, team, bucket, final_score, status, place, problem_title.
    """
    head = board.groupBy("ps_id").agg(F.max("problem_title").alias("title"))
    lines = F.array(F.format_string(STATEMENT, "ps_id"), F.lit(""), F.concat(F.lit(TITLE), F.coalesce("title", F.lit(NO_TITLE))), F.lit(""), *[F.lit(x) for x in BOARD_HEAD])
    top = head.select("ps_id", F.posexplode(lines).alias("section", "line"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("submission_id"))
    line = board_line(F.col("place"), F.col("submission_id"), F.col("team"), F.col("bucket"), F.col("final_score"), F.col("status"))
    rows = board.select("ps_id", F.when(F.col("place").isNull(), 101).otherwise(100).alias("section"), line.alias("line"), "place", "submission_id")
    return top.unionByName(rows).select("ps_id", "section", "place", "submission_id", "line")


def scorecards(evaluated: DataFrame, components: DataFrame, found: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(deck_id, section, n, line): each deck's scorecard: final score, a line for each component, its best and worst findings.

    evaluated: of ``metrics.evaluated``. components: (deck_id, scores MAP<name,
    STRUCT<score, ...>>). found: of ``checks.findings``.
    """
    final = F.when(F.col("final.score").isNull(), F.lit(REVIEW_LINE)).otherwise(
        F.format_string(SCORE_LINE, "final.score", F.col("proposal.score") * metrics.PROPOSAL_WEIGHT, F.col("deck_quality.score") * metrics.DECK_WEIGHT)
    )
    top = F.array(F.lit(REPORT), F.lit(""), F.lit(SCORECARD), F.lit(""), final, F.lit(""), *[F.lit(x) for x in SCORE_HEAD])
    out = evaluated.select("deck_id", F.lit(0).alias("section"), F.posexplode(top).alias("n", "line"))
    points = metrics.PROPOSAL | metrics.DECK
    entries = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(k.replace("_", " ").capitalize()).alias("name"), F.lit(v).alias("points"), F.try_element_at("scores", F.lit(k))["score"].alias("score")) for i, (k, v) in enumerate(points.items())])
    e = components.select("deck_id", F.explode(entries).alias("e"))
    worth = number(F.col("e.score") * F.col("e.points") / 100.0, "N/A")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("e.name"), F.concat(number(F.col("e.score"), "REVIEW"), F.lit("/100")), F.concat(worth, F.format_string("/%.0f", "e.points"))), F.lit(" |"))
    out = out.unionByName(e.select("deck_id", F.lit(1).alias("section"), F.col("e.n").alias("n"), line.alias("line")))
    if found is not None:
        from ..operators.checks import limited

        f = limited(found, most).withColumn("section", F.when(F.col("kind") == "strength", 2).otherwise(3))
        out = out.unionByName(f.groupBy("deck_id", "section").agg(F.array_sort(F.collect_list(brief(F.concat(F.lit("- "), "title"), 260))).alias("l")).select("deck_id", "section", F.posexplode("l").alias("n", "line")))
    return out


def evaluation_json(evaluated: DataFrame, metric_rows: DataFrame, found: DataFrame) -> DataFrame:
    """(deck_id, json): each deck's evaluation as one compact JSON object with sorted keys."""
    from .sinks import canonical_json

    f = found.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("kind", "category", "title", "value"))).alias("findings"))
    m = metric_rows.select("deck_id", F.struct(*[c for c in metric_rows.columns if c != "deck_id"]).alias("metrics"))
    d = evaluated.join(m, "deck_id", "left").join(f, "deck_id", "left")
    return canonical_json(d.select("deck_id", "proposal", "deck_quality", "final", "status", "metrics", "findings")).select(F.get_json_object("json", "$.deck_id").alias("deck_id"), "json")


def semantic_json(slides: DataFrame) -> DataFrame:
    """(deck_id, json): what a reader of the deck sees, one object a slide in order: title, texts, visuals and tables without parser internals.

    slides: of ``projection.slide_rows``. A deck's slides are brought together in one row.
    """
    none = lambda c: F.coalesce(F.col(c), F.array().cast(slides.schema[c].dataType))
    texts = F.transform(none("blocks"), lambda b: b["text"])
    shown = F.transform(none("visuals"), lambda v: F.struct(v["role"].alias("role"), v["ocr_text"].alias("text")))
    s = F.struct(F.col("slide_number").alias("number"), "slide_type", "title", texts.alias("texts"), shown.alias("visuals"), F.size(none("tables")).alias("tables"))
    return slides.groupBy("deck_id").agg(F.to_json(F.array_sort(F.collect_list(s)), {"ignoreNullFields": "false"}).alias("json"))
