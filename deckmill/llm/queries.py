"""Queries of the language-model text operators, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ship import shipped
from ..sources.tables import once, table
from . import boilerplate, encodings, near_duplicates, packing, reading, residue, tokens, top_n, visual_form


def _looks(spark: SparkSession, d: str) -> DataFrame:
    slides = visual_form.forms(table(spark, d, "slides"), "slide_key", visual_form.packed(F.col("text")))
    problems = visual_form.forms(table(spark, d, "problems"), "problem_key", F.col("description"))
    return slides.withColumn("record_type", F.lit("slide")).unionByName(problems.withColumn("record_type", F.lit("problem")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return visual_form.look_alike_pairs(cut(_looks(spark, d)))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every problem description and slide text in its one form, a slide's elements set apart by U+001E; null texts stay null."""
    s, p = once(table(spark, d, "slides").select("slide_key", "text"), "slide_key"), table(spark, d, "problems")
    joined = F.array_join(F.transform("text", lambda e: F.coalesce(e, F.lit(""))), "\x1e")
    s = s.select(F.lit("slide").alias("record_type"), F.col("slide_key").alias("key"), visual_form.form_column(joined).alias("form"))
    p = p.select(F.lit("problem").alias("record_type"), F.col("problem_key").alias("key"), visual_form.form_column(F.col("description")).alias("form"))
    return s.unionByName(p.distinct())


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.similar(table(spark, d, "slides"), table(spark, d, "assets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.all_pairs(*_similar(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.classes(*_similar(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    slides = table(spark, d, "slides")
    return encodings.affected(slides, "slide_key", "text", cut(encodings.garbled_tokens(slides, "text")))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    slides = table(spark, d, "slides")
    return encodings.restored(slides, "slide_key", "text", cut(encodings.garbled_tokens(slides, "text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_fields(table(spark, d, "slides"))


def p4_density(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_density(table(spark, d, "slides")).distinct()


def _decks_of_statements(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.sources(table(spark, d, "submissions"), "ps_id", "deck_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, d, "slides"), _decks_of_statements(spark, d), "ps_id", "deck_id", "text").select("ps_id", "line")


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    """The repeated lines of each statement as templates with slots."""
    found = cut(boilerplate.repeated_lines(table(spark, d, "slides"), _decks_of_statements(spark, d), "ps_id", "deck_id", "text"))
    return boilerplate.templates(found, "ps_id")


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.without_repeated_lines(table(spark, d, "slides"), "slide_key", _decks_of_statements(spark, d), "ps_id", "deck_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n.best_submissions(table(spark, d, "submissions"), 5).select("ps_id", "submission_id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    return top_n.best_submissions(table(spark, d, "submissions"), 5)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(table(spark, d, "documents").select("doc_id", tokens.token_count(spark, F.col("text")).alias("n")))
    return packing.packed(sized, "doc_id", "n")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_packed(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("n_words >= 50 and level = 5").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: shipped(f) for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
