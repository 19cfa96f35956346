"""Writing results: canonical JSON, Markdown and parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted_fields(c: Column, t: T.DataType) -> Column:
    """A column with the fields of its structs in order of their names, at every level."""
    if isinstance(t, T.StructType):
        inner = F.struct(*[_sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), inner)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: _sorted_fields(x, t.elementType))
    return c


def canonical_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One compact JSON text a row with sorted keys, nulls kept: equal rows give equal texts, whatever the order of their columns."""
    cols = [_sorted_fields(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the SHA-256 of the row's canonical JSON."""
    cols = [_sorted_fields(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(*keys, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def cell(c: Column) -> Column:
    """A value as the text of a Markdown table's cell."""
    return F.replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("–")), r"\s+", " "), F.lit("|"), F.lit("\\|"))


def markdown_table(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """(keys, markdown): each group's rows as one table; a group's text is made in one row, so groups should be reports, not corpora."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], line.alias("line")))), lambda r: r["line"])
    return df.groupBy(*keys).agg(F.concat(F.lit(head + "\n"), F.array_join(rows, "\n")).alias("markdown"))


def deck_markdown(slides: DataFrame) -> DataFrame:
    """(deck_id, markdown): a deck's slides in order, each with its texts as a list."""
    item = F.array_join(F.transform(F.filter("text", lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), lambda t: F.concat(F.lit("- "), F.regexp_replace(t, r"\s*\n\s*", " / "))), "\n")
    part = F.concat_ws("\n", F.format_string("## Slide %d", "slide_number"), F.nullif(F.coalesce(item, F.lit("")), F.lit("")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("slide_number", part.alias("part")))), lambda r: r["part"])
    return slides.groupBy("deck_id").agg(F.array_join(parts, "\n\n").alias("markdown"))


def write_bundle(df: DataFrame, path: str, by: str = "deck_id") -> None:
    """Parquet in folders of ``by``; rows are brought together first, so that a folder gets few files."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
