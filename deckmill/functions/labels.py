"""Numbers as page labels, and page selections, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Roman digits of the units, tens and hundreds.
_ROMAN = (("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"))


def roman(n: Column) -> Column:
    """The Roman numeral of a positive number; empty for others."""
    digit = lambda k: F.element_at(F.array(*[F.lit(x) for x in _ROMAN[k]]), (F.floor(n / 10**k) % 10 + 1).cast("int"))
    return F.when(n > 0, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit(2), digit(1), digit(0))).otherwise("")


def letters(n: Column) -> Column:
    """a to z, then aa, ab and so on like the columns of a sheet; empty for numbers below 1. Documents that repeat a letter instead (aa, bb) differ from 28 on."""
    start = F.struct(n.cast("bigint").alias("left"), F.lit("").alias("out"))
    digit = lambda a: (a["left"] - 1) % 26 + 97
    step = lambda a, _: F.when(a["left"] > 0, F.struct(F.floor((a["left"] - 1) / 26).cast("bigint").alias("left"), F.concat(F.char(digit(a)), a["out"]).alias("out"))).otherwise(a)
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["out"]), F.lit(""))


def styled(n: Column, style: Column) -> Column:
    """A number in a label style: D decimal, R and r Roman, A and a letters; no style, no number."""
    return F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n))).when(style == "A", F.upper(letters(n))).when(style == "a", letters(n)).otherwise("")


def page_labels(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """(deck_id, page, label): each page by the last entry (deck_id, page, style, prefix, first) at or before it; its own number if there is none."""
    e = entries.select("deck_id", "page", F.struct("page", "style", F.coalesce("prefix", F.lit("")).alias("prefix"), F.coalesce("first", F.lit(1)).alias("first")).alias("e"))
    both = pages.select("deck_id", "page", F.lit(1).alias("r")).unionByName(e.withColumn("r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("deck_id").orderBy("page", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = both.withColumn("e", F.last("e", ignorenulls=True).over(w)).where("r = 1")
    n = F.col("page") - F.col("e.page") + F.col("e.first")
    return d.select("deck_id", "page", F.when(F.col("e").isNull(), F.col("page").cast("string")).otherwise(F.concat("e.prefix", styled(n, F.col("e.style")))).alias("label"))


def selection(ranges: Column, most: int = 10_000) -> Column:
    """The distinct numbers of a list such as '1,3-5' in order; null if it is malformed, descends or is longer than ``most``."""
    parts = F.split(F.regexp_replace(ranges, r"\s+", ""), ",")
    low = lambda p: F.try_element_at(F.split(p, "-"), F.lit(1)).try_cast("int")
    high = lambda p: F.try_element_at(F.split(p, "-"), F.lit(-1)).try_cast("int")
    ok = ranges.rlike(r"^\s*\d{1,6}(\s*-\s*\d{1,6})?(\s*,\s*\d{1,6}(\s*-\s*\d{1,6})?)*\s*$") & F.forall(parts, lambda p: (low(p) >= 1) & (low(p) <= high(p)) & (high(p) - low(p) < most))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))
    return F.when(ok, F.when(F.size(numbers) <= most, numbers))
