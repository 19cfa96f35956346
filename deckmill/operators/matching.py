"""Matching of records and texts, contract checks, keyed merges and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.text import words
from .scoring import prf


def word_overlap(pairs: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, n_reference, n_hypothesis, n_matched, precision, recall, f1): words as multisets, letter case ignored."""
    count = lambda c, n: pairs.select(key, F.explode(words(F.lower(F.col(c)))).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    both = count(reference, "a").join(count(hypothesis, "b"), [key, "w"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    g = both.groupBy(key).agg(F.sum(a).alias("n_reference"), F.sum(b).alias("n_hypothesis"), F.sum(F.least(a, b)).alias("n_matched"))
    return g.select(key, "n_reference", "n_hypothesis", "n_matched", *prf(F.col("n_matched"), F.col("n_hypothesis"), F.col("n_reference")))


def character_error(pairs: DataFrame, key: str, reference: str, hypothesis: str) -> DataFrame:
    """(key, distance, cer): edit distance over the reference's length; an empty reference gives 0 for an empty hypothesis, else 1."""
    d = F.levenshtein(reference, hypothesis)
    cer = F.when(F.length(reference) == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(d / F.length(reference))
    return pairs.select(key, d.alias("distance"), F.round(cer, 6).alias("cer"))


def completeness(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state) of the keys on one side only: 'missing' if expected, 'unexpected' if returned."""
    e, r = expected.select(*keys).distinct(), returned.select(*keys).distinct()
    return e.join(r, keys, "left_anti").withColumn("state", F.lit("missing")).unionByName(r.join(e, keys, "left_anti").withColumn("state", F.lit("unexpected")))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep_existing: bool = False) -> DataFrame:
    """Both tables with one row per key; the incoming row replaces the existing one unless that is kept. Merging the same rows again changes nothing."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    pick = F.min_by if keep_existing else F.max_by
    rest = [c for c in both.columns if c not in (*keys, "__side")]
    m = both.groupBy(*keys).agg(pick(F.struct(*rest), "__side").alias("__m"))
    return m.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in rest])


def as_of(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """``rows`` with the value of the key's last mark at or before their time; one sort per key, no join of the two sides."""
    m = marks.select(F.col(key), F.col(at), F.col(value).alias(name), F.lit(0).alias("__r"))
    both = rows.withColumn("__r", F.lit(1)).unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last(F.when(F.col("__r") == 0, F.col(name)), ignorenulls=True).over(w)).where("__r = 1").drop("__r")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 30) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating star contractions.

    Large stars link every greater neighbour to a node's least neighbour, small
    stars every lesser one; the rounds needed grow with the logarithm of the
    component's size, and each runs from a written table. More than
    ``most_rounds`` of them are an error, never an unfinished result.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    e = cut(e)
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u")).toDF("n", "m")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
        large = both.join(least, "n").where("m > n").select(F.col("r").alias("u"), F.col("m").alias("v")).where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("r"))
        joined = large.join(low, "v")
        small = joined.select(F.col("r").alias("u"), "v").union(joined.select(F.col("r").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()
        new = cut(small)
        if new.count() == e.count() and not new.exceptAll(e).take(1):
            break
        e = new
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return roots.union(e.select("u", "u")).distinct()


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(rule, key columns...) of every row that breaks a rule; a rule that gives null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), *key)
