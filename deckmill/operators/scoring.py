"""Weighted scores, ranks, buckets and calibration. A missing score is null and stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c + F.lit(0.0))


def latest(df: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest ``at``; of equal times the greatest row."""
    m = df.groupBy(*keys).agg(F.max(F.struct(at, *columns)).alias("__m"))
    return m.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in (at, *columns)])


def bucket(c: Column, thresholds: dict[str, float], lowest: str, unknown: str) -> Column:
    """The first name, from the highest threshold down, that the score reaches."""
    out = F.when(c.isNull(), F.lit(unknown))
    for name, least in sorted(thresholds.items(), key=lambda x: -x[1]):
        out = out.when(c >= least, F.lit(name))
    return out.otherwise(F.lit(lowest))


def weighted_group(df: DataFrame, keys: list[str], component: str, score: str, weights: dict[str, float], missing: Column, points: float = 10.0) -> DataFrame:
    """(keys, score, unpenalized, penalty): weighted means of the components; null if a weighted component is.

    A component loses ``points`` for each of its ``missing`` pieces of evidence, down to 0.
    """
    total = sum(weights.values())
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v / total))])[F.col(component)]
    d = df.where(F.col(component).isin(*weights)).select(*keys, F.col(score).alias("__s"), w.alias("__w"), F.least(F.col(score), points * missing).alias("__p"))
    g = d.groupBy(*keys).agg(F.count("__s").alias("__n"), F.sum(F.col("__w") * (F.col("__s") - F.col("__p"))).alias("s"), F.sum(F.col("__w") * F.col("__s")).alias("u"), F.sum(F.col("__w") * F.col("__p")).alias("p"))
    whole = F.col("__n") == len(weights)
    return g.select(*keys, *[F.when(whole, F.round(a, 6)).alias(b) for a, b in (("s", "score"), ("u", "unpenalized"), ("p", "penalty"))])


def ranked(df: DataFrame, group: str, order: list[Column], eligible: Column, name: str = "place") -> DataFrame:
    """``df`` with the row number of its eligible rows within the group in a total ``order``; null for the others.

    No task ranks a whole group. Rows are spread over ranges of (group, order),
    so a group of any size is a run of ranges; each range numbers its own rows,
    and the sizes of a group's earlier ranges, a row each, are added. ``df`` and
    the spread rows are written once: ranges are sampled from the former, and
    those of the latter don't move when a task is run again.
    """
    df = cut(df)
    at = cut(df.where(eligible).repartitionByRange(F.col(group), *order).withColumn("__range", F.spark_partition_id()))
    local = at.withColumn("__n", F.row_number().over(Window.partitionBy("__range", group).orderBy(*order)))
    sizes = at.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.count("*").alias("__size"))
    before = Window.partitionBy("__g").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__g", "__r", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    j = local.join(sizes, (F.col("__range") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    out = j.withColumn(name, (F.col("__before") + F.col("__n")).cast("int")).select(*df.columns, name)
    return out.unionByName(df.where(~F.coalesce(eligible, F.lit(False))).withColumn(name, F.lit(None).cast("int")))


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap) of every bin, empty ones too; a confidence of 1 belongs to the last."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int"))
    g = df.where(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("int")).alias("a"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    d = every.join(g, "bin", "left")
    return d.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(n, ece, brier): expected calibration error and mean squared error."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(confidence) * bins).cast("int"))
    y = F.col(correct).cast("int")
    g = df.where(F.col(confidence).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(confidence).alias("c"), F.sum(y).alias("a"), F.sum((F.col(confidence) - y) ** 2).alias("q"))
    return g.agg(F.sum("n").alias("n"), F.round(F.sum(F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("q") / F.sum("n"), 6).alias("brier"))


def normalised_weights(problems: DataFrame) -> DataFrame:
    """(ps_id, requirement, weight, share): weights over their sum; the last requirement takes what rounding leaves of 1."""
    d = problems.select("ps_id", F.posexplode("requirements").alias("i", "r")).select("ps_id", "i", F.col("r.id").alias("requirement"), F.col("r.weight").alias("weight"))
    w = Window.partitionBy("ps_id")
    raw = F.round(F.col("weight") / F.nullif(F.sum("weight").over(w), F.lit(0.0)), 6)
    d = d.withColumn("raw", raw).withColumn("last", F.col("i") == F.max("i").over(w))
    rest = F.sum(F.when(F.col("last"), F.lit(0.0)).otherwise(F.col("raw"))).over(w)
    return d.select("ps_id", "requirement", "weight", F.round(F.when(F.col("last"), 1.0 - rest).otherwise(F.col("raw")), 6).alias("share"))


def prf(matched: Column, predicted: Column, expected: Column) -> list[Column]:
    """precision, recall and F1; with nothing predicted the precision is 1 if nothing was expected, and with nothing expected the recall is 1."""
    p = F.when(predicted == 0, F.when(expected == 0, 1.0).otherwise(0.0)).otherwise(matched / predicted)
    r = F.when(expected == 0, 1.0).otherwise(matched / expected)
    f = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]
