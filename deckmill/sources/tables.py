"""Readers of the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.lineage import cut


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``, one parquet file or folder per table."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key's rows as one; redelivered rows are equal but for ``loaded_at``, of which the least stays if it is there.

    Only rows whose key comes again, a few, are shuffled with their columns.
    """
    again = small_side(cut(df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__again"))))
    same = F.col(key).eqNullSafe(F.col("__again"))
    twice = df.join(again, same, "left_semi")
    rest = [c for c in df.columns if c not in (key, "loaded_at")]
    first = F.min_by(F.struct(*rest), "loaded_at") if "loaded_at" in df.columns else F.first(F.struct(*rest))
    m = twice.groupBy(key).agg(first.alias("__m"), *([F.min("loaded_at").alias("loaded_at")] if "loaded_at" in df.columns else []))
    one = m.select(*[F.col(c) if c in (key, "loaded_at") else F.col(f"__m.{c}").alias(c) for c in df.columns])
    return df.join(again, same, "left_anti").unionByName(one)


def norm_hash(col):
    """A hash key in one letter case, null when blank."""
    return F.nullif(F.lower(F.trim(col)), F.lit(""))
