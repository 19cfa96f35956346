"""Broadcasting behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what may be sent to every executor: rows, and bytes of their values written out.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` hinted for broadcast if it is within both bounds, else unhinted for a shuffled join.

    Counting stops at the row bound. ``df`` should be cheap to run: cut from its lineage or read from a narrow table.
    """
    n, size = df.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("__b")).agg(F.count("*"), F.sum("__b")).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df
