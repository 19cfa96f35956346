"""The N best rows of every group (problem 6).

Each partition finds, for every group it holds, its local N-th best row in the
full order (ties included). At least N rows of the group are as good as that,
so it is a valid lower bound, and so is the best of the bounds of all
partitions. The bounds are joined to the rows, which drops all but at most N
rows of a group in each partition before anything is ranked: a group with
millions of rows sends a few to the task that ranks it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.joins import small_side
from ..functions.lineage import cut


def _best(tables: list, group: list[str], order: list[str], n: int):
    """(table, place): the first ``n`` rows of each group, sorted by group, with their place from 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pa.concat_tables(tables).combine_chunks()
    code = np.zeros(t.num_rows, np.int64)
    for c in group:
        values = pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode")
        code = np.unique(code * (len(values.dictionary) + 1) + np.asarray(values.indices), return_inverse=True)[1].astype(np.int64)
    keyed = t.select(order).append_column("__code", pa.array(code))
    index = np.asarray(pc.sort_indices(keyed, [("__code", "ascending"), *[(c, "ascending") for c in order]]))
    code = code[index]
    at = np.arange(len(code))
    place = at - np.maximum.accumulate(np.where(np.r_[True, code[1:] != code[:-1]], at, 0))
    return t.take(pa.array(index[place < n])), place[place < n]


def partition_bounds(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Per partition and group the local n-th of the ascending ``order`` columns; groups with fewer rows there give none.

    Nothing is shuffled. A task holds the best rows of its groups and as many
    new ones again before it sorts them, so its time is that of sorting its rows.
    """
    cols = [*group, *order]
    schema = T.StructType([df.schema[c] for c in cols])

    def local(batches):
        import pyarrow as pa

        held, fresh, rows = None, [], 0
        for batch in batches:
            fresh.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows > max(200_000, held.num_rows if held else 0):
                held, fresh, rows = _best([held, *fresh] if held else fresh, group, order, n)[0], [], 0
        if held or fresh:
            best, place = _best([held, *fresh] if held else fresh, group, order, n)
            yield from best.filter(pa.array(place == n - 1)).select(cols).combine_chunks().to_batches()

    return df.select(*cols).mapInArrow(local, schema)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, rank: str = "rank_in_group") -> DataFrame:
    """The first ``n`` rows of every group by the ascending, null-free ``order`` columns, with their rank.

    ``order`` should end with a key that makes it total; rows that are equal in
    all of it are ranked in any order but never more than ``n`` are kept. Groups
    with fewer rows come out whole; a null group is a group; an empty table
    gives an empty result.
    """
    group, order = list(group), list(order)
    o = F.struct(*order)
    bound = small_side(cut(partition_bounds(df, group, order, n).groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(F.min(o).alias("__bound"))))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    kept = df.join(bound, cond, "left").where(F.col("__bound").isNull() | (o <= F.col("__bound")))
    w = Window.partitionBy(*group).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).drop("__bound", *[f"__{c}" for c in group])


def score_or_zero(c: str) -> Column:
    """Descending score as an ascending key: null and NaN count as 0, -0.0 as 0.0."""
    v = F.col(c)
    return (F.lit(0.0) - F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)) + F.lit(0.0)


def best_submissions(subs: DataFrame, n: int = 5) -> DataFrame:
    """(ps_id, submission_id, rank_in_group): the ``n`` best submissions of every statement.

    Of several scorings of a submission only the latest counts; one with a null
    time is earlier than any. Rows without a final score, with NaN or with the
    status 'failed' aren't eligible; a null status is.
    """
    latest = F.max(F.struct("scored_at", "final_score", "proposal_score", "deck_quality_score", "status")).alias("x")
    rows = subs.groupBy("ps_id", "submission_id").agg(latest).select("ps_id", "submission_id", "x.*")
    ok = F.col("final_score").isNotNull() & ~F.isnan("final_score") & ~F.col("status").eqNullSafe("failed")
    keyed = rows.where(ok).select(
        "ps_id", "submission_id", score_or_zero("final_score").alias("k1"), score_or_zero("proposal_score").alias("k2"), score_or_zero("deck_quality_score").alias("k3"),
        F.lower(F.coalesce("submission_id", F.lit(""))).alias("k4"), F.coalesce("submission_id", F.lit("")).alias("k5"),
    )
    return top_n(keyed, ["ps_id"], ["k1", "k2", "k3", "k4", "k5"], n).select("ps_id", "submission_id", "rank_in_group")
