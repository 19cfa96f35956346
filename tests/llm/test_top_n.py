import random
from datetime import datetime

from pyspark.sql import functions as F

from deckmill.llm import top_n


def test_against_sort_with_hot_group_and_ties(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else rnd.choice("abcdef"), float(rnd.randrange(5)), f"id{i:05d}") for i in range(4000)] + [(None, 1.0, "z"), ("few", 2.0, "y")]
    df = spark.createDataFrame(rows, "g string, k double, id string").withColumn("__bound", F.lit(0)).drop("__bound").repartition(6)
    got = {}
    for r in top_n.top_n(df, ["g"], ["k", "id"], 5).collect():
        got.setdefault(r.g, []).append((r.rank_in_group, r.k, r.id))
    exp = {}
    for g in {r[0] for r in rows}:
        exp[g] = [(i, k, x) for i, (k, x) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == g)[:5], 1)]
    assert {g: sorted(v) for g, v in got.items()} == exp


def test_bounds_prune(spark):
    df = spark.range(0, 10_000, 1, 4).select(F.lit("g").alias("g"), F.col("id").alias("k"))
    b = top_n.partition_bounds(df, ["g"], ["k"], 3).collect()
    assert sorted(r.k for r in b) == [2, 2502, 5002, 7502]


def test_submissions(spark):
    t = lambda d: datetime(2025, 1, d)
    nan = float("nan")
    rows = [
        ("p", "B", 9.0, 1.0, 1.0, "scored", t(1)), ("p", "B", 3.0, 1.0, 1.0, "scored", t(2)), ("p", "a", 3.0, None, 1.0, "scored", t(1)), ("p", "C", 3.0, 1.0, None, None, t(1)), ("p", "d", nan, 1.0, 1.0, "scored", t(1)),
        ("p", "e", None, 1.0, 1.0, "scored", t(1)), ("p", "f", 10.0, 1.0, 1.0, "failed", t(1)), ("q", "x", -0.0, 0.0, 0.0, "scored", t(1)), ("q", "W", 0.0, -0.0, 0.0, "scored", t(1)), ("q", "W", 0.0, -0.0, 0.0, "scored", t(1)),
    ]
    df = spark.createDataFrame(rows, "ps_id string, submission_id string, final_score double, proposal_score double, deck_quality_score double, status string, scored_at timestamp").withColumn("x", F.lit(1))
    got = sorted((r.ps_id, r.rank_in_group, r.submission_id) for r in top_n.best_submissions(df, 3).collect())
    assert got == [("p", 1, "B"), ("p", 2, "C"), ("p", 3, "a"), ("q", 1, "W"), ("q", 2, "x")]
    assert top_n.best_submissions(df.where("ps_id = 'none'")).count() == 0


def test_many_groups_and_a_hot_one(spark):
    """300 000 groups and one of 300 000 rows: bounds only of groups with n rows in a partition, and the hot group cut down before it is ranked."""
    df = spark.range(0, 600_000, 1, 6).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"), F.xxhash64("id").alias("k"), "id")
    b = top_n.partition_bounds(df, ["g"], ["k", "id"], 3).collect()
    assert {r.g for r in b} == {-1} and len(b) == 6
    got = top_n.top_n(df, ["g"], ["k", "id"], 3)
    assert got.count() == 300_003
    best = [r.id for r in df.where("g = -1").orderBy("k", "id").limit(3).collect()]
    assert [r.id for r in got.where("g = -1").orderBy("rank_in_group").collect()] == best


def test_bounds_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.range(0, 5_000, 1, 2).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("é"), F.col("id") % 7)).alias("g"), (F.col("id") * 7919 % 101).cast("double").alias("k"), F.col("id"))
        got = {tuple(r) for r in top_n.top_n(df, ["g"], ["k", "id"], 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(None if i % 3 == 0 else f"é{i % 7}", float(i * 7919 % 101), i) for i in range(5_000)]
    exp = {(g, k, i, n) for x in {r[0] for r in rows} for n, (g, k, i) in enumerate(sorted((r for r in rows if r[0] == x), key=lambda r: r[1:])[:4], 1)}
    assert got == exp
