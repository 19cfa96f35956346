import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deckmill.functions import text as tx
from deckmill.operators import content, matching, scoring


def one(spark, c, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(c).collect()]


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, tx.squeeze(v), " a \t b\n", "", None) == ["a b", "", None]
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    mixed = [f"x{a}{b}y {a} z{b}" for a in spaces for b in spaces]
    assert one(spark, tx.squeeze(v), *mixed) == [" ".join(m.split()) for m in mixed]
    assert one(spark, tx.problem_id(v), "PS-26000044", " 25017 ", "Problem Statement ID: 7", None, "") == ["26000044", "25017", "7", "UNASSIGNED", "UNASSIGNED"]
    assert one(spark, tx.slug(v, "x"), "a b/c..", "??", None) == ["a-b-c", "x", "x"]
    assert one(spark, tx.brief(v, 8), "abcdefghij", "abc") == ["abcde...", "abc"]
    assert one(spark, tx.fold(v), "Straße  X") == ["strasse x"]
    assert one(spark, tx.word_count(v), "a-b c's 12/3 - x", "a-" * 100_000, "") == [4, 1, 0]


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([("p", [("r1", 2.0), ("r2", 1.0)]), ("q", [("a", 1.0), ("b", 1.0), ("c", 1.0)])], "ps_id string, requirements array<struct<id:string,weight:double>>")
    got = defaultdict(list)
    for r in scoring.normalised_weights(df).collect():
        got[r.ps_id].append(r.share)
    assert got["p"] == [0.666667, 0.333333]
    assert sum(got["q"]) == pytest.approx(1.0, abs=1e-12)


def test_weighted_group_and_missing_evidence(spark):
    df = spark.createDataFrame([("a", "x", 80.0, 2), ("b", "x", 80.0, 0), ("b", "y", None, 0)], "k string, c string, s double, m int")
    g = {r.k: (r.score, r.unpenalized, r.penalty) for r in scoring.weighted_group(df.where("k = 'a'"), ["k"], "c", "s", {"x": 1.0}, F.col("m")).collect()}
    assert g == {"a": (60.0, 80.0, 20.0)}
    g = {r.k: r.score for r in scoring.weighted_group(df, ["k"], "c", "s", {"x": 1.0, "y": 1.0}, F.col("m")).collect()}
    assert g == {"a": None, "b": None}


def test_ranks_and_buckets(spark):
    df = spark.createDataFrame([("a", 80.0), ("b", 90.0), ("c", None)], "id string, f double").withColumn("g", F.lit(1))
    r = scoring.ranked(df, "g", [F.col("f").desc(), F.col("id")], F.col("f").isNotNull()).select("id", "place", scoring.bucket(F.col("f"), {"A": 90, "B": 75, "C": 60}, "D", "REVIEW").alias("b")).collect()
    assert {x.id: (x.place, x.b) for x in r} == {"a": (2, "B"), "b": (1, "A"), "c": (None, "REVIEW")}


def test_ranks_over_ranges_with_a_hot_group_and_ties(spark):
    rnd = random.Random(9)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), float(rnd.randrange(4)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, f double, id int").repartition(5)
    got = {r.id: r.place for r in scoring.ranked(df, "g", [F.col("f").desc(), F.col("id")], F.col("f") > 0).collect()}
    exp = {i: None for _, f, i in rows if f == 0}
    for g in ("hot", "a", "b", None):
        for n, (_, i) in enumerate(sorted((-f, i) for x, f, i in rows if x == g and f > 0), 1):
            exp[i] = n
    assert got == exp
    assert scoring.ranked(df.where("f > 9"), "g", [F.col("id")], F.col("f") > 0).count() == 0


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, True), (0.1, False), (1.0, True), (None, True)], "c double, y boolean")
    assert scoring.calibration_error(df.where("c < 1"), "c", "y").first().brier == pytest.approx(0.01)
    bins = {r.bin: r.n for r in scoring.calibration_bins(df, "c", "y").collect()}
    assert len(bins) == 10 and bins[9] == 2 and bins[1] == 1 and bins[5] == 0


def test_prf_and_cer(spark):
    df = spark.createDataFrame([(1, "Alpha Beta", "alpha gamma"), (2, "a a b", "a b b"), (3, "", "")], "k int, r string, h string")
    got = {r.k: (r.n_matched, r.precision, r.recall) for r in matching.word_overlap(df, "k", "r", "h").collect()}
    assert got == {1: (1, 0.5, 0.5), 2: (2, 0.666667, 0.666667)}
    df = spark.createDataFrame([(1, "sitting!", "kitten"), (2, "", ""), (3, "", "x")], "k int, r string, h string")
    assert {r.k: r.cer for r in matching.character_error(df.where("k > 1"), "k", "r", "h").collect()} == {2: 0.0, 3: 1.0}


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = matching.upsert(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, matching.upsert(once, b, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, matching.upsert(a, b, ["k"], keep_existing=True).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    exp = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in matching.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == exp


def test_as_of(spark):
    rows = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    marks = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (3, 1, "c")], "k int, t int, v string")
    assert {(r.k, r.t): r.seen for r in matching.as_of(rows, marks, "k", "t", "v", "seen").collect()} == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_profile_of_blocks(spark):
    texts = ["Robust scalable platform with better outcomes", "See https://a.b/c. for it. Yes. ok", "Note: short. One. Two.", "a • b", "word " * 45, "no end"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(F.col("v"), content.profile(F.col("v")).alias("p")).select("p.*")
    got = [tuple(r) for r in df.collect()]
    assert [r[2] for r in got] == [0, 2, 3, 0, 0, 0]  # links are left out; a text may have no sentence end
    assert [r[3] for r in got] == [False, False, True, False, False, False] and [r[4] for r in got] == [False, False, False, True, False, False]
    assert [r[5] for r in got] == [False, False, True, False, True, False] and [r[6] for r in got] == [True, True, False, True, False, True]


def test_broad_claims_need_a_vague_sentence(spark):
    texts = ["Robust scalable platform for our better outcomes", "A fast result in 20 ms for all people", "fast and secure", "We offer a secure and fast path. It has 20 users.", "It is breakfast time in our real-time view", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(content.broad_terms(F.col("v"))).collect()]
    assert got == [["better", "robust", "scalable"], [], [], ["fast", "secure"], ["real-time"], []]


def test_structure_of_paragraphs_and_empty_slides(spark):
    long = "Robust scalable platform and better outcomes. " + "This long explanation repeats implementation details without concise pointers. " * 8
    rows = [(1, 1, ["Title", long]), (2, 2, ["Title"]), (3, 2, None), (4, 3, ["T", "Short pointer", long]), (1, 1, ["Title", long])]
    df = spark.createDataFrame(rows, "slide_key long, deck_id long, text array<string>")
    got = {r.deck_id: r for r in content.content_structure(df).collect()}
    assert (got[1].paragraph_ratio, got[1].pointer_ratio, got[1].heavy_ratio, got[1].ambiguous_ratio, got[1].structure_score) == (1.0, 0.0, 1.0, 1.0, 0.0)
    assert (got[2].paragraph_ratio, got[2].heavy_ratio, got[2].structure_score) == (0.0, 0.0, 0.0)
    assert got[3].ambiguous_ratio == 0.5
    n = {r.deck_id: (r.n_blocks, r.filler_ratio) for r in content.filler_ratio(df).collect()}
    assert n == {1: (1, 0.0), 2: (0, None), 3: (2, 0.0)}
