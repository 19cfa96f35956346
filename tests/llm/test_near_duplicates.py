import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckmill.llm import near_duplicates as n
from deckmill.llm import oracle, queries


def test_found_equals_sql(same):
    same(queries.queries()["p2_found"], oracle.oracle_sql()["p2_found"])


def test_miss_probability():
    assert n.SLIDES.miss_probability(0.7) < 2e-4 and n.DECKS.miss_probability(0.6) < 2e-4


def test_estimate_of_retained_bits():
    rng = np.random.default_rng(0)
    plan = n.Plan(0.5, 64, 4)
    for j in (0.2, 0.5, 0.8):
        est = []
        for _ in range(40):
            both = int(300 * j)
            x = rng.integers(-(2**62), 2**62, 600 - both)
            a, b = x[:300], np.concatenate([x[:both], x[300:]])
            m = n.minima(np.concatenate([a, b]), np.array([0, 300]), plan)
            s = n.signature(m).view(np.uint64)
            est.append(n.estimate(64 - int(s[0] ^ s[1]).bit_count()))
        assert np.mean(est) == pytest.approx(both / (600 - both), abs=0.07)


def _slides(spark, rows):
    return spark.createDataFrame(rows, "slide_key long, text array<string>").withColumn("key", F.lit("x")).withColumn("elements", F.lit(1))


def _assets(spark, rows=()):
    return spark.createDataFrame(list(rows), "deck_id long, sha256 string").withColumn("key", F.lit(1))


def _pairs(slides, assets):
    return {(r.record_type, r.key_a, r.key_b) for r in n.all_pairs(*n.similar(slides, assets)).collect()}


def test_against_brute_force_with_copies_and_nulls(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rnd.choice(vocab) for _ in range(90)]
        for k in range(6):
            w = list(words)
            for _ in range(k):
                w[rnd.randrange(90)] = rnd.choice(vocab)
            rows.append((base * 10 + k, [" ".join(w[:40]), None, " ".join(w[40:])]))
        rows.append((base * 10 + 9, [" ".join(words)]))
    rows += [rows[0], (990, None), (991, []), (992, ["too short"]), (993, [None])]
    sets = {}
    for k, t in rows:
        w = " ".join(x for x in t or [] if x is not None).split()
        if len(w) >= 40:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    exp = {("slide", a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert _pairs(_slides(spark, rows), _assets(spark)) == exp
    links, placed = n.similar(_slides(spark, rows), _assets(spark))
    c = {r.key: r for r in n.classes(links, placed).collect()}
    assert set(c) == set(sets) and c[9].class_id == c[0].class_id == 0


def test_decks_ignore_case_and_nulls(spark):
    rows = [(1, x) for x in "abcde"] + [(2, x.upper()) for x in "abcde"] + [(3, x) for x in "abcdx"] + [(3, None)] + [(4, x) for x in "abcd"] + [(None, "a")]
    assert _pairs(_slides(spark, []), _assets(spark, rows)) == {("deck", 1, 2), ("deck", 1, 3), ("deck", 2, 3)}


def test_empty_tables(spark):
    assert _pairs(_slides(spark, []), _assets(spark)) == set()
