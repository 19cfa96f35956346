import random

import numpy as np
from pyspark.sql import functions as F

from deckmill.functions.lineage import cut
from deckmill.llm import packing as p
from deckmill.llm import queries


def test_patterns():
    assert set(p.patterns(5, 2)) == {(5,), (4, 1), (3, 2)}
    assert all(sum(x) == 32 and len(x) <= 4 for x in p.patterns()) and len(set(p.patterns())) == len(p.patterns())


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = p.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and g.max() < 1e-6 and np.abs(g[x > 1e-9]).max(initial=0) < 1e-6


def check(rows, capacity):
    """rows: (doc_id, piece, start, n, container) against sizes."""
    used, pieces = {}, {}
    for d, q, s, n, c in rows:
        used[c] = used.get(c, 0) + n
        pieces.setdefault(d, []).append((q, s, n))
    assert max(used.values()) <= capacity
    return used, pieces


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(4)
    sizes = [0, 0, 2048, 2049, 10_000] + [min(2000, int(rnd.lognormvariate(5, 1))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").withColumn("piece", F.lit(1)).withColumn("container_id", F.lit(1))
    placed = p.packed(cut(df), "doc_id", "n")
    used, pieces = check([tuple(r) for r in placed.collect()], p.CAPACITY)
    assert {d: sum(x[2] for x in q) for d, q in pieces.items()} == dict(enumerate(sizes))
    assert all(len(q) == max(1, -(-sizes[d] // p.CAPACITY)) and sorted(x[1] for x in q) == [i * p.CAPACITY for i in range(len(q))] for d, q in pieces.items())
    assert sum(sizes) / (p.CAPACITY * len(used)) > 0.99
    again = {(r.doc_id, r.piece): r.container_id for r in p.packed(cut(df.repartition(7)), "doc_id", "n").collect()}
    assert again == {(r.doc_id, r.piece): r.container_id for r in placed.collect()}


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, -5), (3, 0), (3, 0)], "doc_id long, n int")
    assert len(p.packed(df, "doc_id", "n").collect()) == 4
    assert p.packed(df.where("doc_id < 0"), "doc_id", "n").count() == 0


def test_query_keeps_every_document(spark, data, duck):
    q = queries.queries()
    rows = [tuple(r) for r in q["p8_packed"](spark, data).collect()]
    used, pieces = check(rows, p.CAPACITY)
    assert set(pieces) == {r[0] for r in duck.execute("select doc_id from documents").fetchall()}
    total = q["p7_ids"](spark, data).agg(F.sum(F.size("ids"))).first()[0]
    assert sum(used.values()) == total
