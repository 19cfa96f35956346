import pytest
from pyspark.sql import functions as F

from deckmill.functions.lineage import cut
from deckmill.llm import boilerplate as b
from deckmill.llm import oracle, queries


@pytest.mark.parametrize("name", ["p1_found", "p1_forms", "p2_classes", "p3_found", "p4_found", "p5_found", "p5_clean", "p5_templates", "p6_found", "p6_ranked"])
def test_found_equals_sql(name, same):
    same(queries.queries()[name], oracle.oracle_sql()[name])


def test_lines_and_removal(spark):
    rows = [(i, i, [f"Page {i}\nbody {'x' * i}", None, " Page  7 "]) for i in range(1, 7)] + [(7, 7, None), (8, 8, []), (9, None, ["Page 1"])]
    docs = spark.createDataFrame(rows, "slide_key long, deck_id long, text array<string>").withColumn("node", F.lit(1)).withColumn("leaf", F.lit(1)).withColumn("ps_id", F.lit("zz"))
    members = b.sources(spark.createDataFrame([("p", i) for i in range(1, 9)] + [("p", 1), ("p", None), (None, 1), ("q", 1)], "ps_id string, deck_id long"), "ps_id", "deck_id")
    got = [(r.ps_id, r.line, r.n_docs) for r in b.repeated_lines(docs, members, "ps_id", "deck_id", "text").collect()]
    assert got == [("p", "page #", 6)]
    clean = {r.slide_key: r.text for r in b.without_repeated_lines(docs, "slide_key", members, "ps_id", "deck_id", "text").collect()}
    assert clean[2] == ["body xx"] and clean[7] is None and clean[8] == [] and clean[9] == ["Page 1"]
    assert b.repeated_lines(docs.where("slide_key < 0"), members, "ps_id", "deck_id", "text").count() == 0


def test_share_and_count_limits(spark):
    docs = spark.createDataFrame([(i, ["Same line"]) for i in range(5)], "deck_id long, text array<string>")
    for total, n in ((20, 1), (21, 0)):
        members = b.sources(spark.createDataFrame([("p", i) for i in range(total)], "ps_id string, deck_id long"), "ps_id", "deck_id")
        assert b.repeated_lines(docs, members, "ps_id", "deck_id", "text").count() == n


def test_tree_prunes_by_depth_and_merges(spark):
    """Nodes of several partitions add up; a deeper tree has fewer lines below its heavy nodes; the exact result is the same at any depth."""
    rows = [(i, [f"Our team tested {w} with care", "Made by the office of forms", f"{w} {w} unlike"]) for i, w in enumerate("abcdefgh")]
    docs = spark.createDataFrame(rows * 2, "deck_id long, text array<string>").repartition(3)
    members = cut(b.sources(spark.createDataFrame([("p", i) for i in range(8)], "ps_id string, deck_id long"), "ps_id", "deck_id"))
    sizes, results = {}, set()
    for depth in (1, 3, 4, 9):
        heavy = b.heavy_nodes(docs, members, "ps_id", "deck_id", "text", depth=depth).collect()
        sizes[depth] = len(heavy)
        assert all(r.n_most >= 8 for r in heavy)  # an upper bound of the 8 decks
        found = b.repeated_lines(docs, members, "ps_id", "deck_id", "text", depth=depth)
        results.add(tuple(sorted((r.line, r.n_docs) for r in found.collect())))
    assert sizes == {1: 2, 3: 2, 4: 1, 9: 1} and results == {(("made by the office of forms", 8),)}


def test_templates_have_slots(spark):
    rows = [(i, [x for k, x in enumerate(("Share this deck with tag alpha", "Share this deck with tag beta", "Only this line")) if i % 2 == k % 2 or k == 2]) for i in range(12)]
    docs = spark.createDataFrame(rows, "deck_id long, text array<string>")
    members = cut(b.sources(spark.createDataFrame([("p", i) for i in range(12)], "ps_id string, deck_id long"), "ps_id", "deck_id"))
    found = cut(b.repeated_lines(docs, members, "ps_id", "deck_id", "text"))
    assert sorted((r.template, r.n_lines, r.n_docs) for r in b.templates(found, "ps_id").collect()) == [("only this line", 1, 12), ("share this deck with tag *", 2, 6)]
