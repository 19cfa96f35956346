import itertools
import json
import random

from pyspark.sql import functions as F

from deckmill.functions import labels
from deckmill.operators import accuracy, responses


def test_page_labels(spark):
    n = spark.range(1, 60).select("id", labels.roman(F.col("id")).alias("r"), labels.letters(F.col("id")).alias("a")).collect()
    assert [n[i - 1].r for i in (1, 4, 9, 14, 40, 49)] == ["I", "IV", "IX", "XIV", "XL", "XLIX"] and [n[i - 1].a for i in (1, 26, 27, 28, 53)] == ["a", "z", "aa", "ab", "ba"]
    assert spark.range(1).select(labels.roman(F.lit(1994)), labels.roman(F.lit(0))).first()[:] == ("MCMXCIV", "")
    pages = spark.createDataFrame([("d", i) for i in range(1, 6)] + [("e", 1)], "deck_id string, page int")
    entries = spark.createDataFrame([("d", 1, "r", None, None), ("d", 3, "D", "A-", 7)], "deck_id string, page int, style string, prefix string, first int")
    assert [r.label for r in labels.page_labels(pages, entries).orderBy("deck_id", "page").collect()] == ["i", "ii", "A-7", "A-8", "A-9", "1"]


def test_selection(spark):
    df = spark.createDataFrame([("1, 3-5,4",), ("5-3",), ("x",), (None,), ("0",), ("1-20001",)], "v string")
    assert [r[0] for r in df.select(labels.selection(F.col("v"))).collect()] == [[1, 3, 4, 5], None, None, None, None, None]


def test_responses(spark):
    def answer(**more):
        one = {"score": 80, "confidence": 0.5, "evidence_slides": [1], "explanation": "x", "missing_evidence": [], "subcriteria": []}
        return json.dumps({"scores": {"a": one, "b": one | more}})

    rows = [("ok", answer()), ("range", answer(score=120)), ("conf", answer(confidence=2)), ("slide", answer(evidence_slides=[9])), ("cite", answer(evidence_slides=[])), ("child", answer(evidence_slides=[], subcriteria=[{"id": "c", "score": None, "evidence_slides": [2]}])), ("null", answer(score=None, evidence_slides=[])), ("bad", "no json"), ("part", json.dumps({"scores": {"a": {"score": None}, "z": {}}}))]
    df = spark.createDataFrame(rows, "deck_id string, response string")
    slides = spark.createDataFrame([(k, n) for k, _ in rows for n in (1, 2)], "deck_id string, slide_number int")
    got = {r.deck_id: r.errors for r in responses.checked(df, slides, ["a", "b"]).collect()}
    assert got == {"ok": [], "range": ["score_range"], "conf": ["confidence_range"], "slide": ["unknown_slide"], "cite": ["uncited_score"], "child": [], "null": [], "bad": ["not_json"], "part": ["missing_component", "unknown_component"]}


def test_reaggregation_and_findings(spark):
    c = spark.createDataFrame([("d", "r1", 20.0), ("d", "r2", 100.0), ("e", "r1", 50.0)], "k string, id string, score double")
    w = spark.createDataFrame([(k, "r1", 2 / 3) for k in "de"] + [(k, "r2", 1 / 3) for k in "de"], "k string, id string, weight double")
    assert {r.k: r.score for r in responses.reaggregated(c, w, ["k"]).collect()} == {"d": round(20 * 2 / 3 + 100 / 3, 6), "e": None}
    f = responses.findings(spark.createDataFrame([("d", "m", 10.0), ("d", "n", 90.0), ("d", "o", None), ("d", "p", 70.0)], "k string, m string, s double"), "k", "m", "s")
    assert {r.m: r.kind for r in f.collect()} == {"m": "weakness", "n": "strength", "o": "ambiguous"}


def test_text_matches(spark):
    s = "k int, text string, n int"
    m = accuracy.positional_matches(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3)], s), spark.createDataFrame([(1, "a", 5), (1, "c", 6), (1, "a", 7), (1, "a", 8)], s), ["k"])
    assert sorted((r.reference_n, r.hypothesis_n) for r in m.collect()) == [(1, 5), (3, 7)]
    r = accuracy.text_recall(spark.createDataFrame([(1, "Hello  World"), (1, "nope"), (2, None)], "k int, text string"), spark.createDataFrame([(1, "say hello world"), (3, "x")], "k int, text string"), "k")
    assert {x.k: x.recall for x in r.collect()} == {1: 0.5, 2: 1.0, 3: 1.0}


def test_edges(spark):
    ref = spark.createDataFrame([("g", "n1", "n2"), ("g", "n2", "n3")], "g string, source string, target string")
    pred = spark.createDataFrame([("g", "h2", "h1", "verified"), ("g", "h1", "h3", "verified"), ("g", "h2", "h3", "partial")], "g string, source string, target string, status string")
    nodes = spark.createDataFrame([("g", f"n{i}", f"h{i}") for i in (1, 2, 3)], "g string, reference_id string, hypothesis_id string")
    r = accuracy.edge_agreement(ref, pred, nodes, ["g"]).first()
    assert (r.n_matched, r.precision, r.recall, r.direction) == (1, 0.5, 0.5, 0.0)


def test_connectivity_against_pairs(spark):
    rnd = random.Random(7)
    nodes = list(range(30))
    graphs = [[(rnd.randrange(30), rnd.randrange(30)) for _ in range(20)] for _ in range(2)]

    def same(edges):
        comp = {n: n for n in nodes}
        for _ in nodes:
            for a, b in edges:
                comp[a] = comp[b] = min(comp[a], comp[b])
        return comp

    a, b = map(same, graphs)
    exp = sum((a[x] == a[y]) == (b[x] == b[y]) for x, y in itertools.combinations(nodes, 2)) / (30 * 29 / 2)
    e = [spark.createDataFrame(g, "a int, b int") for g in graphs]
    assert accuracy.connectivity(spark.createDataFrame([(n,) for n in nodes], "node int"), *e).first().agreement == round(exp, 6)


def test_component_records(spark):
    import json

    from deckmill.operators import responses

    part = lambda i, s, **m: {"id": i, "score": s, "confidence": 1.0, "evidence_slides": [1], "explanation": "", "missing_evidence": []} | m
    one = {"score": 80, "confidence": 0.5, "evidence_slides": [1], "explanation": "", "missing_evidence": ["a"]}
    scores = {"problem_statement_alignment": one | {"subcriteria": [part("r1", 20), part("r2", 100)]}, "innovation": one | {"subcriteria": [part("differentiation", 50, missing_evidence=["a", "b"]), part("problem_specific_value", 100), part("justification", 0)]}, "prototype_evidence": one | {"subcriteria": [part("legacy", 10)]}}
    slides = spark.createDataFrame([(1, 1), (2, 1)], "deck_id long, slide_number int")
    answers = responses.checked(spark.createDataFrame([(1, json.dumps({"scores": scores})), (2, json.dumps({"scores": scores})), (3, "no")], "deck_id long, response string"), slides, list(scores))
    w = spark.createDataFrame([(1, {"r1": 2.0, "r2": 1.0})], "deck_id long, weights map<string,double>")
    got = {r.deck_id: {k: tuple(v) for k, v in r.scores.items()} for r in responses.component_records(answers, w).collect()}
    assert got[1] == {"problem_statement_alignment": (round((20 * 2 + 100) / 3, 6), 1.0, 1), "innovation": (60.0, 1.0, 2), "prototype_evidence": (80.0, 0.5, 1)}
    assert got[2]["problem_statement_alignment"][0] is None and set(got) == {1, 2}
