import json

import pytest
from pyspark.sql import functions as F

from deckmill.functions.lineage import cut
from deckmill.operators import checks as c
from deckmill.operators import metrics, projection
from deckmill.sources import packages
from tests.test_sources import R, package, shape, slide


@pytest.fixture(scope="module")
def deck(spark):
    pic = f'<p:pic><p:nvPicPr><p:cNvPr id="7" name="Process diagram"/></p:nvPicPr><p:blipFill><a:blip r:embed="i1" xmlns:r="{R}"/></p:blipFill><p:spPr><a:xfrm><a:off x="100" y="300"/><a:ext cx="500" cy="400"/></a:xfrm></p:spPr></p:pic>'
    first = slide(shape(2, "T", 100, 50, 800, 100, "The problem of seats", '<p:ph type="title"/>') + shape(3, "B", 100, 200, 800, 80, "Clerks wait for seat maps at the depot.") + pic)
    raw = package(**{"ppt/slides/slide1.xml": first, "ppt/slides/slide2.xml": slide(shape(2, "T", 100, 50, 800, 100, "Next step", '<p:ph type="title"/>'))})
    parts = spark.createDataFrame(packages.package_parts("x", raw), packages.PARTS)
    rels = packages.relationships(parts)
    order = packages.slide_order(parts, rels)
    objects, assets = cut(packages.objects(parts, order)), cut(packages.media(parts, rels))
    return objects, cut(projection.object_assets(objects, order, rels, assets)), assets


@pytest.fixture(scope="module")
def deck_metrics(deck):
    return cut(metrics.deck_metrics(metrics.measured(projection.slide_rows(*deck[:2]))))


def test_from_a_package_to_scores(deck, deck_metrics):
    objects, links, assets = deck
    assert [(r.asset_id, r.slide_number) for r in links.collect()] == [("asset-0001", 2)] and projection.referenced_assets(assets, links).count() == 1
    rows = {r.slide_number: r for r in projection.slide_rows(objects, links).collect()}
    s = rows[2]
    assert s.title == "The problem of seats" and [b.text for b in s.blocks] == ["The problem of seats", "Clerks wait for seat maps at the depot."] and s.slide_type == "architecture"
    assert [(v.role, v.content_status) for v in s.visuals] == [("diagram_candidate", "low_confidence")] and s.visual_area_ratio == pytest.approx(0.2)
    assert s.text_density == pytest.approx(0.08 + 0.064) and rows[1].visuals is None
    r = deck_metrics.first()
    assert (r.title_coverage, r.n_slides, r.n_phases_missing) == (1.0, 2, 3)
    e = metrics.evaluated(deck_metrics).first()
    assert e.deck_quality.score is not None and e.status == "REVIEW"


def test_text_read_from_an_image(spark, deck):
    objects, links, _ = deck
    deck_id = links.first().deck_id
    texts = spark.createDataFrame([(deck_id, "asset-0001", "read text", 0.9, "verified"), (deck_id, "asset-0001", "poor", 0.5, "verified")], "deck_id string, asset_id string, text string, confidence double, status string")
    v = projection.slide_rows(objects, links, texts).where("slide_number = 2").first().visuals[0]
    assert (v.content_status, v.ocr_text) == ("extracted", "read text")


def test_ocr_results(spark):
    item = "struct<text:string,x:double,y:double,w:double,h:double,confidence:double>"
    nan = float("nan")
    rows = [("ok", [], [], 0.5), ("odd", [], [], None), ("ok", None, [], 1.5), ("ok", [("a", nan, 0.0, 0.0, 0.0, 1.0)], [], nan), (None, [], [], 0.0)]
    got = [r.errors for r in c.ocr_errors(spark.createDataFrame(rows, f"status string, words array<{item}>, lines array<{item}>, confidence double")).collect()]
    assert got == [[], ["status"], ["collections", "confidence"], ["confidence", "not_finite"], ["status"]]


GOOD = {"schema_version": "1", "image_role": "diagram", "summary": "s", "slide_reading_order": "unknown", "diagram_flow_direction": "left_to_right", "flow_present": None, "nodes": [{"id": "a", "label": "A", "bbox": [0, 0, 0.5, 1], "status": "verified"}, {"id": "b", "label": "B", "bbox": [0, 0, 1, 1], "status": "verified"}], "edges": [{"source": "a", "target": "b", "label": "", "direction": "left_to_right", "status": "verified"}], "observations": [{"type": "t", "objects": ["a"], "description": "d", "confidence": 0.8}]}


def test_vision_answers(spark):
    edge = GOOD["edges"][0]
    cases = [GOOD, GOOD | {"extra": 1}, {k: v for k, v in GOOD.items() if k != "summary"}, GOOD | {"nodes": GOOD["nodes"][:1] * 2}, GOOD | {"edges": [edge | {"target": "z"}]}, GOOD | {"observations": [{"type": "t", "objects": [], "description": "d", "confidence": 2}]}, GOOD | {"image_role": "x", "schema_version": "9"}]
    df = spark.createDataFrame([(i, json.dumps(x), 0) for i, x in enumerate(cases)] + [(9, "no json", 0), (10, None, 0)], "i int, response string, n_dropped int")
    a = c.vision_errors(df)
    got = {r.i: r.errors for r in a.collect()}
    assert got[0] == [] and got[1] == ["fields"] and set(got[2]) == {"fields", "summary"} and set(got[3]) == {"node_ids", "edges"} and got[4] == ["edges"] and got[5] == ["observations"] and got[6] == ["version", "role"] and got[9] == got[10] == ["not_json"]
    assert {r.i: r.status for r in c.promoted(a).collect()} == {0: "verified"} | {i: "failed" for i in (1, 2, 3, 4, 5, 6, 9, 10)}


def test_circuit_and_cache(spark):
    rows = [(1, i, f) for i, f in enumerate([True, True, False, True, True, True, False, False])] + [(2, 0, True)]
    got = {(r.run, r.n): r.allowed for r in c.open_circuit(spark.createDataFrame(rows, "run int, n int, failed boolean"), ["run"], "n", "failed").collect()}
    assert [got[(1, i)] for i in range(8)] == [True] * 6 + [False, False] and got[(2, 0)]
    inputs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "content_hash string, i int")
    cache = spark.createDataFrame([("a", "old")], "content_hash string, answer string")
    assert sorted(r.content_hash for r in c.cache_misses(inputs, cache).collect()) == ["b", "c"]
    fresh = spark.createDataFrame([("b", "new"), ("a", "never")], "content_hash string, answer string")
    assert {r.i: (r.answer, r.cache_hit) for r in c.reused(inputs, cache, fresh).collect()} == {1: ("old", True), 2: ("old", True), 3: ("new", False), 4: (None, None)}


def test_gate_failures_and_refs(spark):
    rows = [("image/png", 100.0, 100.0, 10), ("text/plain", 1.0, 1.0, 1), ("image/jpeg", None, 1.0, 1), ("image/jpg", 10.0, 100.0, 1), ("image/bmp", 100.0, 100.0, 10**9)]
    assert [r.skip for r in c.ocr_gate(spark.createDataFrame(rows, "content_type string, width double, height double, size long")).collect()] == [None, "unsupported_type", "unknown_size", "too_small", "too_large"]
    r = spark.createDataFrame([(1, ["b", "a", None]), (1, ["a", " "]), (2, [])], "k int, refs array<string>")
    assert [tuple(x) for x in c.unique_refs(r, ["k"], "refs").collect()] == [(1, ["a", "b"])]


def test_findings(deck_metrics):
    m = deck_metrics
    got = {(r.kind, r.category) for r in c.findings(m).collect()}
    assert ("ambiguous", "proposal_strength") in got and ("weakness", "narrative_flow") in got and ("weakness", "space_usage") in got
    p = m.select("deck_id", F.create_map(F.lit("innovation"), F.struct(F.lit(90.0).alias("score"), F.lit(1.0).alias("confidence"), F.lit(0).alias("n_missing"))).alias("scores"))
    more = c.findings(m, p)
    got = {(r.kind, r.category): r.title for r in more.collect()}
    assert got[("strength", "innovation")] == "Innovation: 90/100" and ("ambiguous", "proposal_strength") not in got
    assert c.limited(more, 1).groupBy("kind").count().where("count > 1").count() == 0
