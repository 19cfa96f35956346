import json

import pytest

from deckmill.operators import accuracy, visuals as v

SCHEMA = "deck_id long, slide_number int, object_id string, parent_id string, type string, text string, x double, y double, w double, h double, rotation double, font_sizes array<double>, font_family string, colors array<struct<role:string,color:string>>"


def obj(id, type="shape", box=(0.1, 0.1, 0.1, 0.1), text=None, parent=None, rotation=0.0, sizes=None, family=None, colors=None, deck=1, slide=1):
    return (deck, slide, id, parent, type, text, *box, rotation, sizes, family, colors)


@pytest.fixture(scope="module")
def objects(spark):
    rows = [
        obj("shape-1", box=(0.1, 0.1, 0.1, 0.1)), obj("shape-2", box=(0.3, 0.1, 0.1, 0.1)), obj("shape-3", box=(0.5, 0.1, 0.1, 0.1)), obj("shape-4", box=(-0.1, 0.3, 0.2, 0.1), rotation=15.0), obj("shape-5", box=(0.13, 0.12, 0.1, 0.1)),
        obj("group-1", "group", (0.1, 0.6, 0.3, 0.2)), obj("group-child", box=(0.15, 0.65, 0.1, 0.1), parent="group-1", rotation=None),
        obj("t1", "text", (0.0, 0.0, 0.5, 0.5), "Big one", sizes=[20.0, 10.0], family="Arial", colors=[("font", "#ff0000"), ("fill", "#FF0000")], slide=2), obj("t2", "text", (0.25, 0.25, 0.5, 0.5), "Tiny", sizes=[10.0], family="Calibri", colors=[("font", "#00ff00")], slide=2),
        obj("t3", "text", (0.0, 0.0, None, 0.5), "no box", sizes=[99.0], slide=2), obj("t4", "text", (0.9, 0.9, 0.0, 0.0), "", sizes=None, slide=2), obj("g2", "group", (None, None, None, None), slide=2), obj("k", "shape", (0.6, 0.7, 0.1, 0.2), parent="g2", slide=2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_peers_hierarchy_and_rotation(objects):
    p = v.peers(objects).collect()
    assert [r.objects for r in p] == [["shape-1", "shape-2", "shape-3", "shape-5"]]
    h = {r.parent: (r.children, r.x, r.w) for r in v.hierarchy(objects).collect()}
    assert h["group-1"] == (["group-child"], 0.1, 0.3) and h["g2"][0] == ["k"] and h["g2"][2] == pytest.approx(0.1)
    r = {r.slide_number: (r.n_known, r.n_rotated, [x.object_id for x in r.rotated]) for r in v.rotations(objects).collect()}
    assert r[1] == (6, 1, ["shape-4"])


def test_densities(objects):
    t = {r.slide_number: r for r in v.text_density(objects).collect()}
    assert (t[2].n_texts, t[2].n_chars, t[2].n_words) == (2, 11, 3) and t[2].text_area == pytest.approx(0.4375) and t[2].chars_per_area == pytest.approx(11 / 0.4375, abs=1e-5)
    assert t[1].n_texts == 0 and t[1].chars_per_area is None
    s = {r.slide_number: r for r in v.shape_density(objects).collect()}
    assert s[1].types == {"group": 1, "shape": 6} and s[1].n_shapes == 7 and s[2].n_other_than_text == 1


def test_fonts(objects):
    f = v.font_distribution(objects).collect()
    assert len(f) == 1
    r = f[0]  # "Bigone" 6 characters over 20 and 10, "Tiny" 4 at 10
    assert (r.n_sizes, r.minimum, r.maximum, r.median, r.n_chars, r.weighted_median, r.dominant, r.dominant_share) == (3, 10.0, 20.0, 10.0, 10.0, 10.0, 10.0, 0.7)
    assert r.weighted_mean == 13.0 and r.weighted_variance == 21.0 and r.mean == pytest.approx(40 / 3, abs=1e-6)
    g = v.font_families(objects).first()
    assert (g.n_families, g.dominant, g.counts) == (2, "Arial", {"Arial": 7, "Calibri": 4})


def test_colors_and_assembly(objects):
    c = v.color_consistency(objects).first()
    assert (c.n_colors, c.n_samples, c.dominant, c.dominant_share) == (2, 3, "#FF0000", 0.666667) and c.palette[0].roles == {"font": 1, "fill": 1}
    facts = v.slide_facts(objects).collect()
    assert {r.fact_type for r in facts} == {"text_density", "shape_density", "font_size_distribution", "font_family_distribution", "color_consistency", "rotation_distribution", "shape_hierarchy", "shape_peer_group"}
    assert all(json.loads(r.value) for r in facts)
    assert v.slide_facts(objects.where("deck_id < 0")).count() == 0


def test_object_matches_and_geometry(spark):
    s = "deck_id long, n int, object_id string, slide_number int, type string, text string, x double, y double, w double, h double"
    e = spark.createDataFrame([(1, 1, "a", 1, "text", None, 0.0, 0.0, 0.5, 0.5), (1, 2, None, 1, "text", "hello", None, None, None, None), (1, 3, "zz", 1, "text", None, None, None, None, None), (1, 4, None, 2, "image", None, 0.0, 0.0, 0.0, 0.0)], s)
    a = spark.createDataFrame([(1, "a", 1, "text", "x", 0.0, 0.0, 0.5, 1.0, 2), (1, "b", 1, "text", "say  HELLO", 0.0, 0.0, 1.0, 1.0, 1), (1, "c", 2, "image", None, 0.0, 0.0, 0.0, 0.0, 3)], "deck_id long, object_id string, slide_number int, type string, text string, x double, y double, w double, h double, order int")
    got = {r.n: (r.object_id, r.iou) for r in accuracy.object_matches(e, a).collect()}
    assert got == {1: ("a", 0.5), 2: ("b", None), 3: (None, None), 4: ("c", 1.0)}
    r = accuracy.extraction_accuracy(e, a).first()
    assert (r.n_expected, r.object_recall, r.box_accuracy) == (4, 0.75, 0.75)
    native = spark.createDataFrame([(1, 1, "2", "shape", 0.1, 0.1, 0.2, 0.2), (1, 1, "3", "shape", 0.1, 0.1, 0.2, 0.2), (1, 1, "4", "group", 0.1, 0.1, 0.2, 0.2), (1, 1, "5", "shape", 0.5, 0.5, 0.1, 0.1)], "deck_id long, slide_number int, native_id string, type string, x double, y double, w double, h double")
    rendered = native.where("native_id in ('2', '5')").selectExpr("deck_id", "slide_number", "native_id", "x + (case native_id when '5' then 0.01 else 0.004 end) as x", "y", "w", "h")
    got = {r.native_id: (r.reason, r.max_delta) for r in accuracy.geometry_mismatches(native, rendered).collect()}
    assert got == {"3": ("missing_rendered_object", None), "5": ("bbox_delta_exceeds_tolerance", 0.01)}
    c = accuracy.geometry_verification(native, rendered).first()
    assert (c.n_native, c.n_matched, c.n_missing, c.n_moved, c.coverage, c.status) == (3, 2, 1, 1, 0.666667, "partial")


def test_text_recall_uses_each_text_once(spark):
    e = spark.createDataFrame([(1, "alpha"), (1, "alpha"), (1, "beta"), (2, "x")], "k int, text string")
    a = spark.createDataFrame([(1, "Alpha  one"), (1, "gamma beta"), (3, "y")], "k int, text string")
    got = {r.k: (r.n_expected, r.n_found, r.recall) for r in accuracy.text_recall(e, a, "k").collect()}
    assert got == {1: (3, 2, 0.666667), 2: (1, 0, 0.0), 3: (0, 0, 1.0)}


def test_resolution_and_run_evaluation(spark):
    a = spark.createDataFrame([(1, "r1", "x"), (1, "r2", None), (2, "q", "y")], "deck_id long, id string, target string")
    e = spark.createDataFrame([(1, "r1"), (1, "r9")], "deck_id long, id string")
    assert {r.deck_id: r.share for r in accuracy.resolution(None, a, "id", a["target"].isNotNull()).collect()} == {1: 0.5, 2: 1.0}
    assert {r.deck_id: r.share for r in accuracy.resolution(e, a, "id", a["target"].isNotNull()).collect()} == {1: 0.5}
    lab = spark.createDataFrame([(1, "s1", "chart", None, True, "left_to_right"), (1, "s2", "logo", "top", None, None), (1, "s3", "logo", None, None, None)], "run int, target string, image_role string, reading_order string, flow_present boolean, flow_direction string")
    rec = spark.createDataFrame([(1, "s1", "verified", "chart", None, True, "top_to_bottom", True, 0.8, False, True, 0.1, 2.0), (1, "s2", "failed", None, None, None, None, False, None, None, False, None, 1.0), (1, "s9", "not_requested", None, None, None, None, True, 0.5, True, False, 0.2, None)], "run int, target string, status string, image_role string, reading_order string, flow_present boolean, flow_direction string, valid boolean, grounding_score double, hallucinated boolean, cache_hit boolean, cost double, seconds double")
    r = accuracy.run_evaluation(lab, rec, ["run"]).first()
    assert (r.n_targets, r.n_invalid, r.role_accuracy, r.reading_order_accuracy, r.flow_accuracy) == (3, 2, 1.0, None, 0.5)
    assert (r.grounding, r.hallucination_rate, r.n_requests, r.n_cached, r.cost, r.seconds) == (0.8, 0.0, 2, 1, pytest.approx(0.3), 3.0)
