import pytest

from deckmill.operators import diagrams as d

BOX = "deck_id string, slide_number int, object_id string, native_id string, z_order int, x double, y double, w double, h double"
LINE = "deck_id string, slide_number int, object_id string, from_id string, to_id string, x0 double, y0 double, x1 double, y1 double, head string, tail string"


@pytest.fixture(scope="module")
def boxes(spark):
    return spark.createDataFrame([("d", 1, "a", "2", 1, 0.1, 0.4, 0.2, 0.1), ("d", 1, "b", "3", 2, 0.7, 0.4, 0.2, 0.1), ("d", 1, "c", "3", 3, 0.7, 0.8, 0.2, 0.1), ("d", 2, "x", "2", 1, 0.1, 0.1, 0.1, 0.1), ("d", 2, "y", "5", 1, 0.1, 0.8, 0.1, 0.1)], BOX)


def test_edges_and_direction(spark, boxes):
    lines = spark.createDataFrame([("d", 1, "l1", "2", "3", 0.3, 0.45, 0.7, 0.45, None, "triangle"), ("d", 1, "l2", None, None, 0.0, 0.0, 0.9, 0.9, None, None), ("d", 2, "l3", "2", "5", 0.15, 0.2, 0.15, 0.8, "triangle", None)], LINE)
    e = {r.connector_id: (r.source, r.target, r.status) for r in d.graph_edges(lines, boxes).collect()}
    assert e == {"l1": ("a", "b", "partial"), "l2": (None, "c", "unverified"), "l3": ("y", "x", "verified")}  # two boxes have the native id 3
    f = {r.slide_number: r.direction for r in d.flow_direction(d.graph_edges(lines, boxes), boxes).collect()}
    assert f == {2: "bottom_to_top"}


def test_group_paths_with_a_cycle(spark):
    o = spark.createDataFrame([("d", "a", None, "group"), ("d", "b", "a", "group"), ("d", "c", "b", "shape"), ("d", "p", "q", "group"), ("d", "q", "p", "group"), ("d", "x", "c", "text"), ("e", "0", None, "group"), *(("e", str(i), str(i - 1), "group") for i in range(1, 30))], "deck_id string, object_id string, parent_id string, type string")
    got = {(r.deck_id, r.object_id): r.path for r in d.group_paths(o).collect()}
    assert {k[1]: p for k, p in got.items() if k[0] == "d"} == {"a": [], "b": ["a"], "c": ["a", "b"], "p": ["p", "q"], "q": ["q", "p"], "x": ["a", "b"]}  # c is no group
    assert got[("e", "29")] == [str(i) for i in range(29)]


def test_a_named_end_far_away_is_partial(spark, boxes):
    lines = spark.createDataFrame([("d", 2, "l", "2", "5", 0.9, 0.1, 0.15, 0.8, None, "triangle")], LINE)
    assert [(r.source, r.target, r.status) for r in d.graph_edges(lines, boxes).collect()] == [("x", "y", "partial")]


def test_node_matches(spark):
    n = "g string, node_id string, label string, x double, y double, w double, h double"
    ref = spark.createDataFrame([("g", "n1", "Start", 0.0, 0.0, 0.1, 0.1), ("g", "n2", "End", 0.5, 0.5, 0.1, 0.1), ("g", "n3", None, 0.8, 0.8, 0.1, 0.1)], n)
    hyp = spark.createDataFrame([("g", "n1", None, 0.9, 0.9, 0.1, 0.1), ("g", "h2", " end ", 0.0, 0.0, 0.1, 0.1), ("g", "h3", None, 0.81, 0.8, 0.1, 0.1), ("g", "h4", None, 0.1, 0.9, 0.1, 0.1)], n)
    assert sorted((r.reference_id, r.hypothesis_id, r.how) for r in d.node_matches(ref, hyp, ["g"]).collect()) == [("n1", "n1", "id"), ("n2", "h2", "label"), ("n3", "h3", "box")]
