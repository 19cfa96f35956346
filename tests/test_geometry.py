import random

import pytest

from deckmill.operators import geometry as g

SCHEMA = "slide string, id string, x double, y double, w double, h double"


@pytest.fixture(scope="module")
def boxes(spark):
    rows = [("s", "shape-1", 0.1, 0.1, 0.1, 0.1), ("s", "shape-2", 0.3, 0.1, 0.1, 0.1), ("s", "shape-3", 0.5, 0.1, 0.1, 0.1), ("s", "shape-4", -0.1, 0.3, 0.2, 0.1), ("s", "shape-5", 0.13, 0.12, 0.1, 0.1), ("s", "group-1", 0.1, 0.6, 0.3, 0.2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_mismatch_of_known_layout(boxes):
    m = {(r.first_id, r.second_id): r.distance for r in g.alignment_mismatch(boxes).collect()}
    assert m[("shape-1", "shape-5")] == pytest.approx(0.02)  # the tops are closer than the left edges


def test_spacing_clipping_and_peers_of_known_layout(boxes):
    assert [(r.id_1, r.id_2, r.id_3, r.gap) for r in g.equal_spacing(boxes.where("id <> 'shape-5'")).collect()] == [("shape-1", "shape-2", "shape-3", 0.1)]
    assert [(r.id, r.sides, r.outside_share) for r in g.clipping(boxes).collect()] == [("shape-4", "left", 0.5)]
    assert [(r.w, r.n_boxes) for r in g.peer_groups(boxes).collect()] == [(0.1, 4)]


def test_union_area_by_sampling(spark):
    rnd = random.Random(3)
    rows = [(str(s), str(i), rnd.uniform(-0.2, 0.9), rnd.uniform(-0.2, 0.9), rnd.uniform(0, 0.4), rnd.uniform(0, 0.4)) for s in range(3) for i in range(8)]
    got = {r.slide: r.union_area for r in g.union_area(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = 400
    for s in map(str, range(3)):
        own = [r for r in rows if r[0] == s]
        hit = sum(any(r[2] <= (i + 0.5) / n <= r[2] + r[4] and r[3] <= (j + 0.5) / n <= r[3] + r[5] for r in own) for i in range(n) for j in range(n))
        assert got[s] == pytest.approx(hit / n / n, abs=0.01)


def test_empty_regions_add_up(spark):
    df = spark.createDataFrame([("s", "a", 0.0, 0.0, 0.5, 1.0)], SCHEMA)
    assert [(r.x0, r.x1, r.top, r.bottom, r.area) for r in g.empty_regions(df).collect()] == [(0.5, 1.0, 0.0, 1.0, 0.5)]


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    for f in (g.union_area, g.overlap_pairs, g.empty_regions, g.margins, g.alignment_groups, g.equal_spacing, g.nearest_box, g.whitespace_balance):
        assert f(df).count() == 0
