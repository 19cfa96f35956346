import pytest

from deckmill.operators import metrics as m

MEASURES = {"text_density": 0.25, "small_text_ratio": 0.0, "overlap_ratio": 0.0, "clipping_rate": 0.0, "occupied_area_ratio": 0.0, "whitespace_area_ratio": 1.0, "largest_empty_region_ratio": 1.0, "whitespace_balance": 1.0, "visual_area_ratio": 0.0}


def slide(deck, n=1, body=("Use the workflow to identify and resolve the threat.",), kind="process", title="Workflow", visuals=(), **measures):
    blocks = [("title", title, 0.1, 0.05, 0.8, 0.1), *(("body", b, 0.1, 0.2, 0.5, 0.3) for b in body)]
    v = MEASURES | measures
    text = " ".join([title, *body])
    return (deck, n, kind, "title", title, text, blocks, list(visuals), [], ["verified", "not_requested"], *(v[k] for k in ("text_density", "small_text_ratio", "overlap_ratio", "clipping_rate", "occupied_area_ratio", "whitespace_area_ratio", "largest_empty_region_ratio", "whitespace_balance", "visual_area_ratio")))


def run(spark, rows):
    return m.deck_metrics(m.measured(spark.createDataFrame(rows, m.SLIDE)))


def test_balance_penalizes_both_extremes(spark):
    rows = [slide(1, text_density=0.25, visual_area_ratio=0.25), slide(2, body=("This is a very long explanation. " * 30,), text_density=0.8), slide(3, body=(), text_density=0.05, visual_area_ratio=0.9)]
    got = {r.deck_id: r.text_visual_balance for r in run(spark, rows).collect()}
    assert got[1] > got[2] and got[1] > got[3]


def test_structure_coverage_and_space(spark):
    body = "Robust scalable platform with better outcomes. " + "This long explanation repeats implementation details without concise pointers. " * 8
    r = run(spark, [slide(1, body=(body,), title="Title")]).first()
    assert (r.paragraph_ratio, r.pointer_ratio, r.heavy_ratio, r.visual_coverage, r.space_usage) == (1.0, 0.0, 1.0, 0.0, 0.0)
    assert r.title_coverage == 1.0 and r.evidence_visibility == 1.0 and r.slide_type_coverage == 1.0 and r.ambiguous_ratio == 0.0  # "with better" is specific


def test_missing_measures_are_left_out_and_counted(spark):
    rows = [slide(1, 1, text_density=0.2), slide(1, 2, text_density=0.4), slide(1, 3, text_density=None, overlap_ratio=None)]
    r = run(spark, rows).first()
    assert r.text_density == pytest.approx(0.3) and r.missing_text_density == 1 and r.missing_overlap_ratio == 1 and r.content_density_variation == pytest.approx(0.1)
    s = run(spark, rows).select(m.component_scores()["readability"].alias("r")).first().r
    assert s.confidence == 0.75 and s.n_missing == 1


def test_relevance_and_repeated_files(spark):
    v = lambda role, h, status="extracted": (role, status, h, None, True, 0.0, 0.0, 0.1, 0.1)
    rows = [slide(1, 1, visuals=[v("chart", "a"), v("unknown", "a")]), slide(1, 2), slide(2, 1, visuals=[v("chart", "a", "low_confidence")])]
    got = {r.deck_id: (r.visual_relevance_coherence, r.n_evidence_images) for r in run(spark, rows).collect()}
    assert got[1][0] == pytest.approx((0.75 * 0.5 + 0.25 + 0.35) / 2 * (1 - 0.15 * 0.5), abs=1e-6) and got[1][1] == 1 and got[2] == (0.875, 1)


def test_layout_without_geometry_has_no_score(spark):
    rows = [slide(1), slide(2, overlap_ratio=None)]
    got = {r.deck_id: r.s for r in run(spark, rows).select("deck_id", m.component_scores()["layout_space_usage"].alias("s")).collect()}
    assert got[1].score == pytest.approx(40.0) and got[2].score is None and got[2].n_missing == 1 and got[2].confidence is None


def answers(spark, rows):
    return spark.createDataFrame(rows, "deck_id long, scores map<string,struct<score:double,confidence:double,n_missing:int>>, rendered boolean, penalty_points double")


def test_final_score_and_penalties(spark):
    full = {k: (80.0, 1.0, 0) for k in (*m.PROPOSAL, *m.DECK)} | {"prototype_evidence": (50.0, 1.0, 0)}
    a = answers(spark, [(1, full, True, 2.0), (2, full, False, 2.0), (3, full | {"problem_statement_alignment": (80.0, 1.0, 2)}, True, 0.0), (4, {"solution_clarity": (80.0, 1.0, 0)}, True, 0.0)])
    d = run(spark, [slide(i) for i in range(1, 6)])
    got = {r.deck_id: r for r in m.evaluated(d, a).collect()}
    proposal = round((80 * 65 + 50 * 5) / 70, 6)
    assert got[1].proposal.score == proposal and got[1].deck_quality.unpenalized == 80.0
    assert got[1].deck_quality.score == pytest.approx(22 / 0.3, abs=1e-5) and got[1].final.score == pytest.approx(round(proposal * 0.7, 6) + 22.0, abs=1e-5)
    assert got[2].deck_quality.score != got[1].deck_quality.score  # answers on unseen slides don't score the deck
    assert got[3].proposal.penalty == pytest.approx(20 * 20 / 70, abs=1e-6) and got[3].proposal.unpenalized == proposal
    assert got[4].proposal.score is None and got[4].status == got[5].status == "REVIEW" and got[5].final.score is None
    assert got[1].status == "SCORED" and got[1].final.confidence == 1.0
    half = {r.deck_id: r.proposal.penalty for r in m.evaluated(d, a, per_missing=5.0).collect()}
    assert half[3] == pytest.approx(10 * 20 / 70, abs=1e-6)


def test_empty_and_null_slides(spark):
    rows = [(1, 1, None, None, None, None, None, None, None, None, *[None] * 9)]
    r = run(spark, rows).first()
    assert r.text_density is None and r.missing_text_density == 1 and r.structure_score == 0.0 and r.duplicate_content is None and r.generic_filler_ratio is None
    assert run(spark, rows).where("deck_id < 0").count() == 0


def test_measures_of_objects(spark):
    rows = [
        (1, 1, "a", "text", "Hello", 0.0, 0.0, 0.5, 0.5, 8.0, False), (1, 1, "b", "image", None, 0.25, 0.25, 0.5, 0.5, None, False), (1, 1, "c", "text", "Foot", 0.0, 0.9, 1.0, 0.1, 8.0, True),
        (1, 1, "d", "text", "Big", 0.9, 0.0, 0.2, 0.1, 20.0, False), (1, 2, "e", "text", "x", 0.0, 0.0, 1.0, 1.0, 8.0, True),
    ]
    df = spark.createDataFrame(rows, "deck_id long, slide_number int, object_id string, type string, text string, x double, y double, w double, h double, font_size double, excluded boolean")
    got = {r.slide_number: r for r in m.slide_measures(df).collect()}
    a = got[1]
    assert a.occupied_area_ratio == pytest.approx(0.4375 + 0.01, abs=1e-6) and a.text_density == pytest.approx(0.26) and a.visual_area_ratio == 0.25 and a.small_text_ratio == 0.5
    assert a.overlap_ratio == pytest.approx(0.0625 / 0.4475, abs=1e-5) and a.clipping_rate == pytest.approx(1 / 3, abs=1e-6)
    assert got[2].occupied_area_ratio == 0.0 and got[2].whitespace_area_ratio == 1.0


def test_prototype_links(spark):
    df = spark.createDataFrame([(1, "https://github.com/a/b"), (1, "https://a.org"), (2, "https://YouTu.be/x")], "deck_id long, target string")
    assert {r.deck_id: (r.n_links, r.n_prototype_links) for r in m.prototype_links(df).collect()} == {1: (2, 1), 2: (1, 1)}
