import json

from pyspark.sql import functions as F

from deckmill.sources import records as r
from deckmill.sources import reports

GOOD = {
    "schema_version": "1.0", "deck": {"name": "d"}, "slides": [{"id": "slide-01", "number": 1, "text": ["a"], "hyperlinks": [{"target": "t"}]}], "objects": [{"id": "o1", "slide_id": "slide-01", "type": "text", "bbox": [0.1, 0.2, 0.3, 0.4], "text": "a"}],
    "assets": [{"id": "asset-0001", "part": "p", "sha256": "x", "size": 3}], "relationships": [], "rendered_evidence": [{"id": "e1", "slide_id": "slide-01", "status": "verified", "confidence": 1.0, "value": {"type": "t", "n": 1}}], "ocr_evidence": [], "vision_evidence": [], "warnings": [],
}


def test_records_and_labels(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    bad = {"b": "no json", "c": json.dumps({k: v for k, v in GOOD.items() if k != "assets"}), "e": json.dumps(GOOD | {"objects": [{"id": "o", "slide_id": "zz"}, {"id": "o", "slide_id": "slide-01"}], "ocr_evidence": [{"id": "x", "status": "odd", "confidence": 2}]})}
    (d / "a.json").write_text(json.dumps(GOOD, indent=1))
    for k, v in bad.items():
        (d / f"{k}.json").write_text(v)
    ok, wrong = r.read_records(spark, [str(d)])
    assert {x.path[-6:-5]: x.reasons for x in wrong.collect()} == {"b": ["not_a_record"], "c": ["no_assets"], "e": ["repeated_objects_id", "object_without_slide", "evidence_status", "evidence_confidence"]}
    assert [(x.slide_number, x.text) for x in r.slides_of(ok).collect()] == [(1, ["a"])]
    o = r.objects_of(ok).first()
    assert (o.slide_number, o.object_id, o.x, o.h) == (1, "o1", 0.1, 0.4) and r.assets_of(ok).first().size == 3
    e = r.evidence_of(ok).first()
    assert (e.layer, e.status, json.loads(e.value)) == ("rendered", "verified", {"type": "t", "n": 1})
    assert [tuple(x)[1:] for x in r.evidence_summary(r.evidence_of(ok)).collect()] == [("rendered", "verified", 1)]
    (tmp_path / "l.json").write_text(json.dumps({"text": ["a"], "vision": [{"target": "s", "image_role": "chart"}]}))
    x = r.read_labels(spark, [str(tmp_path / "l.json")]).first().labels
    assert x.text == ["a"] and x.vision[0].image_role == "chart" and x.objects is None


def test_environment(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# c\nA=1\nexport B = 'x y'\nbroken\nC=\"q\"\n\nD=a=b\n")
    monkeypatch.setenv("A", "2")
    assert r.environment(str(tmp_path / "env")) == {"A": "2", "B": "x y", "C": "q", "D": "a=b"} and r.environment(str(tmp_path / "env"), keep=False)["A"] == "1"


def test_leaderboard_lines(spark):
    b = spark.createDataFrame([("p", "s1", "T|1", "A", 91.5, "scored", 1, "Title"), ("p", "s2", None, "REVIEW", None, "failed", None, None)], "ps_id string, submission_id string, team string, bucket string, final_score double, status string, place int, problem_title string")
    rows = [x.line for x in reports.leaderboard(b).orderBy("ps_id", "section", F.col("place").asc_nulls_last(), "submission_id").collect()]
    assert rows == ["## Problem Statement `p`", "", "- Title: Title", "", *reports.BOARD_HEAD, "| 1 | s1 | T\\|1 | A | 91.50 | scored |", "| REVIEW | s2 | – | REVIEW | N/A | failed |"]


def test_scorecards_and_json(spark):
    score = "struct<score:double,confidence:double,unpenalized:double,penalty:double>"
    e = spark.createDataFrame([(1, (80.0, 1.0, 80.0, 0.0), (60.0, 1.0, 60.0, 0.0), (74.0, 1.0), "SCORED"), (2, (None, None, None, None), (60.0, 1.0, 60.0, 0.0), (None, None), "REVIEW")], f"deck_id long, proposal {score}, deck_quality {score}, final struct<score:double,confidence:double>, status string")
    c = spark.createDataFrame([(1, {"innovation": (50.0,)}), (2, {})], "deck_id long, scores map<string,struct<score:double>>")
    f = spark.createDataFrame([(1, "strength", "x", "Good", 90.0), (1, "weakness", "y", "Bad", 10.0)], "deck_id long, kind string, category string, title string, value double")
    lines = [x.line for x in reports.scorecards(e, c, f).where("deck_id = 1").orderBy("section", "n").collect()]
    assert "- Final score: `74.00/100` (proposal `56.00/70` + deck `18.00/30`)" in lines and "| Innovation | 50.00/100 | 5.00/10 |" in lines and "| Readability | REVIEW/100 | N/A/5 |" in lines and lines[-2:] == ["- Good", "- Bad"]
    m = spark.createDataFrame([(1, 0.5)], "deck_id long, space_usage double")
    j = {x.deck_id: json.loads(x.json) for x in reports.evaluation_json(e, m, f).collect()}
    assert j["1"]["metrics"] == {"space_usage": 0.5} and len(j["1"]["findings"]) == 2 and j["2"]["status"] == "REVIEW"
