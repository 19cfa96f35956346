import json

from pyspark.sql import functions as F

from deckmill.operators import evidence as e
from deckmill.sources import sinks

OBJ = "deck_id string, slide_number int, object_id string, type string, name string, text string, placeholder string, z_order int, x double, y double, w double, h double"


def deck(spark):
    rows = []
    for n in (1, 2):
        rows += [
            ("d", n, f"bg{n}", "shape", "Background", None, None, 1, 0.0, 0.0, 1.0, 1.0), ("d", n, f"t{n}", "text", "Title", "Real title" if n == 1 else "Second", "title", 2, 0.1, 0.05, 0.8, 0.1),
            ("d", n, f"b{n}", "text", "Body", f"body text {n}", "body", 3, 0.1, 0.4, 0.8, 0.3), ("d", n, f"l{n}", "image", "Logo", None, None, 4, 0.92, 0.92, 0.05, 0.05), ("d", n, f"f{n}", "text", "Foot", f"Page {n} of 2", "ftr", 5, 0.1, 0.95, 0.2, 0.04),
        ]
    return spark.createDataFrame(rows, OBJ)


def test_chrome_and_titles(spark):
    m = e.chrome_reasons(deck(spark))
    r = {x.object_id: x.reasons for x in m.where("slide_number = 1").collect()}
    assert r == {"bg1": ["background"], "t1": [], "b1": [], "l1": ["badge"], "f1": ["footer", "page_number"]}
    assert [(x.slide_number, x.text) for x in e.titles(m).orderBy("slide_number").collect()] == [(1, "Real title"), (2, "Second")]
    assert {x.object_id for x in e.content_objects(m).where("slide_number = 1").collect()} == {"t1", "b1"}


def test_a_deck_alone_or_among_others(spark):
    d = deck(spark)
    more = d.unionByName(d.withColumn("deck_id", F.lit("other")).withColumn("text", F.lit("Second")))
    key = lambda df: sorted((r.object_id, tuple(r.reasons)) for r in e.chrome_reasons(df).where("deck_id = 'd'").collect())
    assert key(d) == key(more)


def test_roles(spark):
    names = ["Process diagram", "Product screenshot", "Quarterly chart", "Error output evidence", "Brand logo", "Decorative background", "x"]
    df = spark.createDataFrame([(n, 0.1, 0.1, 0.8, 0.8) for n in names[:-1]] + [("x", 0.4, 0.4, 0.1, 0.1), ("y", 0.93, 0.93, 0.05, 0.05)], "name string, x double, y double, w double, h double")
    got = {r.name: r.r.role for r in df.select("name", e.image_role(F.col("name"), F.when(F.col("name") == "y", 3).otherwise(1)).alias("r")).collect()}
    assert got == dict(zip(names, ["diagram", "screenshot", "chart", "evidence_image", "logo", "decorative_image", "unknown"])) | {"y": "logo"}


def test_statuses(spark):
    cases = [(["verified", "not_requested"], "verified"), (["verified", "failed"], "partial"), (["failed", "unverified"], "failed"), (["not_requested"], "not_requested"), ([], "not_applicable")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s array<string>")
    assert [r[0] for r in df.select(e.merged_status(F.col("s"))).collect()] == [x for _, x in cases]


def test_records_and_contract(spark):
    f = spark.createDataFrame([("d", 2, "b", "margin", "verified", 1.0), ("d", 1, "a", "margin", "odd", 2.0), ("d", 9, None, "overlap", "partial", None)], "deck_id string, slide_number int, object_id string, fact_type string, status string, confidence double")
    ids = e.record_ids(f, "native", ["object_id"])
    assert sorted(r.evidence_id for r in ids.collect()) == ["native-slide-01-margin-0001", "native-slide-02-margin-0002", "native-slide-09-overlap-0001"]
    slides = spark.createDataFrame([("d", 1), ("d", 2)], "deck_id string, slide_number int")
    objects = spark.createDataFrame([("d", "a")], "deck_id string, object_id string")
    got = sorted((r.evidence_id[-11:], r.rule) for r in e.contract_violations(ids, slides, objects).collect())
    assert got == [("margin-0001", "confidence_range"), ("margin-0001", "unknown_status"), ("margin-0002", "missing_object"), ("verlap-0001", "missing_slide")]
    assert e.contract_violations(ids.unionByName(ids), slides, objects).where("rule = 'repeated_id'").count() == 3


def test_inheritance_and_colors(spark):
    s = spark.createDataFrame([(1, None, "Arial"), (2, 12.0, None)], "k int, size double, font string")
    layout, theme = spark.createDataFrame([(1, None, None)], "k int, size double, font string"), spark.createDataFrame([(1, 18.0, "X"), (2, 20.0, "Y")], "k int, size double, font string")
    got = {r.k: (r.size, r.size_from, r.font, r.font_from) for r in e.inherited(s, [layout, theme], ["k"], ["size", "font"]).collect()}
    assert got == {1: (18.0, 2, "Arial", 0), 2: (12.0, 0, "Y", 2)}
    c = spark.createDataFrame([(1, "ff0000"), (1, "FF0000"), (1, "00ff00"), (1, None)], "k int, c string")
    assert [tuple(r) for r in e.colors(c, ["k"], "c").collect()] == [(1, 2, "FF0000", 0.666667)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "x|y", (1, [("q", None)])), (1, None, None)], "b int, a string, s struct<z:int,l:array<struct<d:string,c:int>>>")
    rows = [json.loads(r.json) for r in sinks.canonical_json(df).collect()]
    assert rows[0] == {"a": "x|y", "b": 2, "s": {"l": [{"c": None, "d": "q"}], "z": 1}} and list(rows[0]["s"]) == ["l", "z"]
    assert sinks.fingerprint(df, ["b"]).collect() == sinks.fingerprint(df.select("s", "a", "b"), ["b"]).collect()
    md = sinks.markdown_table(df.withColumn("g", F.lit(1)), ["g"], [F.col("b")], ["b", "a"]).first().markdown
    assert md == "| b | a |\n| --- | --- |\n| 1 | – |\n| 2 | x\\|y |"
    slides = spark.createDataFrame([("d", 2, ["B"]), ("d", 1, ["A\nx", None, " "]), ("d", 3, None)], "deck_id string, slide_number int, text array<string>")
    assert sinks.deck_markdown(slides).first().markdown == "## Slide 1\n- A / x\n\n## Slide 2\n- B\n\n## Slide 3"
    sinks.write_bundle(df.select("a", "b"), str(tmp_path / "out"), "b")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
