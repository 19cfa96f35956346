import numpy as np
from pyspark.sql import functions as F

from deckmill.llm import queries, reading


def test_language_and_layout():
    assert reading.analysed("The sign is small and it is on the wall.")[0] == "en"
    assert reading.analysed("Das ist ein kleines Schild und es ist nicht neu.")[0] == "de"
    assert reading.analysed("किसान पानी का स्तर पढ़ सकते हैं।")[0] == "hi"
    wrapped = "The sign is small and it\nis on the wall of the house.\n\n# Heading here\n- first item of the list\n- second item of the list"
    assert [len(s) for s in reading.analysed(wrapped)[1]] == [13, 5, 5]
    code = "The box is new.\n```\nfor x in y: print(x)\n```\nFiles: a_b/c_d, e_f/g_h, i_j/k_l"
    assert [w for s in reading.analysed(code)[1] for w in s] == ["the", "box", "is", "new"]


def test_run_on_is_no_long_sentence():
    run_on = " and ".join(["the box is full"] * 20)
    assert max(len(s) for s in reading.analysed(run_on)[1]) == 4
    long = "that which those who judge take to be sound need not be what the ones who drew the line would hold to be sound " * 3
    assert max(len(s) for s in reading.analysed(long)[1]) > 60


def test_coverage_rank():
    ranks = {"en": {w: i for i, w in enumerate("the is box new".split(), 1)}}
    assert reading.measured("The box is new. The box is new.", ranks, 9)[2] == 2 and reading.measured("The box is new. The box is new.", ranks, 1)[2] == -1
    assert reading.measured(None, ranks, 9) is None and reading.measured(" \n", ranks, 9) is None and reading.measured("```\ncode\n```", ranks, 9) is None


def test_logistic_on_separable_data():
    x = np.column_stack([np.ones(100), np.linspace(-1, 1, 100)])
    b = reading.logistic(x, (x[:, 1] > 0).astype(float))
    assert ((x @ b > 0) == (x[:, 1] > 0)).all() and np.isfinite(b).all()


def _docs(spark):
    easy, hard = "The box is new. It is red. ", "Notwithstanding the multidimensional epistemic asymmetry that characterises participatory evaluation protocols, the disaggregation of algorithmic prioritisation criteria presupposes a substitutability. "
    rows = [(i, (easy if i % 2 else hard) * (3 + i % 5)) for i in range(60)] + [(100, None), (101, ""), (102, " \n "), (103, easy * 4000), (104, easy * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("language", F.lit("zz")).withColumn("id", F.lit(1)).withColumn("m", F.lit(1))


def test_levels(spark):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 5) for i in range(40)] + [(41, None), (999, 3)], "doc_id long, reading_level int").withColumn("language", F.lit(1))
    got = {r.doc_id: r.level for r in reading.reading_levels(_docs(spark), labels).collect()}
    assert all(got[i] == (1 if i % 2 else 5) for i in range(60)) and got[103] == got[104] == 1 and not {100, 101, 102} & set(got)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, reading_level int")
    assert {r.level for r in reading.reading_levels(_docs(spark), none).collect()} == {None}
    assert reading.reading_levels(_docs(spark).where("doc_id < 0"), none).count() == 0


def test_accuracy_on_held_out_labels(spark, data, duck):
    from deckmill.sources.tables import table

    big = data.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, big, "documents"), table(spark, big, "reading_labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = reading.reading_levels(docs, labels.where(~held)).where("n_words >= 50").join(labels.where(held), "doc_id").select("level", "reading_level").collect()
    near = np.mean([abs(r.level - r.reading_level) <= 1 for r in got])
    exact = np.mean([r.level == r.reading_level for r in got])
    assert near > 0.95 and exact > 0.7  # raters themselves are sometimes one level off


def test_equal_texts_get_equal_levels(spark, data):
    r = queries.queries()["p9_levels"](spark, data)
    from deckmill.sources.tables import table

    j = table(spark, data, "documents").select("doc_id", "text").join(r, "doc_id").groupBy("text").agg(F.count_distinct("level").alias("n"))
    assert j.where("n > 1").count() == 0


def test_language_of_whole_texts(spark):
    cover = "The terms of this licence are on the page and you can read it in the file that we sent. " * 120
    bodies = {"ru": "Новый насос стоит на берегу реки и качает воду. " * 900, "hi": "किसान पानी का स्तर पढ़ सकते हैं। " * 900, "de": "Das ist ein kleines Schild und es ist nicht neu. " * 900}
    for name, body in bodies.items():
        text = cover + "\n\n" + body
        assert reading.analysed(text)[0] == name
        assert {r.language for r in reading.counted(spark.createDataFrame([(text,)], "text string"), "text").collect()} == {name}
    code = "```\n" + "the of and to in is it we for a\n" * 80 + "```\nDas ist ein kleines Schild und es ist nicht neu."
    assert reading.analysed(code)[0] == "de" and {r.language for r in reading.counted(spark.createDataFrame([(code,)], "text string"), "text").collect()} == {"de"}


def test_any_number_of_sent_ranks_gives_the_same_levels(spark, data):
    from deckmill.sources.tables import table

    docs, labels = table(spark, data, "documents"), table(spark, data, "reading_labels")
    rows = lambda most: sorted(map(tuple, reading.reading_levels(docs, labels, most=most).collect()))
    assert rows(3) == rows(40) == rows(10_000)
