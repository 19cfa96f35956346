import pytest
from pyspark.sql import functions as F

from deckmill.functions.lineage import cut
from deckmill.llm import encodings as e


@pytest.mark.parametrize("word", ["résumé", "função", "Größe", "Решение", "समाधान", "l’été", "±", "•", "🙂", "ไทย", "한국", "中文"])
def test_round_trip_of_chains(word):
    for form, chain in e.garbled(word).items():
        if chain.startswith("utf-8>") and chain.count(">") == 1:
            assert e.inverse(form) == word


@pytest.mark.parametrize("clean", ["ATENÇÃO", "Âncora", "√657", "├──", "Решение", "समाधान", "à", "Åsta", "CAFÉ…", "«В»", "В»", "MAÑANA", "ß", "été", "₹835", "ｏｆ", "São", "Prototypе\u00a0KX"])
def test_clean_words_stay(clean):
    assert e.inverse(clean) is None
    assert all(clean != form for w in ("à", "été", "Решение", "São") for form in e.garbled(w))


def test_detection_and_repair(spark):
    rows = [(1, ["Nuestra soluci�n", None]), (2, ["Nuestra solución"]), (3, ["le rÃ©sumÃ© est prÃªt", "ok"]), (4, ["Ðåçóëüòàòû"]), (5, ["Результаты"]), (6, None), (7, []), (8, ["�"]), (9, ["ATENÇÃO: São Brás", "x" * 100_000]), (3, ["le rÃ©sumÃ© est prÃªt", "ok"]), (10, ["juryÃ¢â‚¬â„¢s"])]
    df = spark.createDataFrame(rows, "slide_key long, text array<string>").withColumn("token", F.lit(1)).withColumn("original", F.lit(1))
    bad = cut(e.garbled_tokens(df, "text"))
    assert sorted(r[0] for r in e.affected(df, "slide_key", "text", bad).collect()) == [1, 3, 4, 8, 10]
    got = {r.slide_key: (r.text, r.n_unresolved) for r in e.restored(df, "slide_key", "text", bad).collect()}
    assert got == {1: (["Nuestra solución", None], 0), 3: (["le résumé est prêt", "ok"], 0), 4: (["Результаты"], 0), 8: (["�"], 1), 10: (["jury’s"], 0)}
    assert e.garbled_tokens(df.where("slide_key < 0"), "text").count() == 0


def test_pieces_come_from_the_table_only():
    word = e.read_as("Решение", "cp1252")
    assert e.pieced(word, e.piece_tables([])) is None and e.pieced(word, e.piece_tables(list("Решени"))) == "Решение"
    assert e.pieced(e.read_as(e.read_as("été", "cp1252"), "cp1252"), e.piece_tables([])) == "été"
    assert e.pieced("Größe", e.piece_tables(list("Größe"))) is None


def test_unseen_words_are_found_by_characters_of_clean_ones(spark):
    rows = [(1, ["समाधान पानी"]), (2, [e.read_as("धान", "cp1252")]), (3, ["धान"]), (4, [e.read_as("กข", "cp1252")])]
    bad = cut(e.garbled_tokens(spark.createDataFrame(rows, "slide_key long, text array<string>"), "text"))
    assert {r.token: r.original for r in bad.collect()} == {e.read_as("धान", "cp1252"): "धान"}  # no clean word has the letters of the last
