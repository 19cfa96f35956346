import collections
import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deckmill.llm import queries, visual_form
from deckmill.llm.visual_form import visual_form as form


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｋｉｔ 12", "Kit 12"), ("Café", "Café"), ("Åsta", "Åsta"), ("5 Ω", "5 Ω"), ("µm", "μm"), ("zero​width", "zerowidth"), ("so­ft", "soft"), ("a b c", "a b c"), ("Сору", "Copy"), ("ﬁle", "file"), ("e​́", "é"), ("a\r\nb", "a\nb"), ("क़", "क़")],
)
def test_look_alike(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("resume", "résumé"), ("Kit", "kit"), ("a\nb", "a b"), ("٣", "3"), ("½", "1/2"), ("①", "1"), ("\U0001f468‍\U0001f469", "\U0001f468\U0001f469"), ("ß", "ss")])
def test_visibly_different(a, b):
    assert form(a) != form(b)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_form_is_final_and_normal(s):
    once = form(s)
    assert form(once) == once
    assert form(unicodedata.normalize("NFD", s)) == form(unicodedata.normalize("NFC", s))


def test_longest_match():
    assert visual_form.Transducer({"a": "1", "ab": "2", "abc": "3"}).run("abcabax") == "321x"


def test_edges_of_input():
    assert form(None) is None and form("") == "" and form("x" * 1_000_000 + " ") == "x" * 1_000_000 + " "


def test_pairs_with_nulls_copies_and_clashing_columns(spark):
    rows = [
        (1, ["Kit", None], "f"), (2, ["Kit", ""], "f"), (3, ["Ｋit", ""], "f"), (3, ["Ｋit", ""], "f"), (4, ["Kit|"], "f"), (5, ["Kit", "|"], "f"), (6, None, "f"), (7, [], "f"), (8, ["Кit", "​"], "f"),
    ]
    df = spark.createDataFrame(rows, "slide_key long, text array<string>, form string").withColumn("raw", F.lit(1)).withColumn("key", F.lit(2))
    keyed = visual_form.forms(df, "slide_key", visual_form.packed(F.col("text"))).withColumn("record_type", F.lit("slide"))
    got = {(r.key_a, r.key_b) for r in visual_form.look_alike_pairs(keyed).collect()}
    assert got == {(1, 3), (2, 3), (1, 8), (2, 8), (3, 8)}
    assert visual_form.look_alike_pairs(keyed.where("key < 0")).count() == 0


def test_found_against_brute_force(spark, data, duck):
    got = {(r.record_type, r.key_a, r.key_b) for r in queries.queries()["p1_found"](spark, data).collect()}
    rows = duck.execute("select distinct 'slide', slide_key, text from slides where text is not null union all select distinct 'problem', problem_key, [description] from problems where description is not null").fetchall()
    groups = collections.defaultdict(dict)
    for r, k, t in rows:
        groups[(r, tuple(form(e or "") for e in t))][k] = tuple(e or "" for e in t)
    exp = {(r, min(a, b), max(a, b)) for (r, _), v in groups.items() for (a, s), (b, t) in itertools.combinations(v.items(), 2) if s != t}
    assert got == exp
