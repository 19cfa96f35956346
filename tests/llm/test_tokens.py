import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deckmill.llm import queries
from deckmill.llm import tokens as k

JSON, RANKS = f"{k.TOKENIZERS}/byte_bpe_50k.json", f"{k.TOKENIZERS}/{k.RANKS}"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder(tmp_path_factory):
    ranks = k.load_ranks(RANKS)
    path = tmp_path_factory.mktemp("lexicon") / "x"
    k.Transducer.compile({w: i for w, i in ranks.items() if w.isascii() and w.strip().isalpha()}).save(path)
    return k.Encoder(RANKS, path)


def test_transducer_is_minimal_and_exact(tmp_path):
    rnd = random.Random(1)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 6))): i for i in range(300)}
    t = k.Transducer.compile(words)
    t.save(tmp_path / "t")
    t = k.Transducer.map(tmp_path / "t")
    probes = [*words, b"", b"zz", b"abcabcabc"]
    assert t.look_up(probes).tolist() == [words.get(w, -1) for w in probes]
    suffixes = {tuple(sorted(x[len(p) :] for x in words if x.startswith(p))) for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(t.final) == len(suffixes)


def test_merge_equals_library():
    import tiktoken

    ranks = k.load_ranks(RANKS)
    enc = tiktoken.Encoding("x", pat_str=k.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    for n in [1, 2, 3, 8, 20, 200]:
        for _ in range(20):
            w = "".join(rnd.choice("abcdefghilmnorstuéü") for _ in range(n))
            assert k.merge(w.encode(), ranks) == enc.encode_ordinary(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0'sSéß1²३中🙂_-.,"), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=4))
def test_any_text(encoder, reference, texts):
    assert [np.frombuffer(b, np.int32).tolist() for b in encoder.encode(texts)] == reference(texts)


def test_table_starts_anew(encoder, monkeypatch, reference):
    monkeypatch.setattr(k, "TABLE", 5)
    texts = [f"word{i} and some more {i} words" for i in range(50)]
    assert [np.frombuffer(b, np.int32).tolist() for b in encoder.encode(texts)] == reference(texts)


def test_column_with_empty_and_long_texts(spark, reference):
    texts = ["a b", "", None, "   ", "x" * 20_000, "word " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in k.encoded(df, "doc_id", "text").collect()}
    assert got == {i: reference([t or ""])[0] for i, t in enumerate(texts)}
    assert k.encoded(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_query(spark, data, duck, reference):
    got = {r.doc_id: r.ids for r in queries.queries()["p7_ids"](spark, data).collect()}
    rows = duck.execute("select doc_id, text from documents").fetchall()
    assert got == dict(zip([r[0] for r in rows], reference([r[1] or "" for r in rows])))
