import pytest
from pyspark.sql import types as T

from deckmill.operators import adapters as a
from deckmill.sources import svg

ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])


def make():
    """A factory that workers get by value."""

    def reader():
        class Reader:
            calls = 0

            def ask(self, row):
                self.calls += 1
                if row["image"].startswith("bad"):
                    raise RuntimeError("no service")
                if row["image"] == "slow" and self.calls < 2:
                    raise TimeoutError("once")
                return {"text": row["image"].upper(), "confidence": 0.5}

        return Reader()

    return reader


reader = make()


def test_answers_errors_and_cache(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "bad")], "i int, image string")
    got, fresh = a.answered(rows, ["image"], reader, ANSWER, pause=0.0, tasks=1)
    r = {x.i: x for x in got.collect()}
    assert (r[1].text, r[2].text, r[1].cache_hit, r[1].error) == ("X", "X", False, None) and r[3].text is None and r[3].error == "RuntimeError: no service" and r[3].tries == 3
    assert fresh.count() == 2
    again, asked = a.answered(rows, ["image"], reader, ANSWER, cache=fresh.where("error is null"), pause=0.0)
    assert {x.i: x.cache_hit for x in again.collect()} == {1: True, 2: True, 3: False} and asked.count() == 1
    assert a.answered(rows, ["image"], reader, ANSWER, cache=fresh.where("error is null"), version="2", pause=0.0)[1].count() == 2  # another version asks again


def test_retry_and_stop_after_failures(spark):
    slow = spark.createDataFrame([("s", "slow")], "content_hash string, image string")
    assert [(x.text, x.tries) for x in a.ask(slow, reader, ANSWER, pause=0.0).collect()] == [("SLOW", 2)]
    many = spark.createDataFrame([(str(i), "bad") for i in range(6)], "content_hash string, image string").coalesce(1)
    got = sorted((x.content_hash, x.tries) for x in a.ask(many, reader, ANSWER, tries=1, pause=0.0).collect())
    assert got == [("0", 1), ("1", 1), ("2", 1), ("3", 0), ("4", 0), ("5", 0)]


def test_boxes_of_a_rendering(spark):
    raw = b"""<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200 100"><g transform="translate(20,10) scale(2)"><g data-object-id="2"><rect x="0" y="0" width="10" height="5"/><line x1="0" y1="0" x2="20" y2="5"/></g></g>
    <path data-object-id="3" d="M100 50 l20 0 v20 h-20 z M100,50 A 1 1 0 0 1 130 60"/><rect data-object-id="4" transform="rotate(90 50 50)" x="50" y="50" width="40" height="10"/><defs><rect data-object-id="9" width="5" height="5"/></defs><g data-object-id="8"/></svg>"""
    got = {b["native_id"]: (b["x"], b["y"], b["w"], b["h"]) for b in svg.svg_boxes(raw)}
    assert got["2"] == (0.1, 0.1, 0.2, 0.1) and got["3"] == (0.5, 0.5, 0.15, 0.2) and got["4"] == pytest.approx((0.2, 0.5, 0.05, 0.4)) and set(got) == {"2", "3", "4"}
    df = spark.createDataFrame([("d", 1, raw), ("d", 2, b"<svg/>"), ("d", 3, None), ("d", 4, b"junk")], "deck_id string, slide_number int, content binary")
    assert svg.rendered_boxes(df).count() == 3
