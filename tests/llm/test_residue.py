import regex as re

import pytest
from pyspark.sql import functions as F

from deckmill.llm import residue as r

PATTERNS = [re.compile(p) for p in (*r.LINES, *map(r._whole, r.OPEN_GRAMMARS.values()))]


def whole(s):
    told = any(p.search(s.lower()) for p in PATTERNS[: len(r.LINES)])
    assert not told or re.search(r.GATE, s.lower())  # the gate lets every segment of the grammars pass
    return any(p.search(s.lower()) for p in PATTERNS)


@pytest.mark.parametrize("s", ["{{mentor name}}", "[insert chart here]", "<logo>", "%college%", "__summary text__", "• {{a}} {{b}}", "your logo goes here", "Click to add subtitle", "Double-tap to enter text", "Votre texte ici", "Text durch Klicken ergänzen", "TBD", "XXXX XXXX", "Second level", "HTTP 404", "(error 946)", "Error 0x80070108: access to this resource is denied", "410 – page introuvable", "Oops! Bad gateway (429)", "Try again later.", "Please enable JavaScript to continue.", "Veuillez activer JavaScript and reload the viewer.", "Your browser does not support this viewer ; some features will not work.", "404 Not Found", "503 Service Unavailable", "Нажмите, чтобы добавить текст", "Ошибка 404: страница не найдена", "शीर्षक जोड़ने के लिए क्लिक करें", "dd.mm.yyyy goes here", "{{" + "a long slot " * 20 + "}}", "Could not load " + "a very long name of an object " * 9])
def test_residue_lines(s):
    assert whole(s)


@pytest.mark.parametrize("s", ["Our generator fills the {{name}} and {{ward}} placeholders of each letter.", "Access denied events (403) fell by 90 after roles were given to clinics.", "With JavaScript off the kiosk still renders.", "The gateway retries when the server answers 503.", "Errors in seat maps fell from 70 to 33.7.", "Thanks for your attention", "We welcome your questions", "List<String> names = load();", "Scalability", "50 % of users and 20 % of clinics", "[1] and [2] are cited here", "[1]", "<div>", "</td>", "{% for x in rows %}", "Your session has expired too early. We measured it. Then we changed the limit."])
def test_content_lines(s):
    assert not whole(s)


def test_fields(spark):
    rows = [
        (1, ["{{headline}}", "TBD"], ["A real note about {{name}} in letters sent today."]), (2, ["Title", "Lorem ipsum dolor sit amet elit\nsit amet elit"], None), (3, [], [None, ""]), (4, None, ["y" * 200_000]),
        (5, ["one two", "TBD TBD"], ["one", "TBD TBD"]), (1, ["{{headline}}", "TBD"], ["A real note about {{name}} in letters sent today."]),
    ]
    df = spark.createDataFrame(rows, "slide_key long, text array<string>, notes array<string>").withColumn("f", F.lit(1)).withColumn("words", F.lit(1))
    assert sorted(map(tuple, r.residue_fields(df).collect())) == [(1, "text"), (2, "text"), (5, "notes")]  # exactly half isn't a case
    assert r.residue_fields(df.where("slide_key < 0")).count() == 0


def test_fields_in_any_letter_case_and_order(spark):
    lines = ["Your Title Goes Here", "COMPANY LOGO GOES HERE", "Logo Placeholder", "THIS PAGE IS NO LONGER AVAILABLE", "Bild Durch Klicken einfügen", "This file has been deleted.", "Pages Were Moved Or Removed", "Error 404 - this document was removed", "Lorem ipsum dolor elit tempor labore"]
    content = ["Our lorem ipsum notes are for the people in town", "Seats no longer wait for the clerk", "We moved the deleted rows to the archive"]
    rows = [(i, [t], None) for i, t in enumerate(lines + content)]
    got = r.residue_fields(spark.createDataFrame(rows, "slide_key long, text array<string>, notes array<string>")).collect()
    assert sorted(x.slide_key for x in got) == list(range(len(lines)))


def found(spark, lines, notes=None):
    rows = [(i, t if isinstance(t, list) else [t], notes) for i, t in enumerate(lines)]
    got = r.residue_fields(spark.createDataFrame(rows, "slide_key long, text array<string>, notes array<string>")).collect()
    return sorted(x.slide_key for x in got)


def test_joined_messages(spark):
    yes = ["Error 500: Seite nicht gefunden / Try again later.", "HTTP E-998 / (error 996)", "429 – service temporarily unavailable | Reference: 87c2beff7c", "TBD · {{name}}"]
    assert found(spark, [*yes, "Input / output", "Seats / forms | tables"]) == [0, 1, 2, 3]


def test_context_of_code_and_examples(spark):
    code = [
        ["```", "{{name}}", "[[team]]", "Error 404: page not found", "```"], ["Syntax of the tag:", "{{name}}"], ["{% for x in rows %}", "{{x}}", "{% endfor %}"], ["[dependencies]", "serde = 1"],
        ["def render(row):", "{{row}}", "return html;"], ["`{{name}}` `{{team}}`"], ["__init__", "self.x = 1;"],
    ]
    assert found(spark, [*code, ["{{name}}", "[[team]]"]]) == [len(code)]


def test_filler_is_told_by_the_corpus(spark):
    made = ["lorem ipsum vetra campe orsit", "vetra campe Lorem orsit ipsum restu", "restu lorem campe"]
    alone, ordinary = "Campe orsit vetra restu campe", ["a report about campe harvest in town", "the mock pages used lorem ipsum for a week", "the mock pages used lorem ipsum for a year"]
    lines = [*made, alone, *ordinary]
    assert found(spark, lines) == [0, 1, 2, 3]
    # words that ordinary texts use too aren't filler
    assert found(spark, [*lines, *["restu orsit campe vetra four pilot towns"] * 40]) == []
