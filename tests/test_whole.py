"""Queries over small tables on which a shortened query gives other rows."""

from deckmill.plans import registry


def run(spark, folder, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return registry.queries()[name](spark, str(folder)).collect()


def test_media_components_have_no_limit_of_decks(spark, tmp_path):
    shares = [(d, "hot") for d in range(10, 22)] + [(21, "b"), (30, "B "), (40, "c"), (41, "c"), (50, "alone"), (60, None), (61, " ")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    decks_of = {}
    for d, h in shares:
        if h and h.strip():
            decks_of.setdefault(h.strip().lower(), set()).add(d)
    for ds in decks_of.values():
        for d in ds if len(ds) > 1 else ():
            a, b = sorted((find(min(ds)), find(d)))
            parent[b] = a
    got = run(spark, tmp_path, "media_components", assets=(shares + shares[:3], "deck_id long, sha256 string"))
    assert sorted(map(tuple, got)) == sorted((d, find(d)) for d in list(parent)) and len(got) == 15


def test_ids_and_teams_of_all_decks(spark, tmp_path):
    t = {
        1: [["Title"], ["• Team Name: • Vita  Flow", "x"], ["see SIH 26 000-640 and problem statement no: 7"]], 2: [["ps id 5, Problem Statement\nID – 26000700"]], 3: [["PS No. x"], ["ps number: ab_9"]], 4: [["PS 26000337"]],
        5: [["nothing"]], 6: [None, []], 8: [["Team name"], ["Alpha"]],
    }
    rows = [(k * 10 + n, k, n, x) for k, xs in t.items() for n, x in enumerate(xs, 1)]
    names = {1: "a.pptx", 2: "b.pptx", 3: "c.pptx", 4: "ps-1.pdf", 5: "My_PS-26000001.v2.pptx", 6: "d.pdf", 7: "e.f.pptx", 8: "g"}
    tables = {"slides": (rows + rows[2:4], "slide_key long, deck_id long, slide_number int, text array<string>"), "decks": (list(names.items()) + [(1, "a.pptx")], "deck_id long, deck_name string")}
    ids = run(spark, tmp_path, "inferred_problem", **tables)
    assert sorted((r.deck_id, r.ps_inferred) for r in ids) == [(1, "26000640"), (2, "26000700"), (3, "AB-9"), (4, "26000337"), (5, "26000001"), (6, "UNASSIGNED"), (7, "UNASSIGNED"), (8, "UNASSIGNED")]
    teams = run(spark, tmp_path, "inferred_team", **tables)
    assert sorted((r.deck_id, r.team) for r in teams) == [(1, "Vita Flow"), (2, "b"), (3, "c"), (4, "ps-1"), (5, "My_PS-26000001.v2"), (6, "d"), (7, "e.f"), (8, "Alpha")]


def _flow_slides():
    rows = [
        (1, 1, 1, ["Welcome", "our own words"]), (2, 1, 2, [" ", "The approach"]), (3, 1, 3, ["Numbers", None, "evaluation of it"]), (4, 1, 4, ["Bye"]),
        (5, 2, 1, ["Only one"]), (6, 3, 1, []), (7, 3, 2, ["Middle"]), (8, 3, 3, None), (9, 4, 1, ["x", "Roadmap"]), (10, 4, 2, ["y", "the PROBLEM"]),
    ]
    return {"slides": (rows + rows[:3], "slide_key long, deck_id long, slide_number int, text array<string>")}


def test_flow_reads_whole_slides_and_the_edges(spark, tmp_path):
    got = {r.deck_id: (r.coverage, r.ordered, r.opening, r.closing) for r in run(spark, tmp_path, "narrative_flow", **_flow_slides())}
    assert got == {1: (0.8, 1.0, 1, 1), 2: (0.0, 0.0, 0, 0), 3: (0.0, 0.0, 0, 0), 4: (0.4, 0.0, 1, 1)}


def test_slide_types_read_whole_slides(spark, tmp_path):
    got = {r.slide_type: (r.n_slides, r.n_decks) for r in run(spark, tmp_path, "slide_types", **_flow_slides())}
    assert got == {"content": (9, 4), "results": (1, 1)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_character_error_of_all_scripts(spark, tmp_path):
    titles = ["Plan", "Lösung – Überblick", "Losung - Uberblick", "किसान पानी", "किसान का पानी", "Проблема", "Проблемы", "“Fin” 🚀🎉", "'Fin' 🚀", "e\u0301t\u00e9", "\u00e9te\u0301"]
    rows = [(n, 1, n, [t, "more"]) for n, t in enumerate(titles)]
    got = run(spark, tmp_path, "character_error", slides=(rows + rows[:2], "slide_key long, deck_id long, slide_number int, text array<string>"))
    exp = {n: (d := _distance(t, u), round(d / len(t), 6)) for n, (t, u) in enumerate(zip(titles, titles[1:]))}
    assert {r.slide_key: (r.distance, r.cer) for r in got} == exp and len(got) == 10
