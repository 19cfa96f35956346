import pytest
from pyspark.sql import functions as F

from deckmill import __main__ as command
from tests.test_pdf import build, stream
from tests.test_sources import package, shape, slide


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    title = lambda t: shape(2, "T", 100, 50, 800, 100, t, '<p:ph type="title"/>')
    (d / "one.pptx").write_bytes(package(**{"ppt/slides/slide1.xml": slide(title("The problem") + shape(3, "B", 100, 200, 800, 80, "Problem statement id: 26000005|Team name: Alpha")), "ppt/slides/slide2.xml": slide(title("Our approach"))}))
    (d / "broken.pptx").write_bytes(b"PK nothing")
    page = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [3 0 R] /MediaBox [0 0 600 800] >>", 3: "<< /Type /Page /Contents 4 0 R >>", 4: stream(b"BT /F1 12 Tf 100 700 Td (The solution) Tj ET")}
    (d / "PS-26000005 two.pdf").write_bytes(build(page))
    o = tmp_path_factory.mktemp("out")
    assert command.main(["rank", str(d), "--out", str(o)]) == 0
    return str(o)


def test_files_to_board(spark, out):
    b = {r.submission_id: r for r in spark.read.parquet(f"{out}/board").collect()}
    assert {k: (r.ps_id, r.status, r.bucket, r.place) for k, r in b.items()} == {"one": ("26000005", "review", "REVIEW", None), "PS-26000005-two": ("26000005", "review", "REVIEW", None), "broken": ("UNASSIGNED", "failed", "REVIEW", None)}
    assert b["one"].team == "Alpha" and b["broken"].error and b["one"].deck_quality_score is not None and b["PS-26000005-two"].deck_quality_score is not None
    assert spark.read.parquet(f"{out}/slides").count() == 3
    lines = [r.line for r in spark.read.parquet(f"{out}/lines").where("ps_id = '26000005'").orderBy("section", F.col("place").asc_nulls_last(), "submission_id").collect()]
    assert lines[-1].startswith("| REVIEW | one | Alpha | REVIEW | N/A |")


def test_commands(spark, data, tmp_path, capsys):
    assert command.main(["list"]) == 0 and "leaderboard" in capsys.readouterr().out
    assert command.main(["query", "media_types", data, "--out", str(tmp_path / "q")]) == 0 and spark.read.parquet(str(tmp_path / "q")).count() > 0
    with pytest.raises(SystemExit):
        command.main(["query", "nothing", data, "--out", "x"])
