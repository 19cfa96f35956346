import zlib

import pytest

from deckmill.functions.labels import page_labels
from deckmill.sources import pdf


def build(objects, trailer="/Root 1 0 R", head=b"%PDF-1.7\n"):
    out = head
    for n, body in objects.items():
        out += f"{n} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    return out + f"trailer << {trailer} >>\n%%EOF".encode()


def stream(data, extra="", flate=True):
    data = zlib.compress(data) if flate else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode' if flate else ''} {extra} >>\nstream\n".encode() + data + b"\nendstream"


@pytest.fixture(scope="module")
def sample():
    text = b"q 100 0 0 50 50 50 cm /Im1 Do Q BT /F1 12 Tf 100 700 Td (Hello \\(a\\) \\344) Tj 0 -20 TD [(wor) -300 (ld)] TJ T* <0102> Tj ET % end"
    cmap = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <03> <0416> endbfrange"
    objects = {
        1: "<< /Type /Catalog /Pages 2 0 R /Outlines 20 0 R /PageLabels << /Nums [0 << /S /r >> 1 << /S /D /P (A-) /St 7 >>] >> /Names << /EmbeddedFiles << /Names [(f) 30 0 R] >> /Dests << /Names [(there) [4 0 R /Fit]] >> >> >>",
        2: "<< /Type /Pages /Kids [3 0 R 4 0 R 2 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources << /Font << /F1 10 0 R >> /XObject << /Im1 12 0 R >> >> >>",
        3: "<< /Type /Page /Parent 2 0 R /Contents 5 0 R /Annots [6 0 R << /Subtype /Link /Rect [0 0 60 80] /Dest (there) >>] >>", 4: "<< /Type /Page /Parent 2 0 R /Rotate 90 /Contents [7 0 R] >>",
        5: stream(text), 6: "<< /Type /Annot /Subtype /Link /Rect [300 400 360 480] /A << /S /URI /URI (https://x.example/) >> >>", 7: stream(b"BT /F1 10 Tf 1 0 0 1 0 790 Tm (Top) Tj ET", flate=False),
        10: "<< /Type /Font /Subtype /Type1 /ToUnicode 11 0 R /FirstChar 72 /Widths [722] >>", 11: stream(cmap), 12: "<< /Subtype /Image /Width 30 /Height 20 /Length 0 >>\nstream\n\nendstream",
        20: "<< /First 21 0 R >>", 21: "<< /Title <FEFF00C4> /Dest [3 0 R /Fit] /First 22 0 R /Next 23 0 R >>", 22: "<< /Title (Sub) /Dest (there) >>", 23: "<< /Title (Last) /A << /URI (https://y.example/) >> /Next 21 0 R >>",
        30: "<< /F (data.csv) /EF << /F 31 0 R >> >>", 31: stream(b"a,b\n1,2\n"),
    }
    return build(objects)


def test_facts_of_a_file(spark, sample):
    f = pdf.read_pdfs(spark.createDataFrame([("a.pdf", sample), ("b.pptx", b"PK"), ("c.pdf", b"%PDF-1.4 nothing"), ("d.pdf", build({1: "<< >>"}, "/Encrypt 9 0 R"))], "path string, content binary")).cache()
    assert {r.path: r.kind for r in f.where("kind in ('error', 'encrypted')").collect()} == {"c.pdf": "error", "d.pdf": "encrypted"}
    assert [(r.page, r.width, r.height, r.rotation) for r in pdf.pages(f).orderBy("page").collect()] == [(1, 600.0, 800.0, 0), (2, 800.0, 600.0, 90)]
    s = {(r.page, r.text): r for r in pdf.spans(f).collect()}
    assert set(s) == {(1, "Hello (a) ä"), (1, "wor ld"), (1, "AЖ"), (2, "Top")}
    h = s[(1, "Hello (a) ä")]
    assert (h.size, h.x) == (12.0, pytest.approx(100 / 600, abs=1e-6)) and h.y == pytest.approx(1 - (700 + 12 * 0.8) / 800, abs=1e-6) and h.h == pytest.approx(12 / 800, abs=1e-6)
    assert s[(1, "wor ld")].y > h.y and s[(2, "Top")].x > 0.9  # the page is turned
    i = pdf.images(f).first()
    assert (i.width, i.height, i.x, i.w, i.h) == (30, 20, pytest.approx(0.083333), pytest.approx(0.166667), 0.0625)
    a = {r.n: (r.subtype, r.target, r.x) for r in pdf.annotations(f).collect()}
    assert a == {1: ("Link", "https://x.example/", 0.5), 2: ("Link", "#page=2", 0.0)}
    assert [(r.level, r.title, r.target) for r in pdf.outlines(f).orderBy("n").collect()] == [(1, "Ä", "#page=1"), (2, "Sub", "#page=2"), (1, "Last", "https://y.example/")]
    labels = page_labels(pdf.pages(f).select("deck_id", "page"), pdf.label_entries(f))
    assert [r.label for r in labels.orderBy("page").collect()] == ["i", "A-7"]
    assert [(r.name, r.size) for r in pdf.attachments(f).collect()] == [("data.csv", 8)]
    assert [(r.slide_number, r.text) for r in pdf.page_texts(f).orderBy("slide_number").collect()] == [(1, ["Hello (a) ä", "wor ld", "AЖ"]), (2, ["Top"])]


def test_object_streams_and_predictors():
    inner = b"1 0 2 40 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(40) + b"<< /Kids [3 0 R] /MediaBox [0 0 10 10] >>"
    raw = build({5: stream(inner, "/Type /ObjStm /N 2 /First 9"), 3: "<< /Type /Page >>", 9: stream(b"", "/Type /XRef /Root 1 0 R")}, "")
    assert [r["kind"] for r in pdf.pdf_facts("x", raw)] == ["page"]
    rows = bytes([2, 1, 2, 3]) + bytes([2, 1, 1, 1]) + bytes([1, 5, 1, 1]) + bytes([0, 9, 9, 9])
    assert pdf._unpredicted(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7, 9, 9, 9])


@pytest.mark.parametrize("raw", [b"%PDF-1.7", b"%PDF-1.7 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj trailer << /Root 1 0 R >>", b"%PDF 1 0 obj " + b"[" * 5000, b"%PDF 1 0 obj << /A (x"])
def test_broken_files(raw):
    assert all(r["kind"] in ("error", "page") for r in pdf.pdf_facts("x", raw))
