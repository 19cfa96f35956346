import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from deckmill.sources import images
from deckmill.sources import packages as p
from deckmill.sources import problems

A, P, R = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
REL = "http://schemas.openxmlformats.org/package/2006/relationships"


def png(w, h):
    ihdr = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + ihdr + struct.pack(">I", zlib.crc32(b"IHDR" + ihdr))


def shape(i, name, x, y, w, h, text="", ph=""):
    body = f"<p:txBody>{''.join(f'<a:p><a:r><a:t>{t}</a:t></a:r></a:p>' for t in text.split('|'))}</p:txBody>" if text else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{i}" name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"/></p:spPr>{body}</p:sp>'


def slide(inner):
    return f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>'


def package(**more):
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="G"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="100" y="100"/><a:ext cx="200" cy="200"/><a:chOff x="0" y="0"/><a:chExt cx="100" cy="100"/></a:xfrm></p:grpSpPr>{shape(10, "In", 50, 50, 10, 10)}</p:grpSp>'
    line = '<p:cxnSp><p:nvCxnSpPr><p:cNvPr id="4" name="L"/><p:cNvCxnSpPr><a:stCxn id="2" idx="0"/><a:endCxn id="3" idx="0"/></p:cNvCxnSpPr></p:nvCxnSpPr><p:spPr><a:xfrm><a:off x="300" y="450"/><a:ext cx="400" cy="0"/></a:xfrm><a:ln><a:tailEnd type="triangle"/></a:ln></p:spPr></p:cxnSp>'
    parts = {
        "[Content_Types].xml": '<Types><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="PNG" ContentType="x/second"/><Override PartName="/ppt/slides/slide1.xml" ContentType="x/slide"/></Types>',
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/><p:sldId id="3" r:id="r2"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="r1" Type="{R}/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="{R}/slide" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide(shape(2, "T", 100, 50, 800, 100, "Real title|second line", '<p:ph type="title"/>') + shape(3, "B", 700, 400, 200, 100) + line + group),
        "ppt/slides/slide2.xml": slide(shape(2, "T", 0, 0, 10, 10, "Other")),
        "ppt/slides/_rels/slide1.xml.rels": f'<Relationships xmlns="{REL}"><Relationship Id="i1" Type="{R}/image" Target="../media/image%201.png"/><Relationship Id="h1" Type="{R}/hyperlink" Target="https://x.example/" TargetMode="External"/><Relationship Id="d" Type="{R}/image" Target="../media/none.png"/><Relationship Id="e" Type="{R}/image" Target="../../../etc/passwd"/></Relationships>',
        "ppt/media/image 1.png": png(30, 20),
        "ppt/comments/comment1.xml": f'<p:cmLst xmlns:p="{P}"><p:cm authorId="7"><p:text> hello </p:text></p:cm></p:cmLst>',
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.fixture(scope="module")
def decks(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("decks")
    (d / "sub").mkdir()
    (d / "One.PPTX").write_bytes(package())
    (d / "sub" / "bad.pptx").write_bytes(package(**{"../evil.xml": "<a/>"}))
    (d / "sub" / "broken.pptx").write_bytes(b"PK nonsense")
    (d / "notes.txt").write_text("no")
    (d / "x.pdf").write_bytes(b"%PDF-1.7")
    return p.discover(spark, [str(d)])


def test_discovery(decks):
    assert [(r.path.rsplit("/", 1)[1], r.format) for r in decks.collect()] == [("One.PPTX", "pptx"), ("bad.pptx", "pptx"), ("broken.pptx", "pptx"), ("x.pdf", "pdf")]


def test_tables_of_a_package(decks):
    every = p.read_packages(decks).cache()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in every.where("error is not null").collect()}
    assert set(errors) == {"bad.pptx", "broken.pptx"} and "unsafe" in errors["bad.pptx"]
    parts = every.where("error is null")
    rels = p.relationships(parts)
    got = {r.rel_id: r.resolved_target for r in rels.where("source_part = 'ppt/slides/slide1.xml'").collect()}
    assert got == {"i1": "ppt/media/image 1.png", "h1": None, "d": "ppt/media/none.png", "e": None}
    assert [r.rel_id for r in p.dangling(rels, parts).collect()] == ["d"]
    types = {r.part: r.content_type for r in p.content_types(parts).collect()}
    assert types["ppt/slides/slide1.xml"] == "x/slide" and types["ppt/media/image 1.png"] == "image/png" and types["ppt/_rels/presentation.xml.rels"] == "application/octet-stream"
    order = p.slide_order(parts, rels)
    assert [(r.slide_number, r.part) for r in order.orderBy("slide_number").collect()] == [(1, "ppt/slides/slide2.xml"), (2, "ppt/slides/slide1.xml")]
    o = {r.name: r for r in p.objects(parts, order).where("slide_number = 2").collect()}
    assert (o["T"].type, o["T"].placeholder, o["T"].text, o["T"].x) == ("text", "title", "Real title\nsecond line", 0.1)
    assert (o["L"].from_id, o["L"].to_id, o["L"].tail) == ("2", "3", "triangle")
    assert (o["In"].x, o["In"].w, o["In"].parent_id) == (0.2, 0.02, o["G"].object_id)
    assert [r.text for r in p.slide_texts(p.objects(parts, order)).orderBy("slide_number").collect()] == [["Other"], ["Real title\nsecond line"]]
    assert [(r.asset_id, r.part) for r in p.media(parts, rels).collect()] == [("asset-0001", "ppt/media/image 1.png")]
    assert [(r.author_id, r.text) for r in p.comments(parts).collect()] == [("7", "hello")]
    i = parts.where("part like '%.png'").select(images.image_header(F.col("content")).alias("i")).first().i
    assert (i.format, i.width, i.height, i.alpha) == ("png", 30, 20, True)


@pytest.mark.parametrize("raw", [b"<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>", b"<a><b></a>", b""])
def test_hostile_xml(raw):
    assert p.parse_xml(raw) is None
    assert p.slide_objects("d", 1, raw, 10, 10) == []


def test_part_names():
    assert all(map(p.safe_part, ["a/b.xml", "[Content_Types].xml", "a b/ü.png"]))
    assert not any(map(p.safe_part, ["/a", "../a", "a/../b", "a\\b", "C:/x", "a//b", "a\n", ""]))


PAGE = """<div id="ViewProblemStatement12345"><div><table><tr><th>Problem Statement ID</th><td>X12345</td></tr><tr><th>Title</th><td>A <b>short</b> title</td></tr>
<tr><th>Description</th><td>Intro.<br>Expected Solution:<br>• First bullet of work<br>• Second bullet of work<br>Performance benchmark: under two seconds</td></tr></table></div></div>
<div id="ViewProblemStatement12345"><table><tr><th>Title</th><td>Again</td></tr></table></div>"""


def test_pages(spark):
    rows = problems.parse_pages(spark.createDataFrame([(PAGE,), (None,), ("",)], "html string"), "html").collect()
    assert len(rows) == 1 and rows[0].id == "12345" and rows[0].title == "A short title"
    assert [r.description for r in rows[0].requirements] == ["First bullet of work", "Second bullet of work", "Performance Benchmark: under two seconds"]


def test_json_problems(spark, tmp_path):
    good = {"id": "PS-7", "title": "t", "description": "d", "requirements": [{"id": "r1", "description": "x", "weight": 2}, {"id": "r2", "description": "y", "weight": 1}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"title": " ", "requirements": [{"id": "r", "weight": -1}, {"id": "r", "weight": 1}]}))
    ok, bad = problems.read_problems(spark, [str(tmp_path)])
    assert [r.ps_id for r in ok.collect()] == ["7"]
    assert [r.reason for r in bad.collect()] == ["title,repeated requirement,negative weight"]


def test_requirements_of_statements(spark):
    long = "A first sentence that is long enough. Short one. A second sentence that is long enough too!"
    rows = [("T", None), ("T", long), ("T", "Background • not this bullet\nExpected Solution\n• Estimate position data.\n• estimate  POSITION data.\n• tiny\n• - Validate the drift\nPerformance Benchmark: report over a route."), ("T", "• " + " • ".join(f"bullet number {i}" for i in range(20)))]
    df = spark.createDataFrame(rows, "t string, d string")
    got = [[x.description for x in r[0]] for r in df.select(problems.requirements_of(df["t"], df["d"])).collect()]
    assert got[0] == ["Address the official problem statement: T."]
    assert got[1] == ["A first sentence that is long enough.", "A second sentence that is long enough too!"]
    assert got[2] == ["Estimate position data.", "Validate the drift", "Performance Benchmark: report over a route."]
    assert len(got[3]) == 12 and got[3][0] == "bullet number 0"


def test_image_headers():
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 40, 60, 3) + b"\x00" * 9
    vp8x = b"RIFF" + b"\0" * 4 + b"WEBPVP8X" + b"\0" * 4 + bytes([16, 0, 0, 0]) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    vp8l = b"RIFF" + b"\0" * 4 + b"WEBPVP8L" + b"\0" * 4 + b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")
    vp8 = b"RIFF" + b"\0" * 4 + b"WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 100, 50)
    cases = {
        png(30, 20): ("png", 30, 20, True), b"GIF89a" + struct.pack("<HH", 5, 6) + b"\x21\xf9\x04": ("gif", 5, 6, True), b"GIF87a" + struct.pack("<HH", 5, 6): ("gif", 5, 6, False),
        b"BM" + b"\0" * 16 + struct.pack("<iiHH", 7, -8, 1, 32): ("bmp", 7, 8, True), jpeg: ("jpeg", 60, 40, False), vp8x: ("webp", 100, 50, True), vp8l: ("webp", 100, 50, True), vp8: ("webp", 100, 50, False),
        b'<?xml version="1.0"?><svg width="9" height="9" viewBox="0 0 20 10.5">': ("svg", 20, 10.5, None), b"<svg width='30px' height='3'/>": ("svg", 30, 3, None),
    }
    for raw, exp in cases.items():
        assert tuple(images.header(raw).values()) == exp
    for raw in (None, b"", b"\xff\xd8", b"\xff\xd8\xff\xe0\x00\x01", b"BM", b"RIFF0000WEBPVP8X", b"<svg>", b"text", png(1, 1)[:20]):
        assert images.header(raw) is None


def test_aspect_ratios(spark):
    df = spark.createDataFrame([(0.5, 0.5, 2.0, (("png", 100.0, 100.0, True)), [0.5, 0.0, 0.0, 0.0]), (0.5, 0.0, 2.0, None, None)], "w double, h double, s double, i struct<format:string,width:double,height:double,alpha:boolean>, c array<double>")
    got = [tuple(r[0]) for r in df.select(images.aspect_ratios(df["w"], df["h"], df["s"], df["i"], df["c"])).collect()]
    assert got == [(2.0, 1.0, 0.5, 1.5), (None, None, None, None)]


def test_styles_of_objects():
    run = f'<a:r><a:rPr sz="1800"><a:solidFill><a:schemeClr val="accent1"/></a:solidFill><a:latin typeface="Arial"/><a:hlinkClick r:id="h1"/></a:rPr><a:t>x</a:t></a:r>'
    sp = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="T"/></p:nvSpPr><p:spPr><a:xfrm flipH="1"><a:off x="0" y="0"/><a:ext cx="10" cy="10"/></a:xfrm><a:solidFill><a:srgbClr val="ff0000"/></a:solidFill></p:spPr><p:txBody><a:p>{run}</a:p></p:txBody></p:sp>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="3" name="P"/></p:nvPicPr><p:blipFill><a:srcRect l="25000" b="10000"/></p:blipFill><p:spPr/></p:pic>'
    tbl = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="F"/></p:nvGraphicFramePr><a:graphic><a:tbl><a:tr><a:tc><a:p><a:r><a:t>a</a:t></a:r></a:p></a:tc><a:tc><a:p/></a:tc></a:tr></a:tbl></a:graphic></p:graphicFrame>'
    t, q, f = p.slide_objects("d", 1, slide(sp + pic + tbl).encode(), 100, 100)
    assert (t["flip_h"], t["flip_v"], t["font_sizes"], t["font_family"], t["links"]) == (True, False, [18.0], "Arial", ["h1"])
    assert t["colors"] == [{"role": "fill", "color": "#FF0000"}, {"role": "font", "color": "scheme:accent1"}]
    assert q["crop"] == [0.25, 0.0, 0.0, 0.1] and f["type"] == "table" and f["cells"] == [["a", ""]]


def test_order_without_a_list(spark):
    raw = package(**{"ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide(""), "_rels/.rels": f'<Relationships xmlns="{REL}"><Relationship Id="a" Type="{R}/officeDocument" Target="ppt/presentation.xml"/></Relationships>'})
    parts = spark.createDataFrame(p.package_parts("x", raw), p.PARTS)
    assert [(r.slide_number, r.part) for r in p.slide_order(parts, p.relationships(parts)).orderBy("slide_number").collect()] == [(1, "ppt/slides/slide1.xml"), (2, "ppt/slides/slide2.xml"), (3, "ppt/slides/slide10.xml")]
