import pytest
from pyspark.sql import functions as F

from deckmill.functions.lineage import cut
from deckmill.sources import packages as p
from deckmill.sources import semantics as s
from tests.test_sources import A, P, R, REL, package, shape, slide

C = "http://schemas.openxmlformats.org/drawingml/2006/chart"
DGM = "http://schemas.openxmlformats.org/drawingml/2006/diagram"


def rel(*items):
    return f'<Relationships xmlns="{REL}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"


@pytest.fixture(scope="module")
def tables(spark):
    points = lambda *v: "".join(f'<c:pt idx="{i}"><c:v>{x}</c:v></c:pt>' for i, x in enumerate(v) if x is not None)
    series = f'<c:ser><c:tx><c:strRef><c:strCache>{points("Seats")}</c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache>{points("a", "b", "c")}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{points("1", None, "2.5")}</c:numCache></c:numRef></c:val></c:ser>'
    run = '<a:r><a:rPr><a:solidFill><a:schemeClr val="tx1"/></a:solidFill><a:latin typeface="+mn-lt"/><a:hlinkClick r:id="h1"/></a:rPr><a:t>x</a:t></a:r>'
    text = f'<p:sp><p:nvSpPr><p:cNvPr id="5" name="L"/></p:nvSpPr><p:spPr/><p:txBody><a:p>{run}</a:p></p:txBody></p:sp>'
    raw = package(**{
        "ppt/theme/theme1.xml": f'<a:theme xmlns:a="{A}"><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:accent1><a:srgbClr val="4472c4"/></a:accent1></a:clrScheme><a:fontScheme><a:majorFont><a:latin typeface="Head"/></a:majorFont><a:minorFont><a:latin typeface="Body"/></a:minorFont></a:fontScheme></a:theme>',
        "ppt/charts/chart1.xml": f'<c:chartSpace xmlns:c="{C}" xmlns:a="{A}"><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>By town</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>{series}</c:barChart></c:plotArea><c:legend/></c:chart></c:chartSpace>',
        "ppt/charts/chart2.xml": f'<c:chartSpace xmlns:c="{C}"><c:chart><c:plotArea/></c:chart></c:chartSpace>', "ppt/charts/chart3.xml": "broken",
        "ppt/diagrams/data1.xml": f'<dgm:dataModel xmlns:dgm="{DGM}" xmlns:a="{A}"><dgm:ptLst><dgm:pt modelId="1"><dgm:t><a:p><a:r><a:t>One</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt modelId="2"/><dgm:pt modelId="9" type="pres"/></dgm:ptLst><dgm:cxnLst><dgm:cxn modelId="3" srcId="1" destId="2"/><dgm:cxn modelId="4" srcId="1" destId="9"/></dgm:cxnLst></dgm:dataModel>',
        "ppt/slides/slide1.xml": slide(text), "ppt/notesSlides/notesSlide1.xml": slide(shape(2, "N", 0, 0, 1, 1, "Say hello") + shape(3, "S", 0, 0, 1, 1, "7", '<p:ph type="sldNum"/>')),
        "ppt/slides/_rels/slide1.xml.rels": rel(("h1", "hyperlink", "../slides/slide2.xml"), ("n", "notesSlide", "../notesSlides/notesSlide1.xml"), ("l", "slideLayout", "../slideLayouts/slideLayout1.xml")),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rel(("m", "slideMaster", "../slideMasters/slideMaster1.xml")), "ppt/slideMasters/_rels/slideMaster1.xml.rels": rel(("t", "theme", "../theme/theme1.xml")),
    })
    parts = spark.createDataFrame(p.package_parts("x", raw), p.PARTS)
    rels = cut(p.relationships(parts))
    order = cut(p.slide_order(parts, rels))
    return parts, rels, order, cut(p.objects(parts, order))


def test_themes_and_colors(tables):
    parts, _, _, objects = tables
    t = s.themes(parts)
    assert {(r.kind, r.name): r.value for r in t.collect()} == {("color", "dk1"): "#000000", ("color", "accent1"): "#4472C4", ("font", "major"): "Head", ("font", "minor"): "Body"}
    r = s.resolved_colors(objects, t).where("name = 'L'").first()
    assert [tuple(c) for c in r.colors] == [("font", "#000000")] and r.font_family == "Body"


def test_charts_and_diagrams(tables):
    parts = tables[0]
    got = {r.part[-5]: r for r in s.charts(parts).collect()}
    a = got["1"]
    assert (a.chart_type, a.title, a.name, a.categories, a["values"], a.has_legend) == ("barChart", "By town", "Seats", ["a", "b", "c"], [1.0, None, 2.5], True)
    assert got["2"].chart_type is None and "3" not in got
    d = [(r.kind, r.model_id, r.text, r.source, r.target) for r in s.smartart(parts).collect()]
    assert d == [("node", "1", "One", None, None), ("node", "2", "", None, None), ("edge", "3", None, "1", "2")]


def test_notes_links_and_ancestry(tables):
    parts, rels, order, objects = tables
    assert [(r.slide_number, r.notes) for r in s.notes(parts, rels, order).collect()] == [(2, "Say hello")]
    assert [(r.slide_number, r.resolved_target) for r in s.slide_links(objects, order, rels).collect()] == [(2, "ppt/slides/slide2.xml")]
    got = {r.slide_number: (r.layout, r.master, r.theme) for r in s.ancestry(rels, order).collect()}
    assert got == {1: (None, None, None), 2: ("ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml", "ppt/theme/theme1.xml")}


def test_matrices(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.4, 0.2, 0.0, False, False), (0.1, 0.2, 0.4, 0.2, 90.0, False, False), (0.0, 0.0, 1.0, 1.0, None, True, False)], "x double, y double, w double, h double, r double, fh boolean, fv boolean")
    m = df.select(s.matrix(*[F.col(c) for c in ("x", "y", "w", "h", "r", "fh", "fv")]).alias("m")).select("m", s.hull(F.col("m")).alias("b"))
    rows = m.collect()
    assert tuple(rows[0].b) == (0.1, 0.2, 0.4, 0.2) and tuple(rows[1].b) == pytest.approx((0.2, 0.1, 0.2, 0.4)) and (rows[2].m.a, rows[2].m.e, rows[2].m.d) == (-1.0, 1.0, 1.0)
