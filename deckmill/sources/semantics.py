"""Meaning of package parts: themes, charts, diagrams made of nodes, notes, and which parts a slide inherits from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packages import _child, _mapped, attribute, color_of, local, paragraphs, parse_xml

_S, _D = T.StringType(), T.DoubleType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


THEMES = _schema(deck_id=_S, part=_S, kind=_S, name=_S, value=_S)


def themes(parts: DataFrame) -> DataFrame:
    """(deck_id, part, kind, name, value) of the theme parts: kind 'color' with the scheme's name and '#RRGGBB', kind 'font' with 'major' or 'minor' and the Latin typeface."""

    def rows(r):
        root, out = parse_xml(r["content"]), []
        base = {"deck_id": r["deck_id"], "part": r["part"]}
        for e in root.iter() if root is not None else ():
            if local(e) == "clrScheme":
                out += [base | {"kind": "color", "name": local(c), "value": v} for c in e if (v := color_of(c)) and v.startswith("#")]
            elif local(e) in ("majorFont", "minorFont") and (latin := _child(e, "latin")) is not None and attribute(latin, "typeface"):
                out.append(base | {"kind": "font", "name": local(e)[:5], "value": attribute(latin, "typeface")})
        return out

    return _mapped(parts.where(F.col("part").rlike(r"/theme/[^/]*\.xml$")).select("deck_id", "part", "content"), THEMES, rows)


#: Names that masters give the theme's colours by default.
_ALIASES = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}


def resolved_colors(objects: DataFrame, theme: DataFrame) -> DataFrame:
    """``objects`` with the scheme colours of ``colors`` as '#RRGGBB' of the deck's first theme; names that it lacks are left out, and fonts '+mj' and '+mn' become its typefaces."""
    first = theme.groupBy("deck_id").agg(F.min("part").alias("part"))
    t = theme.join(first, ["deck_id", "part"]).groupBy("deck_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "name"), "value"))).alias("__t"))
    d = objects.join(t, "deck_id", "left")
    alias = F.create_map(*[F.lit(x) for kv in _ALIASES.items() for x in kv])

    def value(c):
        name = F.substring_index(c, ":", -1)
        return F.when(c.startswith("scheme:"), F.try_element_at("__t", F.concat(F.lit("color:"), F.coalesce(F.try_element_at(alias, name), name)))).otherwise(c)

    colors = F.filter(F.transform("colors", lambda c: F.struct(c["role"].alias("role"), value(c["color"]).alias("color"))), lambda c: c["color"].isNotNull())
    family = F.when(F.col("font_family").startswith("+mj"), F.try_element_at("__t", F.lit("font:major"))).when(F.col("font_family").startswith("+mn"), F.try_element_at("__t", F.lit("font:minor"))).otherwise(F.col("font_family"))
    return d.withColumns({"colors": colors, "font_family": family}).drop("__t")


CHARTS = _schema(deck_id=_S, part=_S, chart_type=_S, title=_S, series=T.IntegerType(), name=_S, categories=T.ArrayType(_S), values=T.ArrayType(_D), has_legend=T.BooleanType())


def charts(parts: DataFrame) -> DataFrame:
    """(deck_id, part, chart_type, title, series, name, categories, values, has_legend): each series of each chart part, from the values cached in it; a chart without series gives one row of its own."""

    def cached(e):
        """Points of a reference's cache by their index."""
        points = {int(attribute(p, "idx") or 0): next((v.text for v in p if local(v) == "v"), None) for p in (e.iter() if e is not None else ()) if local(p) == "pt"}
        return [points.get(i) for i in range(max(points) + 1)] if points else []

    def number(x):
        try:
            return float(x)
        except (TypeError, ValueError):
            return None

    def rows(r):
        root = parse_xml(r["content"])
        chart = next((e for e in root.iter() if local(e) == "chart"), None) if root is not None else None
        if chart is None:
            return []
        title = _child(chart, "title")
        base = {"deck_id": r["deck_id"], "part": r["part"], "title": paragraphs(title) or None if title is not None else None, "has_legend": _child(chart, "legend") is not None, "chart_type": None, "series": None, "name": None, "categories": None, "values": None}
        out = []
        for plot in _child(chart, "plotArea") if _child(chart, "plotArea") is not None else ():
            if local(plot).endswith("Chart"):
                for s in (x for x in plot if local(x) == "ser"):
                    name = cached(_child(s, "tx"))
                    cat = next((c for c in (_child(s, "cat"), _child(s, "xVal")) if c is not None), None)
                    val = next((c for c in (_child(s, "val"), _child(s, "yVal")) if c is not None), None)
                    out.append(base | {"chart_type": local(plot), "series": len(out) + 1, "name": name[0] if name else None, "categories": cached(cat), "values": [number(v) for v in cached(val)]})
        return out or [base]

    return _mapped(parts.where(F.col("part").rlike(r"/charts/chart[^/]*\.xml$")).select("deck_id", "part", "content"), CHARTS, rows)


SMART = _schema(deck_id=_S, part=_S, kind=_S, model_id=_S, text=_S, source=_S, target=_S)


def smartart(parts: DataFrame) -> DataFrame:
    """(deck_id, part, kind, model_id, text, source, target): the nodes of diagram data parts with their texts, and the connections between nodes (kinds 'node' and 'edge'); points of layout or transitions are left out."""

    def rows(r):
        root, out = parse_xml(r["content"]), []
        base = {"deck_id": r["deck_id"], "part": r["part"], "text": None, "source": None, "target": None}
        nodes = set()
        for e in root.iter() if root is not None else ():
            if local(e) == "pt" and (attribute(e, "type") or "node") == "node":
                nodes.add(attribute(e, "modelId"))
                out.append(base | {"kind": "node", "model_id": attribute(e, "modelId"), "text": paragraphs(e)})
        for e in root.iter() if root is not None else ():
            if local(e) == "cxn" and (attribute(e, "type") or "parOf") == "parOf" and {attribute(e, "srcId"), attribute(e, "destId")} <= nodes:
                out.append(base | {"kind": "edge", "model_id": attribute(e, "modelId"), "source": attribute(e, "srcId"), "target": attribute(e, "destId")})
        return out

    return _mapped(parts.where(F.col("part").rlike(r"/diagrams/data[^/]*\.xml$")).select("deck_id", "part", "content"), SMART, rows)


def notes(parts: DataFrame, rels: DataFrame, order: DataFrame) -> DataFrame:
    """(deck_id, slide_number, notes): the texts of each slide's notes part, its slide number's placeholder aside; slides without notes are left out."""

    def rows(r):
        root = parse_xml(r["content"])
        texts = []
        for sp in (e for e in root.iter() if local(e) == "sp") if root is not None else ():
            ph = next((x for x in sp.iter() if local(x) == "ph"), None)
            body = _child(sp, "txBody")
            if body is not None and (ph is None or attribute(ph, "type") not in ("sldNum", "dt", "ftr", "hdr")):
                texts.append(paragraphs(body))
        text = "\n".join(t for t in texts if t.strip())
        return [{"deck_id": r["deck_id"], "part": r["part"], "notes": text}] if text else []

    n = _mapped(parts.where(F.col("part").rlike(r"/notesSlides/[^/]*\.xml$")).select("deck_id", "part", "content"), _schema(deck_id=_S, part=_S, notes=_S), rows)
    of = rels.where("type = 'notesSlide'").select("deck_id", F.col("source_part").alias("slide"), F.col("resolved_target").alias("part")).distinct()
    return order.select("deck_id", "slide_number", F.col("part").alias("slide")).join(of, ["deck_id", "slide"]).join(n, ["deck_id", "part"]).select("deck_id", "slide_number", "notes")


def ancestry(rels: DataFrame, order: DataFrame) -> DataFrame:
    """(deck_id, slide_number, layout, master, theme): the parts that a slide takes its style from; null where a link is missing."""
    link = lambda kind, up, down: rels.where(F.col("type") == kind).groupBy("deck_id", F.col("source_part").alias(up)).agg(F.min("resolved_target").alias(down))
    d = order.select("deck_id", "slide_number", F.col("part").alias("slide")).join(link("slideLayout", "slide", "layout"), ["deck_id", "slide"], "left")
    d = d.join(link("slideMaster", "layout", "master"), ["deck_id", "layout"], "left").join(link("theme", "master", "theme"), ["deck_id", "master"], "left")
    return d.select("deck_id", "slide_number", "layout", "master", "theme")


def slide_links(objects: DataFrame, order: DataFrame, rels: DataFrame) -> DataFrame:
    """(deck_id, slide_number, object_id, target, resolved_target, mode): where the links of a slide's objects lead."""
    o = objects.select("deck_id", "slide_number", "object_id", F.explode("links").alias("rel_id")).join(order.select("deck_id", "slide_number", F.col("part").alias("source_part")), ["deck_id", "slide_number"])
    return o.join(rels.select("deck_id", "source_part", "rel_id", "target", "resolved_target", "mode"), ["deck_id", "source_part", "rel_id"]).select("deck_id", "slide_number", "object_id", "target", "resolved_target", "mode")


def matrix(x: Column, y: Column, w: Column, h: Column, rotation: Column, flip_h: Column, flip_v: Column) -> Column:
    """STRUCT<a, b, c, d, e, f>: the affine matrix that takes the unit square to a box turned about its centre and flipped: (u, v) goes to (a u + c v + e, b u + d v + f)."""
    t = F.radians(F.coalesce(rotation, F.lit(0.0)))
    sx, sy = F.when(flip_h, -1.0).otherwise(1.0), F.when(flip_v, -1.0).otherwise(1.0)
    a, b, c, d = w * sx * F.cos(t), w * sx * F.sin(t), -h * sy * F.sin(t), h * sy * F.cos(t)
    r = lambda v, n: (F.round(v, 12) + 0.0).alias(n)
    return F.struct(r(a, "a"), r(b, "b"), r(c, "c"), r(d, "d"), r(x + w / 2 - (a + c) / 2, "e"), r(y + h / 2 - (b + d) / 2, "f"))


def hull(m: Column) -> Column:
    """STRUCT<x, y, w, h>: the upright box around the unit square under a matrix."""
    xs = [m["e"], m["a"] + m["e"], m["c"] + m["e"], m["a"] + m["c"] + m["e"]]
    ys = [m["f"], m["b"] + m["f"], m["d"] + m["f"], m["b"] + m["d"] + m["f"]]
    return F.struct(F.round(F.least(*xs), 12).alias("x"), F.round(F.least(*ys), 12).alias("y"), F.round(F.greatest(*xs) - F.least(*xs), 12).alias("w"), F.round(F.greatest(*ys) - F.least(*ys), 12).alias("h"))
