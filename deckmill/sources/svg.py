"""Boxes of the elements of a rendered slide (SVG), as shares of its view."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packages import _mapped, attribute, local, parse_xml

BOXES = T.StructType([T.StructField("deck_id", T.StringType()), T.StructField("slide_number", T.IntegerType()), T.StructField("native_id", T.StringType()), *[T.StructField(k, T.DoubleType()) for k in "xywh"]])
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: Fixed value: numbers that each path command takes.
_TAKES = {"M": 2, "L": 2, "T": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "A": 7, "Z": 0}


def numbers(s: str | None) -> list[float]:
    return [float(x) for x in _NUMBER.findall(s or "")]


def times(m, n):
    """``n`` first, then ``m``."""
    return (m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def transform(s: str | None):
    """The matrix of a transform list."""
    m = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    for kind, args in re.findall(r"(\w+)\s*\(([^)]*)\)", s or ""):
        v = numbers(args)
        if kind == "matrix" and len(v) == 6:
            step = tuple(v)
        elif kind == "translate" and v:
            step = (1, 0, 0, 1, v[0], v[1] if len(v) > 1 else 0)
        elif kind == "scale" and v:
            step = (v[0], 0, 0, v[1] if len(v) > 1 else v[0], 0, 0)
        elif kind == "rotate" and v:
            c, s_ = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
            x, y = v[1:3] if len(v) > 2 else (0, 0)
            step = (c, s_, -s_, c, x - c * x + s_ * y, y - s_ * x - c * y)
        else:
            continue
        m = times(m, step)
    return m


def path_points(d: str) -> list[tuple[float, float]]:
    """End and control points of a path: a hull of what it draws, arcs by their ends."""
    out, x, y, start = [], 0.0, 0.0, (0.0, 0.0)
    for letter, args in re.findall(r"([MLHVCSQTAZmlhvcsqtaz])([^MLHVCSQTAZmlhvcsqtaz]*)", d or ""):
        kind, relative, v = letter.upper(), letter.islower(), numbers(args)
        size = _TAKES[kind]
        if kind == "Z":
            x, y = start
            continue
        for i in range(0, len(v) - size + 1, size):
            a = v[i : i + size]
            if kind in "HV":
                x, y = ((a[0] + x * relative), y) if kind == "H" else (x, a[0] + y * relative)
                out.append((x, y))
                continue
            pairs = [(a[5], a[6])] if kind == "A" else list(zip(a[::2], a[1::2]))
            pairs = [(p + x * relative, q + y * relative) for p, q in pairs]
            out += pairs
            x, y = pairs[-1]
            if kind == "M" and i == 0:
                start = (x, y)
    return out


def points_of(e) -> list[tuple[float, float]]:
    """Corner points of an element in its own coordinates; text by its size and letters."""
    v = lambda k: (numbers(attribute(e, k)) or [0.0])[0]
    kind = local(e)
    if kind in ("rect", "image", "use", "foreignObject"):
        return [(v("x"), v("y")), (v("x") + v("width"), v("y") + v("height"))] if v("width") or v("height") else []
    if kind == "circle":
        return [(v("cx") - v("r"), v("cy") - v("r")), (v("cx") + v("r"), v("cy") + v("r"))]
    if kind == "ellipse":
        return [(v("cx") - v("rx"), v("cy") - v("ry")), (v("cx") + v("rx"), v("cy") + v("ry"))]
    if kind == "line":
        return [(v("x1"), v("y1")), (v("x2"), v("y2"))]
    if kind in ("polygon", "polyline"):
        n = numbers(attribute(e, "points"))
        return list(zip(n[::2], n[1::2]))
    if kind == "path":
        return path_points(attribute(e, "d") or "")
    if kind == "text":
        size = (numbers(attribute(e, "font-size")) or [16.0])[0]
        return [(v("x"), v("y") - size), (v("x") + 0.5 * size * len("".join(e.itertext()).strip()), v("y") + 0.2 * size)]
    return []


def svg_boxes(raw: bytes, mark: str = "data-object-id") -> list[dict]:
    """(native_id, x, y, w, h) of each marked element: the hull of all that is drawn in it, under all transforms around it."""
    root = parse_xml(raw)
    view = numbers(attribute(root, "viewBox")) if root is not None else []
    if root is not None and len(view) != 4:
        view = [0.0, 0.0, *[(numbers(attribute(root, k)) or [0.0])[0] for k in ("width", "height")]]
    if root is None or not view[2] or not view[3]:
        return []
    found: dict[str, list] = {}
    stack = [(root, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), ())]
    while stack:
        e, m, marks = stack.pop()
        m = times(m, transform(attribute(e, "transform")))
        own = e.attrib.get(mark)
        marks = (*marks, own) if own else marks
        pts = points_of(e)
        if pts and marks:
            xs, ys = zip(*pts)
            corners = [(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]) for x in (min(xs), max(xs)) for y in (min(ys), max(ys))]
            for k in marks:
                found.setdefault(k, []).extend(corners)
        if local(e) not in ("defs", "clipPath", "mask", "symbol"):
            stack += [(c, m, marks) for c in e]
    out = []
    for k, pts in found.items():
        xs, ys = zip(*pts)
        x, y = (min(xs) - view[0]) / view[2], (min(ys) - view[1]) / view[3]
        out.append({"native_id": k, "x": round(x, 12), "y": round(y, 12), "w": round((max(xs) - min(xs)) / view[2], 12), "h": round((max(ys) - min(ys)) / view[3], 12)})
    return out


def rendered_boxes(renders: DataFrame, mark: str = "data-object-id") -> DataFrame:
    """(deck_id, slide_number, native_id, x, y, w, h) of rendered slides (deck_id, slide_number, content); what ``accuracy.geometry_mismatches`` takes."""
    rows = lambda r: [{"deck_id": r["deck_id"], "slide_number": r["slide_number"]} | b for b in svg_boxes(r["content"] or b"", mark)]
    return _mapped(renders.select("deck_id", "slide_number", F.col("content")), BOXES, rows)
