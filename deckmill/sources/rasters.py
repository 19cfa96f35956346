"""Lines, shapes, boxes and arrow heads in the pixels of PNG images, and the graph candidates made of them.

Pixels are looked at where an image's bytes are, as whole arrays; what comes out
are facts with boxes in shares of the image. They are candidates: nothing found
in pixels alone is verified. Graphs are made of the facts by joins keyed by image.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packages import _mapped

#: Longest side that is looked at, greatest grey that is dark, shortest line as a share of a side, most lines, shapes, boxes and heads of an image, farthest distance of a line's end from its node.
LONGEST, DARK, SHORTEST, MOST_LINES, MOST_SHAPES, MOST_BOXES, REACH = 512, 200, 0.04, 128, 128, 64, 0.06
FAILURES = ("ocr_failure", "text_mask_failure", "line_detection_failure", "arrowhead_failure", "endpoint_matching_failure", "graph_assembly_failure")
FACTS = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()), *[T.StructField(k, T.DoubleType()) for k in "xywh"], T.StructField("direction", T.StringType()), T.StructField("pixels", T.LongType()),
])


def _rows(raw: bytes, height: int, width: int, step: int) -> np.ndarray:
    """The bytes of a PNG's rows, differences undone; ``width`` is a row's bytes, ``step`` a pixel's."""
    stored = np.frombuffer(raw, np.uint8, height * (width + 1)).reshape(height, width + 1)
    out, above = np.empty((height, width), np.uint8), np.zeros(width, np.uint8)
    for i in range(height):
        kind, row = stored[i, 0], stored[i, 1:]
        if kind == 1:
            pad = np.zeros(-(-width // step) * step, np.uint8)
            pad[:width] = row
            row = np.add.accumulate(pad.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            cur, up = row.astype(int).tolist(), above.astype(int).tolist()
            for j in range(width):
                a, c = (cur[j - step], up[j - step]) if j >= step else (0, 0)
                b = up[j]
                add = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
                cur[j] = (cur[j] + add) & 255
            row = np.array(cur, np.uint8)
        out[i] = above = row
    return out


def grey(raw: bytes | None) -> np.ndarray | None:
    """The grey values of a PNG of eight bits a channel that isn't interlaced, sampled down to LONGEST; None for anything else."""
    if not raw or raw[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, palette, head = 8, b"", None, None
    while at + 8 <= len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(head[3]) if head else None
    if channels is None or head[2] != 8 or head[6]:
        return None
    try:
        pixels = _rows(zlib.decompress(data), head[1], head[0] * channels, channels).reshape(head[1], head[0], channels)
    except (zlib.error, ValueError):
        return None
    if head[3] == 3:
        if palette is None or pixels.max(initial=0) >= len(palette):
            return None
        pixels = palette[pixels[:, :, 0]]
    colour = pixels[:, :, :3] if pixels.shape[2] >= 3 else pixels[:, :, :1]
    out = (colour @ np.array([0.299, 0.587, 0.114])) if colour.shape[2] == 3 else colour[:, :, 0].astype(float)
    scale = max(out.shape) / LONGEST
    if scale > 1:
        pick = lambda n: np.minimum((np.arange(max(1, round(n / scale))) * scale).astype(int), n - 1)
        out = out[pick(out.shape[0])][:, pick(out.shape[1])]
    return np.rint(out).astype(np.uint8)


def runs(dark: np.ndarray) -> np.ndarray:
    """(row, start, length) of the runs of true along each row."""
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return np.stack([row, start, np.nonzero(edge == -1)[1] - start], axis=1)


def line_boxes(dark: np.ndarray) -> list[list[int]]:
    """[left, top, right, bottom] of horizontal lines: long runs, of which those close above each other are one line; the largest first take the others in."""
    height, width = dark.shape
    long = runs(dark)
    long = long[long[:, 2] >= max(6, round(width * SHORTEST))]
    near, out = max(3.0, height * 0.02), []
    for row, start, size in long[np.lexsort((long[:, 1], long[:, 0], -long[:, 2]))].tolist():
        end = start + size
        for b in out:
            shared = min(end, b[2]) - max(start, b[0])
            if abs(row + 0.5 - (b[1] + b[3]) / 2) <= near and shared >= 0.5 * min(size, b[2] - b[0]):
                b[:] = [min(b[0], start), min(b[1], row), max(b[2], end), max(b[3], row + 1)]
                break
        else:
            if len(out) < MOST_LINES:
                out.append([start, row, end, row + 1])
    return sorted(out, key=lambda b: (b[1], b[0]))


def shapes(dark: np.ndarray) -> list[tuple[int, list[int]]]:
    """(pixels, [left, top, right, bottom]) of the connected dark regions, largest first; specks are left out. Regions are joined run by run."""
    r = runs(dark)
    parent = list(range(len(r)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(r[:, 0], np.arange(dark.shape[0] + 1)).tolist()
    spans = r.tolist()
    for y in range(dark.shape[0] - 1):
        i, j = first[y], first[y + 1]
        while i < first[y + 1] and j < first[y + 2]:
            a, b = spans[i], spans[j]
            if a[1] < b[1] + b[2] and b[1] < a[1] + a[2]:
                parent[find(i)] = find(j)
            if a[1] + a[2] < b[1] + b[2]:
                i += 1
            else:
                j += 1
    found: dict[int, list] = {}
    for i, (y, x, n) in enumerate(spans):
        g = found.setdefault(find(i), [0, x, y, x + n, y + 1])
        g[:] = [g[0] + n, min(g[1], x), min(g[2], y), max(g[3], x + n), max(g[4], y + 1)]
    least = max(4, round(dark.size * 0.00002))
    return sorted(((g[0], g[1:]) for g in found.values() if g[0] >= least), key=lambda s: (-s[0], s[1][1], s[1][0]))[:MOST_SHAPES]


def boxes_of(across: list, down: list) -> list[tuple]:
    """(x, y, w, h) of rectangles framed by two lines across and two down; lines are (x, y, w, h) in shares."""
    out, slack = set(), 0.04
    for i, t in enumerate(across):
        for b in across[i + 1 :]:
            top, bottom, left, right = t[1], b[1] + b[3], max(t[0], b[0]), min(t[0] + t[2], b[0] + b[2])
            if bottom - top < slack or right - left < slack:
                continue
            tall = [v for v in down if v[1] <= top + slack and v[1] + v[3] >= bottom - slack]
            for a in (v for v in tall if abs(v[0] - left) <= slack):
                for z in (v for v in tall if abs(v[0] + v[2] - right) <= slack):
                    if z[0] + z[2] - a[0] >= slack:
                        out.add(tuple(round(v, 12) for v in (a[0], top, z[0] + z[2] - a[0], bottom - top)))
    return sorted(out, key=lambda b: (b[1], b[0], b[2], b[3]))[:MOST_BOXES]


def heads(dark: np.ndarray, ends: list[tuple[float, float]]) -> list[tuple]:
    """(x, y, w, h, direction) of diagonal dark runs close to a line's end; of runs that overlap much the first counts."""
    height, width = dark.shape
    least, out = max(4, round(min(height, width) * 0.015)), []
    for flip, names in ((False, "down_right"), (True, "down_left")):
        d = dark[:, ::-1] if flip else dark
        skew = np.zeros((height + width - 1, width), bool)  # a diagonal of d is a row of skew
        y, x = np.nonzero(d)
        skew[y - x + width - 1, x] = True
        for k, start, size in runs(skew).tolist():
            if size < least:
                continue
            x0, x1, top, bottom = start, start + size - 1, k - width + 1 + start, k - width + start + size
            left, right = (width - 1 - x1, width - 1 - x0) if flip else (x0, x1)
            b = (left / width, top / height, (right - left) / width, (bottom - top) / height)
            cx, cy = b[0] + b[2] / 2, b[1] + b[3] / 2
            if not any((cx - p) ** 2 + (cy - q) ** 2 < 0.08**2 for p, q in ends) or any(_overlap(b, o) > 0.5 for o in out):
                continue
            out.append((*b, names))
            if len(out) >= MOST_BOXES:
                return out
    return out


def _overlap(p, q) -> float:
    w, h = min(p[0] + p[2], q[0] + q[2]) - max(p[0], q[0]), min(p[1] + p[3], q[1] + q[3]) - max(p[1], q[1])
    i = max(0.0, w) * max(0.0, h)
    return i / u if (u := p[2] * p[3] + q[2] * q[3] - i) > 0 else 0.0


def raster_facts(image_id: str, raw: bytes | None, texts: list[dict] | None) -> list[dict]:
    """The facts of one image: size, masked pixels, lines, shapes, boxes and heads; text regions are blank for lines and heads. An image that can't be decoded gives 'undecoded'."""
    base = {c.name: None for c in FACTS} | {"image_id": image_id}
    values = grey(raw)
    if values is None:
        return [base | {"kind": "undecoded"}]
    height, width = values.shape
    dark = values <= DARK
    scan, masked, pad = dark.copy(), 0, max(1, round(min(width, height) * 0.004))
    for t in texts or []:
        if all(t.get(k) is not None for k in "xywh"):
            x0, y0 = max(0, round(t["x"] * width) - pad), max(0, round(t["y"] * height) - pad)
            x1, y1 = min(width, round((t["x"] + t["w"]) * width) + pad), min(height, round((t["y"] + t["h"]) * height) + pad)
            masked += int(scan[y0:y1, x0:x1].sum())
            scan[y0:y1, x0:x1] = False
    share = lambda b: (b[0] / width, b[1] / height, (b[2] - b[0]) / width, (b[3] - b[1]) / height)
    across = [share(b) for b in line_boxes(scan)]
    down = [share([t, l, b, r]) for l, t, r, b in line_boxes(scan.T)]
    ends = [e for x, y, w, h in across for e in ((x, y + h / 2), (x + w, y + h / 2))] + [e for x, y, w, h in down for e in ((x + w / 2, y), (x + w / 2, y + h))]
    row = lambda kind, n, b, direction=None, pixels=None: base | {"kind": kind, "n": n, "direction": direction, "pixels": pixels} | {k: round(v, 12) for k, v in zip("xywh", b)}
    out = [base | {"kind": "image", "w": float(width), "h": float(height), "pixels": masked}]
    out += [row("line", n, b, way) for n, (b, way) in enumerate([(b, "horizontal") for b in across] + [(b, "vertical") for b in down])]
    out += [row("shape", n, share(b), None, size) for n, (size, b) in enumerate(shapes(dark), 1)]
    out += [row("box", n, b) for n, b in enumerate(boxes_of(across, down), 1)]
    return out + [row("head", n, b[:4], b[4]) for n, b in enumerate(heads(scan, ends), 1)]


def detected(images: DataFrame) -> DataFrame:
    """FACTS of images (image_id, content, texts ARRAY<STRUCT<x, y, w, h>>)."""
    return _mapped(images.select("image_id", "content", "texts"), FACTS, lambda r: raster_facts(r["image_id"], r["content"], r["texts"]))


def _distance(px: Column, py: Column, b: str) -> Column:
    f = lambda k: F.col(f"{b}.{k}")
    dx, dy = F.greatest(f("x") - px, px - f("x") - f("w"), F.lit(0.0)), F.greatest(f("y") - py, py - f("y") - f("h"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def nodes(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, node_id, text, x, y, w, h): boxes with the text lines in or close to them, each line in the smallest such box; lines without a box; without any of these the boxes or else the shapes themselves.

    texts: (image_id, n, text, x, y, w, h), verified lines of a recogniser.
    """
    box = F.struct("x", "y", "w", "h")
    b = facts.where("kind = 'box'").select("image_id", F.concat(F.lit("box-"), "n").alias("node_id"), box.alias("b"))
    t = texts.select("image_id", F.col("n").alias("t_n"), F.col("text").alias("t_text"), box.alias("t"))
    off = _distance(F.col("t.x") + F.col("t.w") / 2, F.col("t.y") + F.col("t.h") / 2, "b")
    meet = (F.least(F.col("b.x") + F.col("b.w"), F.col("t.x") + F.col("t.w")) > F.greatest("b.x", "t.x")) & (F.least(F.col("b.y") + F.col("b.h"), F.col("t.y") + F.col("t.h")) > F.greatest("b.y", "t.y"))
    j = t.join(b, "image_id").where(meet | (off < 0.04))
    own = j.groupBy("image_id", "t_n", "t_text").agg(F.min_by(F.struct("node_id", "b"), F.struct(F.col("b.w") * F.col("b.h"), "b.y", "b.x", "node_id")).alias("m"))
    framed = own.groupBy("image_id", "m.node_id", "m.b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_n", "t_text"))), lambda x: x["t_text"]), " ").alias("text"))
    loose = t.join(own.select("image_id", "t_n"), ["image_id", "t_n"], "left_anti").select("image_id", F.concat(F.lit("text-"), "t_n").alias("node_id"), F.col("t").alias("b"), F.col("t_text").alias("text"))
    found = framed.unionByName(loose)
    bare = b.withColumn("text", F.lit("")).join(t.select("image_id").distinct(), "image_id", "left_anti")
    shaped = facts.where("kind = 'shape'").select("image_id", F.concat(F.lit("shape-"), "n").alias("node_id"), box.alias("b"), F.lit("").alias("text"))
    shaped = shaped.join(b.select("image_id").union(t.select("image_id")).distinct(), "image_id", "left_anti")
    return found.unionByName(bare).unionByName(shaped).select("image_id", "node_id", "text", "b.*")


def edges(facts: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, line, source, target, status): lines that aren't sides of boxes, with the nearest node within REACH of each end; partial with a head close to an end, else unverified; unresolved if an end has no node."""
    line = facts.where("kind = 'line'").select("image_id", F.col("n").alias("line"), F.struct("x", "y", "w", "h").alias("l"), (F.col("direction") == "horizontal").alias("flat"))
    box = facts.where("kind = 'box'").select("image_id", F.struct("x", "y", "w", "h").alias("b"))

    def side(p, s, q, r):
        edge = (F.abs(F.col(f"l.{q}") - F.col(f"b.{q}")) < 0.025) | (F.abs(F.col(f"l.{q}") - F.col(f"b.{q}") - F.col(f"b.{r}")) < 0.025)
        shared = F.least(F.col(f"l.{p}") + F.col(f"l.{s}"), F.col(f"b.{p}") + F.col(f"b.{s}")) - F.greatest(f"l.{p}", f"b.{p}")
        return edge & (shared >= 0.75 * F.least(f"l.{s}", f"b.{s}"))

    frame = line.join(box, "image_id").where(F.when(F.col("flat"), side("x", "w", "y", "h")).otherwise(side("y", "h", "x", "w"))).select("image_id", "line").distinct()
    free = line.join(frame, ["image_id", "line"], "left_anti")
    mid = lambda k, s: F.col(f"l.{k}") + F.col(f"l.{s}") / 2
    start = F.struct(F.when(F.col("flat"), F.col("l.x")).otherwise(mid("x", "w")).alias("px"), F.when(F.col("flat"), mid("y", "h")).otherwise(F.col("l.y")).alias("py"))
    end = F.struct(F.when(F.col("flat"), F.col("l.x") + F.col("l.w")).otherwise(mid("x", "w")).alias("px"), F.when(F.col("flat"), mid("y", "h")).otherwise(F.col("l.y") + F.col("l.h")).alias("py"))
    ends = free.select("image_id", "line", F.posexplode(F.array(start, end)).alias("side", "e"))
    n = found.select("image_id", "node_id", F.struct("x", "y", "w", "h").alias("b"))
    near = ends.join(n, "image_id").withColumn("d", _distance(F.col("e.px"), F.col("e.py"), "b")).where(F.col("d") <= REACH)
    near = near.groupBy("image_id", "line").agg(F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.struct("d", "node_id")))).alias("s"), F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.struct("d", "node_id")))).alias("t"))
    head = facts.where("kind = 'head'").select("image_id", F.col("x").alias("hx"), F.col("y").alias("hy"))
    pointed = ends.join(head, "image_id").where((F.col("hx") - F.col("e.px")) ** 2 + (F.col("hy") - F.col("e.py")) ** 2 < 0.12**2).select("image_id", "line").distinct().withColumn("pointed", F.lit(True))
    d = free.select("image_id", "line").join(near, ["image_id", "line"], "left").join(pointed, ["image_id", "line"], "left")
    source = F.get("s", F.lit(0))["node_id"]
    d = d.withColumn("source", source)
    target = F.get(F.filter("t", lambda x: F.col("source").isNull() | (x["node_id"] != F.col("source"))), F.lit(0))["node_id"]
    d = d.withColumn("target", target)
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    return d.select("image_id", "line", "source", "target", F.when(~whole, "unresolved").when(F.col("pointed"), "partial").otherwise("unverified").alias("status"))


def failure_classes(ocr_verified: Column, ocr_lines: Column, masked: Column, lines: Column, heads_: Column, nodes_: Column, edges_: Column, unresolved: Column) -> Column:
    """ARRAY<STRING> of the stages that failed for an image, in the order of FAILURES."""
    tests = (
        ~ocr_verified, ocr_verified & (ocr_lines > 0) & (masked == 0), lines == 0, heads_ == 0, (unresolved > 0) | ((lines > 0) & (edges_ == 0)), (nodes_ == 0) | (edges_ == 0),
    )
    return F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, FAILURES)]))


def summaries(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, n_lines, n_shapes, n_boxes, n_heads, n_nodes, n_edges, n_unresolved, failures): what each decoded image gave."""
    found = nodes(facts, texts)
    e = edges(facts, found)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    g = facts.where("kind <> 'undecoded'").groupBy("image_id").agg(count("line").alias("n_lines"), count("shape").alias("n_shapes"), count("box").alias("n_boxes"), count("head").alias("n_heads"), F.max(F.when(F.col("kind") == "image", F.col("pixels"))).alias("masked"))
    n = found.groupBy("image_id").agg(F.count("*").alias("n_nodes"))
    k = e.groupBy("image_id").agg(F.count_if(F.col("status") != "unresolved").alias("n_edges"), F.count_if(F.col("status") == "unresolved").alias("n_unresolved"))
    o = texts.groupBy("image_id").agg(F.count("*").alias("n_ocr"))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = g.join(n, "image_id", "left").join(k, "image_id", "left").join(o, "image_id", "left").withColumns({c: z(c) for c in ("n_nodes", "n_edges", "n_unresolved", "n_ocr")})
    f = failure_classes(F.col("n_ocr") > 0, F.col("n_ocr"), z("masked"), F.col("n_lines"), F.col("n_heads"), F.col("n_nodes"), F.col("n_edges"), F.col("n_unresolved"))
    return j.select("image_id", "n_lines", "n_shapes", "n_boxes", "n_heads", "n_nodes", "n_edges", "n_unresolved", f.alias("failures"))
