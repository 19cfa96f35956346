import struct
import zlib

import numpy as np

from deckmill.sources import rasters as r


def png(a, filters=(0,), kind=0, palette=None):
    """A PNG of an array, its rows stored with the filters in turn."""
    rows, h, w = [], a.shape[0], a.shape[1]
    step = 1 if a.ndim == 2 else a.shape[2]
    flat = a.reshape(h, -1).astype(int)
    for i in range(h):
        f = filters[i % len(filters)]
        row, up = flat[i], flat[i - 1] if i else np.zeros_like(flat[0])
        left, corner = np.r_[np.zeros(step, int), row[:-step]], np.r_[np.zeros(step, int), up[:-step]]
        paeth = np.array([min((x, y, z), key=lambda v: abs(x + y - z - v)) for x, y, z in zip(left.tolist(), up.tolist(), corner.tolist())])
        rows.append(bytes([f]) + ((row - (0, left, up, (left + up) // 2, paeth)[f]) % 256).astype(np.uint8).tobytes())
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_decoding_of_all_filters_and_kinds():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (20, 30), np.uint8)
    assert (r.grey(png(a, (0, 1, 2, 3, 4))) == a).all()
    c = np.repeat(a[:, :, None], 3, axis=2)
    assert (r.grey(png(c, (1, 2, 3, 4), 2)) == a).all() and (r.grey(png(np.dstack([c, a]), (4, 1), 6)) == a).all()
    assert (r.grey(png(a % 2, (0,), 3, bytes([0, 0, 0, 255, 255, 255]))) == (a % 2) * 255).all()
    assert max(r.grey(png(np.zeros((1000, 100), np.uint8))).shape) == 512
    assert all(r.grey(x) is None for x in (None, b"", b"\x89PNG\r\n\x1a\n", png(a)[:60], b"GIF89a"))


def picture():
    """Two boxes, a line from one to the other, and an arrow head at its end."""
    a = np.full((200, 400), 255, np.uint8)
    for x in (20, 280):
        a[60:62, x : x + 100] = a[138:140, x : x + 100] = 0
        a[60:140, x : x + 2] = a[60:140, x + 98 : x + 100] = 0
    a[99:101, 122:276] = 0
    for i in range(9):
        a[92 + i, 266 + i] = a[108 - i, 266 + i] = 0
    return a


def test_facts_and_graph(spark):
    images = spark.createDataFrame([("i", png(picture()), [(0.1, 0.45, 0.1, 0.1)]), ("j", b"no image", None), ("k", png(np.full((50, 50), 255, np.uint8)), [])], "image_id string, content binary, texts array<struct<x:double,y:double,w:double,h:double>>")
    f = r.detected(images).cache()
    assert [x.image_id for x in f.where("kind = 'undecoded'").collect()] == ["j"]
    i = f.where("image_id = 'i'")
    boxes = [(x.x, x.y) for x in i.where("kind = 'box'").orderBy("n").collect()]
    assert boxes == [(0.05, 0.3), (0.7, 0.3)] and i.where("kind = 'line'").count() == 9 and i.where("kind = 'shape'").count() == 3
    assert {x.direction for x in i.where("kind = 'head'").collect()} == {"down_right", "down_left"}
    texts = spark.createDataFrame([("i", 1, "Start", 0.1, 0.45, 0.1, 0.1), ("i", 2, "End", 0.75, 0.45, 0.1, 0.1), ("i", 3, "alone", 0.4, 0.0, 0.1, 0.05)], "image_id string, n int, text string, x double, y double, w double, h double")
    n = {x.node_id: x.text for x in r.nodes(f, texts).collect()}
    assert n == {"box-1": "Start", "box-2": "End", "text-3": "alone"}
    e = [(x.source, x.target, x.status) for x in r.edges(f, r.nodes(f, texts)).collect()]
    assert e == [("box-1", "box-2", "partial")]
    s = {x.image_id: x for x in r.summaries(f, texts).collect()}
    assert (s["i"].n_nodes, s["i"].n_edges, s["i"].n_unresolved) == (3, 1, 0) and s["i"].failures == ["text_mask_failure"]
    assert s["k"].failures == ["ocr_failure", "line_detection_failure", "arrowhead_failure", "graph_assembly_failure"]


def test_masks_and_shapes():
    a = picture()
    facts = r.raster_facts("x", png(a), [{"x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}])
    assert not [f for f in facts if f["kind"] in ("line", "head", "box")] and next(f["pixels"] for f in facts if f["kind"] == "image") == int((a <= 200).sum())
    u = np.zeros((9, 9), bool)
    u[0:8, 1] = u[0:8, 6] = u[7, 1:7] = True  # one region, joined at its foot
    assert r.shapes(u) == [(20, [1, 0, 7, 8])]
