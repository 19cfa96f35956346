"""Slide packages (ZIP with XML parts) as tables.

A package is read once, in the task that holds its bytes: ``read_packages`` gives
one row per part. The tables below it (relationships, slides, objects, media)
are DataFrame operations over parts, with XML parsed in Arrow batches. A package
that can't be read gives one row with its error, never a failed job.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: File suffixes, first bytes, and relationship kinds that make a part an asset.
SUFFIXES = (".pdf", ".pptx", ".ppt")
MAGIC = {"pdf": b"%PDF-", "pptx": b"PK"}
ASSET_KINDS = ("image", "oleObject", "media", "video", "audio", "package")
_CONTROL = re.compile(r"[\x00-\x1f\x7f\\]")


def discover(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """(path, format, length, content) of the supported files; files of other kinds in a folder are left out, each path comes once, in order of its folded name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    low = F.lower("path")
    df = df.where(low.rlike("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$")).dropDuplicates(["path"])
    return df.select("path", file_format(F.col("content")).alias("format"), "length", "content").orderBy(low, "path")


def file_format(content: Column) -> Column:
    """'pdf' or 'pptx' by the first bytes, whatever the suffix; null for anything else."""
    return F.when(F.substring(content, 1, 5) == F.lit(MAGIC["pdf"]), "pdf").when(F.substring(content, 1, 2) == F.lit(MAGIC["pptx"]), "pptx")


def safe_part(name: str) -> bool:
    """Whether a member's name stays inside the package."""
    return bool(name) and not _CONTROL.search(name) and not name.startswith("/") and ":" not in name.split("/")[0] and all(x not in ("", ".", "..") for x in name.rstrip("/").split("/"))


PARTS = T.StructType([
    T.StructField("deck_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("part", T.StringType()), T.StructField("size", T.LongType()), T.StructField("compressed_size", T.LongType()), T.StructField("crc32", T.StringType()),
    T.StructField("sha256", T.StringType()), T.StructField("is_xml", T.BooleanType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType()),
])


def package_parts(path: str, content: bytes, largest: int = 512 << 20) -> list[dict]:
    """The parts of one package, or one row with the reason why it can't be read."""
    base = {"deck_id": hashlib.sha256(content).hexdigest(), "path": path}
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        members = [m for m in z.infolist() if not m.is_dir()]
        names = [m.filename for m in members]
        if bad := [n for n in names if not safe_part(n)]:
            raise ValueError(f"unsafe member name {bad[0]!r}")
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("duplicate members")
        if sum(m.file_size for m in members) > largest:
            raise ValueError("too large when unpacked")
        rows = []
        for m in members:
            raw = z.read(m)
            rows.append(base | {"part": m.filename, "size": len(raw), "compressed_size": m.compress_size, "crc32": f"{m.CRC:08x}", "sha256": hashlib.sha256(raw).hexdigest(), "is_xml": m.filename.lower().endswith((".xml", ".rels")), "content": raw})
        return rows
    except Exception as e:
        return [base | {"error": f"{type(e).__name__}: {e}"}]


def _mapped(df: DataFrame, schema: T.StructType, rows_of) -> DataFrame:
    """``rows_of(row)`` gives the output rows of one input row, as dicts; a row's rows stay together in one batch."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for row in batch.to_pylist():
                if out := rows_of(row):
                    yield pa.RecordBatch.from_pylist(out, target)

    return df.mapInArrow(run, schema)


def read_packages(files: DataFrame) -> DataFrame:
    """Parts of the files (path, content) that are packages."""
    return _mapped(files.where(file_format(F.col("content")) == "pptx").select("path", "content"), PARTS, lambda r: package_parts(r["path"], r["content"]))


def parse_xml(raw: bytes) -> ElementTree.Element | None:
    """The root of an XML part; None for one that is malformed, or that declares a document type or entities."""
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        return None
    try:
        return ElementTree.fromstring(raw)
    except (ElementTree.ParseError, ValueError):
        return None


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


_TYPES = T.StructType([T.StructField("deck_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("n", T.IntegerType())])


def content_types(parts: DataFrame) -> DataFrame:
    """(deck_id, part, content_type): by the part's override, else its suffix's default, else a stream of bytes; the first of several wins."""

    def rows(r):
        root = parse_xml(r["content"])
        out = []
        for i, e in enumerate(root if root is not None else ()):
            if local(e) in ("Override", "Default"):
                key = attribute(e, "PartName") or attribute(e, "Extension") or ""
                out.append({"deck_id": r["deck_id"], "kind": local(e), "key": key.lstrip("/") if local(e) == "Override" else key.lower(), "content_type": attribute(e, "ContentType"), "n": i})
        return out

    t = _mapped(parts.where("part = '[Content_Types].xml'").select("deck_id", "content"), _TYPES, rows)
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("deck_id", "kind", "key").orderBy("n"))).where("k = 1")
    over = t.where("kind = 'Override'").select("deck_id", F.col("key").alias("part"), F.col("content_type").alias("o"))
    default = t.where("kind = 'Default'").select("deck_id", F.col("key").alias("ext"), F.col("content_type").alias("d"))
    p = parts.where("part is not null").select("deck_id", "part", F.lower(F.substring_index("part", ".", -1)).alias("ext"))
    return p.join(over, ["deck_id", "part"], "left").join(default, ["deck_id", "ext"], "left").select("deck_id", "part", F.coalesce("o", "d", F.lit("application/octet-stream")).alias("content_type"))


RELATIONSHIPS = T.StructType([T.StructField(c, T.StringType()) for c in ("deck_id", "source_part", "rel_id", "type", "target", "mode", "resolved_target")])


def resolved(source: str, target: str, mode: str | None) -> str | None:
    """The part that a relationship points at; None if it leaves the package."""
    if (mode or "").lower() == "external" or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return None
    path = unquote(target.split("#")[0])
    full = posixpath.normpath(path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(source), path))
    return full if safe_part(full) else None


def relationships(parts: DataFrame) -> DataFrame:
    """(deck_id, source_part, rel_id, type, target, mode, resolved_target) of every relationship part."""

    def rows(r):
        root = parse_xml(r["content"])
        folder, _, name = r["part"].rpartition("_rels/")
        source, out = folder + name.removesuffix(".rels"), []
        for e in root if root is not None else ():
            if local(e) == "Relationship":
                target, mode = attribute(e, "Target") or "", attribute(e, "TargetMode") or "Internal"
                out.append({"deck_id": r["deck_id"], "source_part": source, "rel_id": attribute(e, "Id"), "type": (attribute(e, "Type") or "").rpartition("/")[2], "target": target, "mode": mode, "resolved_target": resolved(source, target, mode)})
        return out

    return _mapped(parts.where(F.col("part").rlike(r"(^|/)_rels/[^/]*\.rels$")).select("deck_id", "part", "content"), RELATIONSHIPS, rows)


def dangling(rels: DataFrame, parts: DataFrame) -> DataFrame:
    """Relationships to parts that the package lacks."""
    p = parts.where("part is not null").select("deck_id", F.col("part").alias("resolved_target"))
    return rels.where("resolved_target is not null").join(p, ["deck_id", "resolved_target"], "left_anti")


def media(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """(deck_id, asset_id, asset_type, part, size, sha256): media and embedded parts and targets of asset relationships, numbered by part name."""
    targets = rels.where(F.col("type").isin(*ASSET_KINDS) & F.col("resolved_target").isNotNull()).select("deck_id", F.col("resolved_target").alias("part")).distinct().withColumn("t", F.lit(True))
    p = parts.where("part is not null").select("deck_id", "part", "size", "sha256").join(targets, ["deck_id", "part"], "left")
    p = p.where(F.col("t") | F.col("part").rlike("(^|/)(media|embeddings)/"))
    n = F.row_number().over(Window.partitionBy("deck_id").orderBy("part"))
    kind = F.when(F.col("part").rlike("(^|/)embeddings/"), "embedded").otherwise("media")
    return p.select("deck_id", F.format_string("asset-%04d", n).alias("asset_id"), kind.alias("asset_type"), "part", "size", "sha256")


_ORDER = T.StructType([T.StructField("deck_id", T.StringType()), T.StructField("rel_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def slide_order(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """(deck_id, slide_number, part, width, height): slides in the order of the presentation; of a part listed twice the first counts.

    The presentation is the part that the package's own relationships name, else
    the usual one. A package whose presentation lists no slides has its slide
    parts in the order of their numbers, without a size.
    """
    main = rels.where("source_part = '' and type = 'officeDocument' and resolved_target is not null").groupBy("deck_id").agg(F.min("resolved_target").alias("main"))
    named = parts.select("deck_id").distinct().join(main, "deck_id", "left").select("deck_id", F.coalesce("main", F.lit("ppt/presentation.xml")).alias("main"))

    def rows(r):
        root = parse_xml(r["content"])
        if root is None:
            return []
        size = next((e for e in root.iter() if local(e) == "sldSz"), None)
        dims = [int(attribute(size, k) or 0) if size is not None else 0 for k in ("cx", "cy")]
        ids = [e for e in root.iter() if local(e) == "sldId"]
        return [{"deck_id": r["deck_id"], "rel_id": next((v for k, v in e.attrib.items() if k.endswith("}id")), None), "n": i, "width": dims[0], "height": dims[1]} for i, e in enumerate(ids)]

    o = _mapped(parts.join(named.withColumnRenamed("main", "part"), ["deck_id", "part"]).select("deck_id", "content"), _ORDER, rows)
    links = rels.where("type = 'slide'").join(named.withColumnRenamed("main", "source_part"), ["deck_id", "source_part"])
    j = o.join(links.select("deck_id", "rel_id", F.col("resolved_target").alias("part")), ["deck_id", "rel_id"])
    j = j.groupBy("deck_id", "part").agg(F.min("n").alias("n"), F.max("width").alias("width"), F.max("height").alias("height"))
    number = F.regexp_extract("part", r"slide(\d+)\.xml$", 1).cast("int")
    loose = parts.where(F.col("part").rlike(r"^ppt/slides/slide\d+\.xml$")).join(j.select("deck_id").distinct(), "deck_id", "left_anti")
    j = j.unionByName(loose.select("deck_id", "part", number.alias("n"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")))
    return j.select("deck_id", F.row_number().over(Window.partitionBy("deck_id").orderBy("n")).alias("slide_number"), "part", "width", "height")


OBJECTS = T.StructType([
    T.StructField("deck_id", T.StringType()), T.StructField("slide_number", T.IntegerType()), T.StructField("object_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("native_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("shape_type", T.StringType()), T.StructField("placeholder", T.StringType()), T.StructField("z_order", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("w", T.DoubleType()), T.StructField("h", T.DoubleType()), T.StructField("rotation", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("rel_ids", T.ArrayType(T.StringType())),
    T.StructField("from_id", T.StringType()), T.StructField("to_id", T.StringType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
    T.StructField("flip_h", T.BooleanType()), T.StructField("flip_v", T.BooleanType()), T.StructField("crop", T.ArrayType(T.DoubleType())), T.StructField("font_sizes", T.ArrayType(T.DoubleType())), T.StructField("font_family", T.StringType()),
    T.StructField("colors", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("color", T.StringType())]))), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
])
_KIND = {"sp": "shape", "pic": "image", "cxnSp": "connector", "grpSp": "group", "graphicFrame": "frame"}


def paragraphs(e: ElementTree.Element) -> str:
    """Text of an element: paragraphs on lines, breaks and tabs kept."""
    out = []
    for p in (x for x in e.iter() if local(x) == "p"):
        out.append("".join(x.text or "" if local(x) == "t" else "\n" if local(x) == "br" else "\t" if local(x) == "tab" else "" for x in p.iter()))
    return "\n".join(out).strip("\n")


def _child(e, *path):
    for name in path:
        e = next((c for c in e if local(c) == name), None) if e is not None else None
    return e


def _frame(e: ElementTree.Element) -> tuple | None:
    """(off, ext, child off, child ext, rotation, flips) of an element's transform."""
    places = (_child(e, "spPr", "xfrm"), _child(e, "grpSpPr", "xfrm"), _child(e, "xfrm"))
    xfrm = next((x for x in places if x is not None), None)
    if xfrm is None:
        return None
    pair = lambda name, a, b: (float(attribute(c, a) or 0), float(attribute(c, b) or 0)) if (c := _child(xfrm, name)) is not None else None
    off, ext = pair("off", "x", "y"), pair("ext", "cx", "cy")
    return None if off is None or ext is None else (off, ext, pair("chOff", "x", "y") or off, pair("chExt", "cx", "cy") or ext, float(attribute(xfrm, "rot") or 0) / 60000)


def color_of(fill: ElementTree.Element | None) -> str | None:
    """'#RRGGBB' of a solid fill, 'scheme:<name>' of one that the theme resolves, None for others."""
    for e in fill.iter() if fill is not None else ():
        if local(e) == "srgbClr" and attribute(e, "val"):
            return "#" + attribute(e, "val").upper()
        if local(e) == "sysClr" and attribute(e, "lastClr"):
            return "#" + attribute(e, "lastClr").upper()
        if local(e) == "schemeClr" and attribute(e, "val"):
            return "scheme:" + attribute(e, "val")
    return None


def _style(e: ElementTree.Element, kind: str) -> dict:
    """Flips, crop, fonts, colours, link relationships and table cells of an element as its own XML gives them."""
    places = (_child(e, "spPr", "xfrm"), _child(e, "grpSpPr", "xfrm"), _child(e, "xfrm"))
    xfrm = next((x for x in places if x is not None), None)
    flag = lambda name: xfrm is not None and (attribute(xfrm, name) or "0").lower() in ("1", "true")
    out = {"flip_h": flag("flipH"), "flip_v": flag("flipV"), "crop": None, "font_sizes": None, "font_family": None, "colors": None, "links": None, "cells": None}
    if kind == "grpSp":
        return out
    crop = next((x for x in e.iter() if local(x) == "srcRect"), None)
    runs = [r for r in e.iter() if local(r) == "rPr"]
    colors = [("fill", color_of(_child(e, "spPr", "solidFill"))), ("line", color_of(_child(e, "spPr", "ln", "solidFill"))), *(("font", color_of(_child(r, "solidFill"))) for r in runs)]
    table = next((x for x in e.iter() if local(x) == "tbl"), None)
    return out | {
        "crop": [int(attribute(crop, k) or 0) / 100_000 for k in "ltrb"] if crop is not None else None,
        "font_sizes": [int(attribute(r, "sz")) / 100 for r in runs if (attribute(r, "sz") or "").isdigit()],
        "font_family": next((attribute(x, "typeface") for r in runs for x in r if local(x) == "latin"), None),
        "colors": [{"role": k, "color": v} for k, v in colors if v],
        "links": sorted({attribute(x, "id") for x in e.iter() if local(x) in ("hlinkClick", "hlinkHover") and attribute(x, "id")}),
        "cells": [[paragraphs(c) for c in row if local(c) == "tc"] for row in table if local(row) == "tr"] if table is not None else None,
    }


def slide_objects(deck: str, number: int, raw: bytes, width: int, height: int) -> list[dict]:
    """The objects of a slide in drawing order, groups before their members; boxes are shares of the slide.

    Of alternate contents the first choice is taken. A group's scaling and offset carry over to its members.
    """
    root = parse_xml(raw)
    tree = next((e for e in root.iter() if local(e) == "spTree"), None) if root is not None else None
    out: list[dict] = []

    def walk(parent, parent_id, sx, sy, tx, ty):
        for e in parent:
            kind = local(e)
            if kind == "AlternateContent":
                picks = [x for x in (_child(e, "Choice"), _child(e, "Fallback")) if x is not None]
                walk(picks[0] if picks else (), parent_id, sx, sy, tx, ty)
                continue
            if kind not in _KIND:
                continue
            oid, props = f"slide-{number:02d}-object-{len(out) + 1:04d}", next((x for x in e.iter() if local(x) == "cNvPr"), None)
            f, text = _frame(e), paragraphs(_child(e, "txBody")) if _child(e, "txBody") is not None else ""
            kinds = {local(x) for x in e.iter()}
            typ = _KIND[kind]
            if kind == "sp" and text.strip():
                typ = "text"
            if kind == "graphicFrame":
                typ = "table" if "tbl" in kinds else "chart" if "chart" in kinds else "smartart" if "relIds" in kinds else "frame"
                text = paragraphs(e)
            ph, geom, line = next((x for x in e.iter() if local(x) == "ph"), None), next((x for x in e.iter() if local(x) == "prstGeom"), None), next((x for x in e.iter() if local(x) == "ln"), None)
            ends = {k: next((attribute(x, "id") for x in e.iter() if local(x) == n), None) if kind == "cxnSp" else None for k, n in (("from_id", "stCxn"), ("to_id", "endCxn"))}
            arrows = {k: attribute(c, "type") if line is not None and (c := _child(line, n)) is not None else None for k, n in (("head", "headEnd"), ("tail", "tailEnd"))}
            box = {k: None for k in "xywh"}
            if f and width and height:
                box = {"x": round((f[0][0] * sx + tx) / width, 12), "y": round((f[0][1] * sy + ty) / height, 12), "w": round(f[1][0] * sx / width, 12), "h": round(f[1][1] * sy / height, 12)}
            rels = sorted({v for x in (e.iter() if kind != "grpSp" else ()) for k, v in x.attrib.items() if k.startswith("{") and k.rpartition("}")[2] in ("embed", "link", "id", "dm") and "relationships" in k})
            out.append({"deck_id": deck, "slide_number": number, "object_id": oid, "parent_id": parent_id, "native_id": attribute(props, "id") if props is not None else None, "name": attribute(props, "name") if props is not None else None, "type": typ, "shape_type": attribute(geom, "prst") if geom is not None else None, "placeholder": (attribute(ph, "type") or "body") if ph is not None else None, "z_order": len(out) + 1, "rotation": f[4] if f else None, "text": text, "rel_ids": rels} | box | ends | arrows | _style(e, kind))
            if kind == "grpSp":
                if f and f[3][0] and f[3][1]:
                    gx, gy = f[1][0] / f[3][0], f[1][1] / f[3][1]
                    walk(e, oid, sx * gx, sy * gy, tx + sx * (f[0][0] - f[2][0] * gx), ty + sy * (f[0][1] - f[2][1] * gy))
                else:
                    walk(e, oid, sx, sy, tx, ty)

    if tree is not None:
        walk(tree, None, 1.0, 1.0, 0.0, 0.0)
    return out


def objects(parts: DataFrame, order: DataFrame) -> DataFrame:
    """Objects of every slide."""
    j = order.join(parts.select("deck_id", "part", "content"), ["deck_id", "part"])
    return _mapped(j.select("deck_id", "slide_number", "content", "width", "height"), OBJECTS, lambda r: slide_objects(r["deck_id"], r["slide_number"], r["content"], r["width"], r["height"]))


def slide_texts(objs: DataFrame) -> DataFrame:
    """(deck_id, slide_number, text ARRAY<STRING>): the texts of a slide's objects in drawing order."""
    t = objs.where("text <> ''").groupBy("deck_id", "slide_number").agg(F.array_sort(F.collect_list(F.struct("z_order", "text"))).alias("t"))
    return t.select("deck_id", "slide_number", F.col("t.text").alias("text"))


_COMMENTS = T.StructType([T.StructField(c, T.StringType()) for c in ("deck_id", "part", "author_id", "text")])


def comments(parts: DataFrame) -> DataFrame:
    """(deck_id, part, author_id, text) of the comment parts."""

    def rows(r):
        root = parse_xml(r["content"])
        out = []
        for e in root.iter() if root is not None else ():
            if local(e) == "cm":
                text = "".join(x.text or "" for x in e.iter() if local(x) in ("text", "t")).strip()
                out.append({"deck_id": r["deck_id"], "part": r["part"], "author_id": attribute(e, "authorId"), "text": text})
        return out

    return _mapped(parts.where(F.col("part").rlike(r"/comments/[^/]*\.xml$")).select("deck_id", "part", "content"), _COMMENTS, rows)
