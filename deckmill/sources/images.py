"""Formats and sizes of images, from their header bytes."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("alpha", T.BooleanType())])
#: Fixed value: JPEG markers of a frame, and those without a length.
_FRAME = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_BARE = frozenset((0x01, 0xD8, 0xD9, *range(0xD0, 0xD8)))
_SVG = re.compile(rb"<svg\b([^>]*)>", re.IGNORECASE | re.DOTALL)


def _at(form: str, raw: bytes, where: int):
    """Values of a struct at an offset, or None beyond the end."""
    return struct.unpack_from(form, raw, where) if len(raw) >= where + struct.calcsize(form) else None


def _jpeg(raw: bytes):
    """Walks the segments up to the first frame."""
    where = 2
    while head := _at(">BBH", raw, where):
        fill, marker, length = head
        if fill != 0xFF or marker == 0xFF or marker in _BARE:
            where += 1 if fill != 0xFF or marker == 0xFF else 2
        elif marker in _FRAME:
            size = _at(">HH", raw, where + 5)
            return size and (size[1], size[0], False)
        elif length < 2:
            return None
        else:
            where += 2 + length
    return None


def _webp(raw: bytes):
    kind = raw[12:16]
    if kind == b"VP8X" and len(raw) >= 30:
        return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little"), bool(raw[20] & 16)
    if kind == b"VP8L" and (bits := _at("<I", raw, 21)):
        return 1 + bits[0] % 16384, 1 + bits[0] // 16384 % 16384, True
    if kind == b"VP8 " and raw[23:26] == b"\x9d\x01\x2a" and (size := _at("<HH", raw, 26)):
        return size[0] % 16384, size[1] % 16384, False
    return None


def _svg(raw: bytes):
    """The view box, else width and height in pixels or without a unit."""
    if not (m := _SVG.search(raw)):
        return None
    given = {k.decode().lower(): v.decode("utf-8", "replace") for k, _, v in re.findall(rb"([\w:-]+)\s*=\s*([\"'])(.*?)\2", m[1], re.DOTALL)}
    try:
        box = [float(x) for x in re.split(r"[\s,]+", given.get("viewbox", "").strip()) if x]
        if len(box) == 4 and box[2] and box[3]:
            return box[2], box[3], None
        return float(given["width"].removesuffix("px")), float(given["height"].removesuffix("px")), None
    except (KeyError, ValueError):
        return None


def header(raw: bytes | None) -> dict | None:
    """Format, size and whether the image has an alpha channel (null if the header can't tell); None for anything else and for broken headers."""
    if not raw:
        return None
    found = name = None
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR" and (v := _at(">IIBB", raw, 16)):
        name, found = "png", (v[0], v[1], v[3] in (4, 6))
    elif raw[:6] in (b"GIF87a", b"GIF89a") and (v := _at("<HH", raw, 6)):
        name, found = "gif", (*v, raw[:6] == b"GIF89a" and b"\x21\xf9\x04" in raw)
    elif raw[:2] == b"BM" and (v := _at("<ii2xH", raw, 18)):
        name, found = "bmp", (abs(v[0]), abs(v[1]), v[2] == 32)
    elif raw[:2] == b"\xff\xd8":
        name, found = "jpeg", _jpeg(raw)
    elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        name, found = "webp", _webp(raw)
    elif b"<svg" in raw[:512].lower():
        name, found = "svg", _svg(raw)
    return found and {"format": name, "width": float(found[0]), "height": float(found[1]), "alpha": found[2]}


@F.arrow_udf(HEADER)
def _header_udf(a):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([header(x) for x in a.to_pylist()], to_arrow_type(HEADER))


def image_header(content: Column) -> Column:
    """STRUCT<format, width, height, alpha> of an image's bytes; null for others."""
    return _header_udf(content)


def aspect_ratios(box_w: Column, box_h: Column, slide_aspect: Column, image: Column, crop: Column | None = None) -> Column:
    """STRUCT<shown, source, cropped, delta>: an image's ratio on the slide, in its file, in the file after cropping (ARRAY l, t, r, b of shares), and how far shown and cropped differ; null where unknown."""
    shown = F.try_divide(box_w * slide_aspect, box_h)
    source = F.try_divide(image["width"], image["height"])
    share = lambda a, b: 1.0 - F.coalesce(F.get(crop, F.lit(a)), F.lit(0.0)) - F.coalesce(F.get(crop, F.lit(b)), F.lit(0.0))
    cropped = source if crop is None else F.try_divide(source * share(0, 2), share(1, 3))
    r = lambda c, name: F.round(c, 6).alias(name)
    return F.struct(r(shown, "shown"), r(source, "source"), r(cropped, "cropped"), r(F.abs(shown - cropped), "delta"))
