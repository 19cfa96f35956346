"""One written form for texts that look the same (problem 1).

A longest-match transducer is compiled once per worker. Its mapping is derived
from the Unicode character data: presentation widths and forms, invisible
characters, kinds of blank, look-alike letters of other scripts, and accents as
the sequences of base and marks that make up each composed character. The
compiler refuses a mapping with conflicts (one key with two outputs, or an
output that would be rewritten again).

A text is read once, cluster by cluster: a cluster is a character with the marks
and invisible characters after it, and only clusters that hold a rewritable
character are looked at. A cluster's characters are expanded by the mapping, its
marks put into their canonical order, and the longest sequences composed.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters with the skeleton of a basic Latin letter of the same case in Unicode's table of confusable
#: characters, less those that upright type draws differently (Greek alpha or Cyrillic ghe, say).
LOOKALIKES = {
    # Greek
    "Ϳ": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "Ϝ": "F", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϻ": "M",
    # Cyrillic
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "Ѵ": "V", "ѵ": "v", "Ү": "Y", "һ": "h", "Ӏ": "I", "ӏ": "l", "ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "ԛ": "q", "Ԝ": "W", "ԝ": "w",
    # Armenian and Georgian
    "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ჿ": "o",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮙ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B", "ꮃ": "w", "ꮓ": "z", "ꮩ": "v", "ꮪ": "s", "ꮯ": "c",
    # Coptic
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
}

#: Sequences that are drawn like one character which has no canonical decomposition to them.
SEQUENCES = {"अा": "आ", "ाे": "ो", "ाै": "ौ", "एे": "ऐ", "आे": "ओ", "आै": "औ"}

#: Decomposition tags that only tell a presentation; <super>, <sub>, <circle>, <square> and <fraction> can be seen.
_PRESENTATION = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<vertical>", "<font>"}
#: <compat> characters whose expansion looks the same: ligatures, digraphs, roman numerals, the micro sign.
_COMPAT = [(0xB5, 0xB5), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB17)]
#: Planes and blocks with assigned characters that can need a rewrite.
_SCANNED = [(0x0, 0x323AF), (0xE0000, 0xE01EF)]
_RS = "\x1e"


def _expanded(ch: str) -> str:
    """``ch`` canonically decomposed, with its presentation forms expanded."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    tag, rest = (d.split(" ", 1) if d.startswith("<") else ("", d))
    cp = ord(ch)
    if tag and tag not in _PRESENTATION and not (tag == "<compat>" and any(a <= cp <= b for a, b in _COMPAT)):
        return ch
    return "".join(_expanded(chr(int(x, 16))) for x in rest.split())


def _invisible(ch: str) -> bool:
    cp = ord(ch)
    return (
        unicodedata.category(ch) == "Cf" and not 0x600 <= cp <= 0x605 and cp not in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)
        or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F
    )


def _single(ch: str) -> str:
    if _invisible(ch):
        return ""
    if ch == "\t" or ch == "\x0b" or unicodedata.category(ch) == "Zs":
        return " "
    if ch in "\x85\u2028\u2029\r":
        return "\n"
    return "".join(_single(x) if x != ch else LOOKALIKES.get(x, x) for x in _expanded(ch))


class Transducer:
    """Keys of one or more characters, longest first, as a character trie with outputs."""

    def __init__(self, mapping: dict[str, str]):
        self.root: dict = {}
        for key, out in mapping.items():
            node = self.root
            for ch in key:
                node = node.setdefault(ch, {})
            if node.get("", out) != out:
                raise ValueError(f"two outputs for {key!r}")
            node[""] = out

    def run(self, s: str) -> str:
        out, i, n, root = [], 0, len(s), self.root
        while i < n:
            node, j, best, end = root, i, None, i + 1
            while j < n and (node := node.get(s[j])) is not None:
                j += 1
                if "" in node:
                    best, end = node[""], j
            out.append(s[i] if best is None else best)
            i = end
        return "".join(out)


#: A joiner between two emoji is seen: the two are drawn as one.
_EMOJI = "\\U0001f000-\\U0001faff\\u2600-\\u27bf"
_JOINER = re.compile(f"(?<=[{_EMOJI}\\ufe0f])\\u200d(?=[{_EMOJI}])")


@functools.lru_cache(maxsize=1)
def compiled() -> tuple[dict[str, str], Transducer, re.Pattern, re.Pattern, re.Pattern]:
    """The expansion of each character, the checked transducer of compositions; what a text without characters beyond the basic plane must hold to be rewritten; the clusters of such a text, and of any.

    A class within the basic plane is a bitmap to the pattern engine, one beyond it a list that is scanned.
    """
    expand, compose, special, after = {}, {}, [], []
    for a, b in _SCANNED:
        for cp in range(a, min(b, sys.maxunicode) + 1):
            if 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF or 0xE000 <= cp <= 0xF8FF:
                continue
            ch = chr(cp)
            if (cat := unicodedata.category(ch)) == "Cn":
                continue
            parts = unicodedata.normalize("NFD", ch)
            if len(parts) > 1 and unicodedata.normalize("NFC", parts) == ch:
                compose[parts] = ch
            if 0xAC00 <= cp <= 0xD7A3:
                continue
            out = unicodedata.normalize("NFD", _single(ch))
            if out != ch:
                expand[ch] = out
            mark = not out or unicodedata.category(out[0])[0] == "M" or 0x1160 <= ord(out[0]) <= 0x11FF
            if unicodedata.normalize("NFC", out) != ch or cat[0] == "M" or mark:
                (after if mark else special).append(cp)
    for key, out in SEQUENCES.items():
        compose[unicodedata.normalize("NFD", key)] = out
        compose.setdefault(unicodedata.normalize("NFD", out), out)
    transducer = Transducer(compose)
    for key in (*expand, *compose):
        form = _cluster(key, expand, transducer)
        if _cluster(form, expand, transducer) != form:
            raise ValueError(f"the output of {key!r} isn't final: {form!r}")
    basic = lambda cps: [x for x in cps if x < 0x10000]
    clusters = lambda f: re.compile(f"[^{_class(f(after))}]?[{_class(f(after))}]+|[{_class(f(special))}]", re.DOTALL)
    return expand, transducer, re.compile(f"[{_class(sorted(basic(special + after)))}]"), clusters(basic), clusters(list)


def _ordered(s: str) -> str:
    """``s`` with each run of marks in canonical order."""
    out, run = [], []
    for ch in s:
        if unicodedata.combining(ch):
            run.append(ch)
        else:
            out += sorted(run, key=unicodedata.combining)
            out.append(ch)
            run = []
    return "".join(out + sorted(run, key=unicodedata.combining))


def _cluster(s: str, expand: dict[str, str], transducer: Transducer) -> str:
    parts = "".join(expand[ch] if ch in expand else unicodedata.normalize("NFD", ch) if "\uac00" <= ch <= "\ud7a3" else ch for ch in s)
    return transducer.run(_ordered(parts))


def _class(cps: list[int]) -> str:
    """The inside of a character class of the sorted ``cps``."""
    ranges: list[list[int]] = []
    for cp in cps:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in ranges)


@functools.lru_cache(maxsize=200_000)
def _segment(s: str) -> str:
    return _cluster(s, *compiled()[:2])


def visual_form(s: str | None) -> str | None:
    """``s`` in the one form shared by all texts that look like it; null stays null, empty stays empty."""
    if s is None or s.isascii() and "\t" not in s and "\r" not in s and "\x0b" not in s:
        return s
    if "\r" in s:
        s = s.replace("\r\n", "\n")
    if "\u200d" in s and _JOINER.search(s):
        return "\u200d".join(visual_form(x) for x in _JOINER.split(s))
    needed, basic, every = compiled()[2:]
    if s.isascii() or max(s) < "\U00010000":
        return basic.sub(lambda m: _segment(m[0]), s) if needed.search(s) else s
    return every.sub(lambda m: _segment(m[0]), s)


@F.arrow_udf(T.StringType())
def _form_udf(a):
    import pyarrow as pa

    return pa.array([visual_form(x) for x in a.to_pylist()], pa.string())


def form_column(col: Column) -> Column:
    """``visual_form`` of a string column; only texts with a character outside printable ASCII go to Python."""
    plain = ~col.rlike(r"[^\x20-\x7e\n\x1e]")
    return F.coalesce(_form_udf(F.when(~plain, col)), col)


def packed(col: Column) -> Column:
    """An array of strings as one string, element borders kept and told from any text; a null element reads as empty."""
    part = F.transform(col, lambda e: F.replace(F.coalesce(e, F.lit("")), F.lit(_RS), F.lit(_RS + _RS)))
    return F.concat(F.size(col).cast("string"), F.lit(_RS + "|"), F.array_join(part, _RS + "|"))


def forms(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, f1, f2, r1, r2): 128-bit keys of the visual form and of the characters as written; rows without text are left out."""
    d = df.select(F.col(key).alias("key"), text.alias("raw")).where(F.col("raw").isNotNull())
    d = d.withColumn("form", form_column(F.col("raw")))
    return d.select("key", F.xxhash64("form").alias("f1"), F.xxhash64(F.lit("f"), "form").alias("f2"), F.xxhash64("raw").alias("r1"), F.xxhash64(F.lit("f"), "raw").alias("r2"))


def look_alike_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (record_type, key_a, key_b) of different writings of one form.

    ``keyed``: record_type, key, f1, f2, r1, r2, already cut from its lineage.
    Only forms that some row had to be rewritten into can have two writings, so
    the rest leaves before any join. Rows are then paired writing by writing:
    copies of one writing never meet each other, and no join row is dropped.
    """
    f, r = ["record_type", "f1", "f2"], ["r1", "r2"]
    changed = keyed.where((F.col("f1") != F.col("r1")) | (F.col("f2") != F.col("r2"))).select(*f).distinct()
    rows = keyed.join(changed, f, "left_semi")
    writings = rows.select(*f, *r).distinct()
    b = writings.select(*f, F.col("r1").alias("s1"), F.col("r2").alias("s2"))
    pairs = writings.join(b, f).where((F.col("r1") < F.col("s1")) | (F.col("r1") == F.col("s1")) & (F.col("r2") < F.col("s2")))
    left = rows.select(*f, *r, F.col("key").alias("a"))
    right = rows.select(*f, F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("key").alias("b"))
    out = pairs.join(left, [*f, *r]).join(right, [*f, "s1", "s2"])
    return out.select("record_type", F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
