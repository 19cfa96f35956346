"""Text decoded with the wrong character encoding (problem 3).

A token is a run of ASCII letters and digits and of characters beyond ASCII,
with at least one of the latter. ASCII is the same in all encodings involved, so
decoding a text wrongly decodes each of its tokens wrongly, and nothing else.

1. The distinct tokens of the corpus are collected. A token is clean if no chain
   turns it back into another plausible text.
2. The table of garbled forms: every clean token is written out under every
   encoding chain, and so is every character of a clean token or of a small
   alphabet.
3. The table is hash-joined with the corpus tokens. A match is a garbled token
   with its original. Tokens whose original the corpus lacks in clean form are
   looked up piece by piece: they match if they are made of the garbled forms of
   these characters, all of one chain.
4. Records with a matched token are affected.

A token with the replacement character is affected in any case; its original is
restored where the table knows just one word for it.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import small_side
from ..functions.lineage import cut

#: Chains by which UTF-8 bytes were read as single-byte text, once or twice. Codec names.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866")
READ_TWICE = (("cp1252", "cp1252"), ("latin-1", "latin-1"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("mac_roman", "mac_roman"), ("cp437", "cp437"), ("cp850", "cp850"))
#: Chains by which one single-byte encoding was read as another: (written, read).
CONFUSED = (("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8_r", "cp1252"), ("koi8_r", "latin-1"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"))
#: Single-byte text read as UTF-8, undecodable bytes replaced: (written,).
REPLACED = ("cp1252", "cp1251", "mac_roman", "cp850")
LOST = "�"
#: Splits a text into tokens: the ASCII characters other than letters and digits.
BORDER = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Blocks whose letters and signs a proposed original may hold.
_COMMON = ((0xA1, 0x17F), (0x386, 0x3CE), (0x401, 0x45F), (0x900, 0xE7F), (0x2010, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x22FF), (0x2500, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F300, 0x1FAFF))

#: Latin letters and signs, dashes, quotes and currency signs, garbled too whether or not a clean word has them.
_ALPHABET = ((0xA1, 0x17F), (0x2010, 0x203A), (0x20A0, 0x20BF))


@functools.cache
def _tables(codec: str) -> tuple[dict[int, int], dict[int, int]]:
    """Byte value to character and back; a byte without a character stands for the control character of its number."""
    there = {}
    for b in range(0x80, 0x100):
        try:
            there[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            there[b] = b
    return there, {c: b for b, c in there.items()}


def _bytes_as_text(word: str, codec: str) -> str | None:
    """``word`` in ``codec``, each byte as the character of its number; None if the codec lacks a character."""
    back = _tables(codec)[1]
    try:
        return "".join(ch if ch < "\x80" else chr(back[ord(ch)]) for ch in word)
    except KeyError:
        return None


def read_as(word: str, codec: str) -> str:
    """``word`` written as UTF-8 and read as ``codec``."""
    return word.encode().decode("latin-1").translate(_tables(codec)[0])


def unread(word: str, codec: str) -> str | None:
    """The text that, written as UTF-8, reads as ``word`` in ``codec``; None if there is none."""
    raw = _bytes_as_text(word, codec)
    try:
        return None if raw is None else raw.encode("latin-1").decode()
    except UnicodeDecodeError:
        return None


def garbled(word: str) -> dict[str, str]:
    """Every garbled form of a clean word, with the chain that makes it."""
    out: dict[str, str] = {}
    put = lambda form, chain: form != word and out.setdefault(form, chain)
    for c in READ_AS:
        put(read_as(word, c), f"utf-8>{c}")
    for a, b in READ_TWICE:
        put(read_as(read_as(word, a), b), f"utf-8>{a}>utf-8>{b}")
    letters = [ch for ch in word if ch >= "\x80"]
    for a, b in CONFUSED:
        if a in ("cp1251", "koi8_r"):  # short runs of accented letters are words of other languages
            if len(word) < 3 or len(letters) < len(word) or not all("Ѐ" <= ch <= "џ" for ch in word):
                continue
        elif len(word) < 4 or len(letters) == len(word) or not all(ch.isalpha() for ch in letters):
            continue
        if (raw := _bytes_as_text(word, a)) is not None:
            put(raw.translate(_tables(b)[0]), f"{a}>{b}")
    for a in REPLACED:
        if (raw := _bytes_as_text(word, a)) is not None and LOST in (form := raw.encode("latin-1").decode("utf-8", "replace")):
            put(form, f"{a}>utf-8")
    return out


def _plausible(original: str, seen: str) -> bool:
    if not all(ch < "\x80" or any(a <= ord(ch) <= b for a, b in _COMMON) for ch in original):
        return False
    # a Cyrillic letter and a blank, or a capital and a punctuation mark, can stand next to each other in clean text
    if len(original) == 1 and len(seen) == 2 and "Ѐ" <= seen[0] <= "џ":
        kind = unicodedata.category(seen[1])[0]
        return not (kind == "Z" or kind == "P" and seen[0] <= "Я")
    return True


def inverse(token: str) -> str | None:
    """An original of ``token`` whose garbled runs come back to it under one chain; None if there is none."""
    for chain in [(c,) for c in READ_AS] + [x[::-1] for x in READ_TWICE]:
        hit = False

        def run(m: re.Match) -> str:
            nonlocal hit
            text: str | None = m[0]
            for c in chain:
                text = unread(text, c)
                if text is None:
                    return m[0]
            back = text
            for c in reversed(chain):
                back = read_as(back, c)
            if text == m[0] or back != m[0] or not _plausible(text, m[0]):
                return m[0]
            hit = True
            return text

        out = _RUN.sub(run, token)
        if hit:
            deeper = inverse(out) if not out.isascii() else None
            return deeper or out
    return None


def tokens_of(text: Column) -> Column:
    """The distinct tokens with characters beyond ASCII of an array of text blocks."""
    joined = F.array_join(text, "\n")
    found = F.filter(F.array_distinct(F.split(joined, BORDER)), lambda t: F.length(t) < F.octet_length(t))
    return F.when(F.length(joined) < F.octet_length(joined), found)


_ENTRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("form", T.StringType()), T.StructField("original", T.StringType()), T.StructField("n", T.LongType())])
_MATCH = T.StructType([T.StructField("token", T.StringType()), T.StructField("original", T.StringType())])


def _entries(batches):
    """The table of garbled forms: for each clean token its forms under every chain ('word') and its characters ('char'), once a batch."""
    import pyarrow as pa

    for batch in batches:
        rows, chars = [], set()
        for token, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist()):
            if LOST not in token and inverse(token) is None:
                rows += [("word", form, token, n) for form in garbled(token)]
                chars.update(ch for ch in token if ch >= "\x80")
        rows += [("char", ch, ch, 0) for ch in sorted(chars)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["kind", "form", "original", "n"])


def piece_tables(chars: list[str]) -> list[dict[str, str]]:
    """For each chain that starts from UTF-8, the garbled form of every character of clean words and of the alphabet, doubled chains first."""
    out, chars = [], sorted({*chars, *(chr(c) for a, b in _ALPHABET for c in range(a, b + 1))})
    for chain in [*READ_TWICE, *[(c,) for c in READ_AS]]:
        out.append({functools.reduce(read_as, chain, ch): ch for ch in chars})
    return out


def pieced(token: str, tables: list[dict[str, str]]) -> str | None:
    """``token`` with its garbled runs replaced, if under one chain they are made of garbled forms of characters alone; else null.

    The forms of one chain are prefix-free, so a run has one reading at most.
    """
    for forms in tables:
        longest, hit = max(map(len, forms), default=0), False

        def run(m: re.Match) -> str:
            nonlocal hit
            seen, out, i = m[0], [], 0
            while i < len(seen):
                for size in range(2, longest + 1):
                    if (ch := forms.get(seen[i : i + size])) is not None and i + size <= len(seen):
                        out.append(ch)
                        i += size
                        break
                else:
                    return seen
            if not _plausible("".join(out), seen):
                return seen
            hit = True
            return "".join(out)

        text = _RUN.sub(run, token)
        if hit:
            return text if text.isascii() else pieced(text, tables) or text
    return None


def garbled_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, original): the garbled tokens of the corpus; original is null where it can't be told. Not cut.

    Garbling is spread over all tasks by token, however few bytes the distinct
    tokens have, and its table is written once. The characters of clean words go
    to every worker: their number is bounded by the character set.
    """
    spark = docs.sparkSession
    seen = cut(docs.select(F.explode(tokens_of(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = seen.repartition(tasks, "token")
    table = cut(spread.mapInArrow(_entries, _ENTRY))
    known = table.where("kind = 'word'").join(seen.select(F.col("token").alias("form")), "form")
    # of several originals the one seen most often; for replaced characters only a single one is a restoration
    best = known.groupBy("form").agg(F.max(F.struct("n", "original")).alias("b"), F.min("original").alias("least"), F.max("original").alias("most"))
    sure = ~F.contains(F.col("form"), F.lit(LOST)) | (F.col("least") == F.col("most"))
    matched = cut(best.select(F.col("form").alias("token"), F.when(sure, F.col("b.original")).alias("original")))
    chars = sorted(r[0] for r in table.where("kind = 'char'").select("form").distinct().collect())
    sent = spark.sparkContext.broadcast(chars)

    def pieces(batches):
        import pyarrow as pa

        tables = piece_tables(sent.value)
        for batch in batches:
            rows = [(t, o) for t in batch.column("token").to_pylist() if LOST not in t and (o := pieced(t, tables)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["token", "original"])

    rest = spread.select("token").join(matched, "token", "left_anti")
    lost = rest.where(F.contains(F.col("token"), F.lit(LOST))).select("token", F.lit(None).cast("string").alias("original"))
    return matched.unionByName(rest.mapInArrow(pieces, _MATCH)).unionByName(lost)


def affected(docs: DataFrame, key: str, text: str, bad: DataFrame) -> DataFrame:
    """(key) of the rows with a garbled token, each once. ``bad``: of ``garbled_tokens``, cut."""
    pairs = docs.select(key, F.explode(tokens_of(F.col(text))).alias("token"))
    return pairs.join(small_side(bad.select("token")), "token", "left_semi").select(key).distinct()


def _substituted(block: str | None, originals: dict[str, str]) -> str | None:
    return block and _TOKEN.sub(lambda m: originals.get(m[0]) or m[0], block)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _restored(texts, pairs):
    import pyarrow as pa

    out = []
    for blocks, known in zip(texts.to_pylist(), pairs.to_pylist()):
        m = {x["token"]: x["original"] for x in known if x["original"]}
        out.append(None if blocks is None else [_substituted(b, m) for b in blocks])
    return pa.array(out, pa.list_(pa.string()))


def restored(docs: DataFrame, key: str, text: str, bad: DataFrame) -> DataFrame:
    """(key, text, n_unresolved): the affected rows, once each, with originals in place of garbled tokens."""
    pairs = docs.select(key, F.explode(tokens_of(F.col(text))).alias("token")).join(small_side(bad), "token").distinct()
    known = pairs.groupBy(key).agg(F.collect_list(F.struct("token", "original")).alias("__known"))
    rows = docs.select(key, text).distinct().join(small_side(known), key)
    unresolved = F.size(F.filter("__known", lambda x: x["original"].isNull()))
    return rows.select(key, _restored(F.col(text), F.col("__known")).alias(text), unresolved.alias("n_unresolved"))
