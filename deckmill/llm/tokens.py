"""Token ids of a public byte-level BPE tokenizer for a whole corpus (problem 7).

The words that the vocabulary holds as one piece (its frequent words) are
compiled into a minimal acyclic transducer: states with equal suffix languages
are shared, and the number of words passed over on the way gives a word's index
and so its id. It is written once by the driver, shipped as a file and
memory-mapped by every Python worker, which looks up the new words of a batch
together, one byte of all words per step. Words it doesn't hold are merged
exactly by rank. A worker keeps what it has resolved in a bounded table.
"""

from __future__ import annotations

import atexit
import base64
import functools
import os
import re
import shutil
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public tokenizers' files and the default rank file in it.
TOKENIZERS = os.environ.get("DECKMILL_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: how the text is split before merging, as published with the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces between white space: a coarser split, at whose borders PATTERN always splits too.
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python's two pattern engines don't both take for white space.
_ODD = re.compile("[\x1c-\x1f\x85᠎​]")
#: Entries of a worker's table of resolved pieces; beyond it the table starts anew.
TABLE = 300_000


def load_ranks(path: str | Path) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """A minimal acyclic automaton over bytes with an id for each word it accepts."""

    def __init__(self, arcs: np.ndarray, targets: np.ndarray, skipped: np.ndarray, final: np.ndarray, ids: np.ndarray):
        self.arcs, self.targets, self.skipped, self.final, self.ids = arcs, targets, skipped, final, ids

    @classmethod
    def compile(cls, words: dict[bytes, int]) -> Transducer:
        """Words are added in byte order; a finished suffix is replaced by an equal one seen before."""
        register: dict[tuple, int] = {}
        done: list[tuple] = []  # (final, ((byte, state), ...)) by state

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        last = b""
        order = sorted(words)
        for w in order:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            while len(path) > common + 1:
                state = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            for _ in w[common:]:
                path.append([False, []])
            path[-1][0] = True
            last = w
        while len(path) > 1:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        root = freeze(path[0])
        # words below each state, and words passed over by each arc; states are in order of completion, so targets come first
        below = np.zeros(len(done), np.int64)
        keys, targets, skipped = [], [], []
        for s, (fin, out) in enumerate(done):
            n = int(fin)
            for byte, t in out:
                keys.append(s << 8 | byte)
                targets.append(t)
                skipped.append(n)
                n += below[t]
            below[s] = n
        t = cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skipped, np.int32), np.array([f for f, _ in done], np.uint8), np.array([words[w] for w in order], np.int32))
        assert root == len(done) - 1
        return t

    def save(self, path: str | Path) -> None:
        parts = [x.view(np.uint8) for x in (self.arcs, self.targets, self.skipped, self.final, self.ids)]
        with open(path, "wb") as f:
            f.write(np.array([len(p) for p in parts], np.int64).tobytes())
            for p in parts:
                f.write(p.tobytes())

    @classmethod
    def map(cls, path: str | Path) -> Transducer:
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, out = raw[:40].view(np.int64), 40, []
        for n, kind in zip(sizes, (np.int64, np.int32, np.int32, np.uint8, np.int32)):
            out.append(np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, at))
            at += int(n)
        return cls(*out)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, -1 if the automaton doesn't accept it."""
        n = len(words)
        ids = np.full(n, -1, np.int64)
        if not n or not len(self.arcs):
            return ids
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        live = np.nonzero(lengths)[0]
        state = np.full(len(live), len(self.final) - 1, np.int64)
        index = np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[at] == key
            live, at = live[ok], at[ok]
            index, state = index[ok] + self.skipped[at], self.targets[at].astype(np.int64)
            step += 1
            ended = lengths[live] == step
            hit = ended & (self.final[state] == 1)
            ids[live[hit]] = self.ids[index[hit]]
            live, state, index = live[~ended], state[~ended], index[~ended]
        return ids


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the adjacent pair of least rank, leftmost first, is merged until none is in the vocabulary."""
    import heapq

    parts = [word[i : i + 1] for i in range(len(word))]
    after, before, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else len(parts)
        if j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p, live in zip(parts, alive) if live]


class Encoder:
    """Texts to packed int32 ids, with the tables of one worker."""

    def __init__(self, ranks_path: str, lexicon_path: str):
        import regex

        self.path, self.lexicon = ranks_path, Transducer.map(lexicon_path)
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @functools.cached_property
    def merged(self):
        """The exact merge of one word, by the tiktoken library where there is one."""
        ranks = load_ranks(self.path)
        try:
            import tiktoken
        except ImportError:
            return lambda w: merge(w.encode(), ranks)
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def resolve(self, pieces: set[str]) -> None:
        """Adds the ids of all ``pieces`` to the table."""
        if len(self.pieces) + len(pieces) > TABLE:
            self.pieces.clear()
        if len(self.words) > TABLE:
            self.words.clear()
        split = {p: self.split(p) for p in pieces}
        new = list({w for ws in split.values() for w in ws if w not in self.words})
        for w, i in zip(new, self.lexicon.look_up([w.encode() for w in new])):
            self.words[w] = np.array([i] if i >= 0 else self.merged(w), np.int32).tobytes()
        for p, ws in split.items():
            self.pieces[p] = b"".join([self.words[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        todo, missing = [], set()
        for i, text in enumerate(texts):
            if text:
                cut = self.split(text) if _ODD.search(text) else _COARSE.findall(text)
                try:
                    out[i] = b"".join(map(self.pieces.__getitem__, cut))
                except KeyError:
                    todo.append((i, cut))
                    missing.update(p for p in cut if p not in self.pieces)
                if len(missing) > TABLE // 2:
                    self._finish(todo, missing, out)
        self._finish(todo, missing, out)
        return out

    def _finish(self, todo, missing, out) -> None:
        if not todo:
            return
        for i, cut in todo:  # the table may start anew while it is filled, so each text's pieces are seen to again
            lost = {p for p in cut if p not in self.pieces}
            if lost:
                self.resolve(missing | lost if missing else lost)
                missing.clear()
                lost = {p for p in cut if p not in self.pieces}
                if lost:
                    self.resolve(lost)
            out[i] = b"".join([self.pieces[p] if p in self.pieces else self._one(p) for p in cut])
        todo.clear()
        missing.clear()

    def _one(self, piece: str) -> bytes:
        return b"".join(np.array(self.merged(w), np.int32).tobytes() for w in self.split(piece))


@functools.lru_cache(maxsize=2)
def _encoder(ranks: str, lexicon: str) -> Encoder:
    from pyspark import SparkFiles

    return Encoder(SparkFiles.get(ranks), SparkFiles.get(lexicon))


_sent: dict[tuple[str, str], tuple[str, str]] = {}


def send(spark: SparkSession, path: str | None = None) -> tuple[str, str]:
    """Compiles the lexicon of a rank file and ships both to the executors; gives their names there."""
    path = path or f"{TOKENIZERS}/{RANKS}"
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        import regex

        ranks, whole, words = load_ranks(path), regex.compile(PATTERN).fullmatch, {}
        for w, i in ranks.items():
            try:
                if whole(w.decode()):
                    words[w] = i
            except UnicodeDecodeError:
                pass
        folder = tempfile.mkdtemp(prefix="deckmill-lexicon-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        lexicon = os.path.join(folder, Path(path).name + ".lexicon")
        Transducer.compile(words).save(lexicon)
        for f in (path, lexicon):
            spark.sparkContext.addFile(f)
        _sent[key] = (Path(path).name, Path(lexicon).name)
    return _sent[key]


def token_ids(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """ARRAY<INT> of a text's ids without special tokens; null and empty texts give the empty array."""
    names = send(spark, path)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(a):
        import pyarrow as pa

        packed = _encoder(*names).encode(a.to_pylist())
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    return ids(text)


def token_count(spark: SparkSession, text: Column, path: str | None = None) -> Column:
    """INT number of a text's ids; 0 for null and empty texts."""
    names = send(spark, path)

    @F.arrow_udf(T.IntegerType())
    def count(a):
        import pyarrow as pa

        return pa.array([len(p) // 4 for p in _encoder(*names).encode(a.to_pylist())], pa.int32())

    return count(text)


def encoded(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): one row per input row."""
    return docs.select(key, token_ids(docs.sparkSession, F.col(text), path).alias("ids"))
