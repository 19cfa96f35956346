"""Filling fixed-capacity containers with items of varying length (problem 8).

The histogram of lengths, which has at most as many rows as the capacity, is
fitted by non-negative least squares with patterns: the multisets of a few
length classes that fill a container exactly. The fitted repeat counts are
fractions that hold for any random part of the items, so the items are spread
over shards by a hash, and each shard rounds the counts down to its own stock,
fills the patterns, and packs what is left over best-fit by falling length,
first into the slack of pattern containers. No item is split unless it is larger
than a container; such an item gives full containers and one rest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens a container holds.
CAPACITY = 2048
#: Length classes: a class is a CLASSES-th of the capacity.
CLASSES = 32
#: Most items of a pattern.
PATTERN_ITEMS = 4
#: Items of a shard, about: what one task packs.
SHARD_ITEMS = 32_768


def patterns(total: int = CLASSES, most: int = PATTERN_ITEMS) -> list[tuple[int, ...]]:
    """All multisets of at most ``most`` classes, largest first, that add up to ``total``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int, cap: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < most:
            for c in range(min(left, cap), 0, -1):
                if c * (most - len(head)) >= left:
                    grow((*head, c), left - c, c)

    grow((), total, total)
    return out


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares by active sets: variables enter by gradient and leave when a step would make them negative."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(6 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance * scale:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                break
            if low[j] and x[j] == 0:  # the newest can't be raised: numerically at the optimum
                active[j] = False
                if not active.any():
                    return x
                continue
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            active &= x > tolerance
            x[~active] = 0.0
        x = s
    return np.maximum(x, 0.0)


def fit(histogram: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns in use and their repeat counts for a histogram over classes 1..n; short classes, which fill slack, weigh less."""
    total = len(histogram)
    every = patterns(total)
    a = np.zeros((total, len(every)))
    for j, p in enumerate(every):
        for c in p:
            a[c - 1, j] += 1
    weight = np.where(np.arange(1, total + 1) * 8 < total, 0.1, 1.0)
    x = nnls(a * weight[:, None], histogram * weight)
    used = [j for j in np.argsort(-x, kind="stable") if x[j] > 0]
    return [every[j] for j in used], x[used]


def pack(sizes: np.ndarray, capacity: int, plan: list[tuple[int, ...]], share: np.ndarray) -> np.ndarray:
    """A container number for each item of one shard; every size is within 0..capacity.

    plan, share: patterns over length classes and how often each is repeated per item.
    """
    n, classes = len(sizes), CLASSES
    where = np.full(n, -1, np.int64)
    unit = capacity / classes
    cls = np.minimum(np.ceil(sizes / unit).astype(np.int64), classes)
    order = np.lexsort((np.arange(n), -sizes))
    stock: list[list[int]] = [[] for _ in range(classes + 1)]
    for i in order[::-1]:
        stock[cls[i]].append(int(i))  # the largest of a class is taken first
    free: list[int] = []
    for p, times in zip(plan, np.floor(share * n).astype(np.int64)):
        need = {c: p.count(c) for c in set(p)}
        for _ in range(min(int(times), *(len(stock[c]) // k for c, k in need.items()))):
            left = capacity
            for c in p:
                i = stock[c].pop()
                where[i] = len(free)
                left -= int(sizes[i])
            free.append(left)
    room: dict[int, list[int]] = {}
    levels = 0  # bit k: some container has k free
    for c, left in enumerate(free):
        if left:
            room.setdefault(left, []).append(c)
            levels |= 1 << left
    for i in order:
        if where[i] >= 0 or not sizes[i]:
            continue
        size = int(sizes[i])
        fitting = levels >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            c = room[left].pop()
            if not room[left]:
                levels &= ~(1 << left)
        else:
            left, c = capacity, len(free)
            free.append(capacity)
        where[i] = c
        left -= size
        free[c] = left
        if left:
            room.setdefault(left, []).append(c)
            levels |= 1 << left
    empty = np.nonzero(where < 0)[0]  # items of size 0 take no space; they are dealt out
    where[empty] = np.arange(len(empty)) % max(1, len(free))
    return where


def packed(sized: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece INT, start INT, n_tokens INT, container_id BIGINT): every item in containers of ``capacity``.

    ``sized`` (cut from its lineage: it is read twice): one row per item; a null
    or negative size counts as 0. Items of size 0 are placed and take no space.
    Pieces of an item larger than a container start at multiples of the capacity.
    """
    s = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("int"), F.lit(0))
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("__s") / capacity).cast("int") - 1, F.lit(0)))
    items = sized.select(F.col(key), s.alias("__s")).select(key, "__s", F.explode(pieces).alias("piece"))
    items = items.select(key, "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("__s") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    counts = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    total = sum(counts.values())
    histogram = np.zeros(CLASSES)
    for n, k in counts.items():
        if n:
            histogram[min(int(np.ceil(n * CLASSES / capacity)), CLASSES) - 1] += k
    plan, repeats = fit(histogram / max(1, total))
    # classes are rounded up, so the counts are brought down to the containers that the true sizes fill
    rounded = float(histogram @ np.arange(1, CLASSES + 1)) * capacity / CLASSES
    repeats = repeats * (sum(n * k for n, k in counts.items()) / rounded if rounded else 1.0)
    shards = max(1, -(-total // SHARD_ITEMS))
    names, schema = [key, "piece", "start", "n_tokens"], T.StructType([*items.schema.fields, T.StructField("container_id", T.LongType())])

    def one(tbl):
        import pyarrow as pa

        tbl = tbl.sort_by([(key, "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")])
        where = pack(tbl["n_tokens"].to_numpy(), capacity, plan, repeats)
        base = int(tbl["__shard"][0].as_py()) << 32
        return tbl.select(names).append_column("container_id", pa.array(where + base, pa.int64()))

    shard = F.pmod(F.xxhash64(key, "piece"), F.lit(shards)).alias("__shard")
    return items.select(shard, *names).groupBy("__shard").applyInArrow(one, schema)


def containers(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, used, free) of a packing."""
    used = F.sum("n_tokens").cast("int")
    return placed.groupBy("container_id").agg(F.count("*").alias("n_items"), used.alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))
