"""Pairs of records above a Jaccard similarity (problem 2), by b-bit MinHash.

1. A record is a set of 64-bit element hashes. Records with equal sets form a
   class; only its least key goes on, so copies never meet.
2. Minima under ``bands * rows`` hash functions are taken for whole Arrow
   batches at once. Each band of minima gives one key. Of 64 of the minima one
   low bit of a mix is retained and packed into one 64-bit signature.
3. Representatives are joined on band keys. The join carries the signatures:
   the similarity is estimated from the number of equal bits, corrected for the
   half of the bits that agree by chance, and pairs too far below the threshold
   leave inside the join, before anything is shuffled again.
4. What is left is checked exactly on the sets of just those records.

``bands`` are chosen so that a pair at the threshold is missed with probability
below 2e-4 (``miss_probability``), one above it far less often.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import small_side
from ..functions.lineage import cut

#: Retained bits a signature, one of each of as many minima.
BITS = 64
#: Standard errors below the threshold at which an estimate still passes.
MARGIN = 4.5
#: Band rows of one task of the candidate join, about.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Plan:
    """Threshold of the similarity, and the bands of the signature."""

    threshold: float
    bands: int
    rows: int
    seed: int = 1

    def miss_probability(self, similarity: float) -> float:
        return (1 - similarity**self.rows) ** self.bands

    def least_equal_bits(self) -> int:
        """Equal bits below which a pair of the threshold similarity is MARGIN standard errors off."""
        p = 0.5 + 0.5 * self.threshold
        return int(np.floor(BITS * p - MARGIN * np.sqrt(BITS * p * (1 - p))))


SLIDES = Plan(0.7, 32, 4)
DECKS = Plan(0.6, 120, 5)


def estimate(equal_bits, bits: int = BITS):
    """Similarity from the share of equal bits, of which half agree by chance."""
    return 2.0 * equal_bits / bits - 1.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def minima(flat: np.ndarray, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """uint32 minima, one row per hash function and one column per set; sets are the runs of ``flat`` from ``starts`` and not empty."""
    rng = np.random.default_rng(plan.seed)
    n = plan.bands * plan.rows
    mult, add = rng.integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, np.uint32)
    h = _mix((flat ^ (flat >> np.int64(32))).astype(np.uint32))
    out, buf = np.empty((n, len(starts)), np.uint32), np.empty_like(h)
    for i in range(n):
        np.multiply(h, mult[i], out=buf)
        buf += add[i]
        out[i] = np.minimum.reduceat(buf, starts)
    return out


def band_keys(m: np.ndarray, plan: Plan) -> np.ndarray:
    """int32 key of each set and band: (sets, bands)."""
    keys = np.zeros((plan.bands, m.shape[1]), np.uint32)
    for r in range(plan.rows):
        keys = _mix(keys * np.uint32(0x9E3779B1) ^ m[r :: plan.rows])
    return keys.T.astype(np.uint32).view(np.int32)


def signature(m: np.ndarray) -> np.ndarray:
    """int64 of the retained low bits of BITS of the minima."""
    pick = np.linspace(0, len(m) - 1, BITS).astype(int)
    bits = _mix(m[pick] + np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    out = np.zeros(m.shape[1], np.uint64)
    for i in range(BITS):
        out |= bits[i].astype(np.uint64) << np.uint64(i)
    return out.view(np.int64)


_SIGNED = T.StructType([T.StructField("bands", T.ArrayType(T.IntegerType())), T.StructField("sig", T.LongType())])


def signed(elements: Column, plan: Plan) -> Column:
    """STRUCT<bands ARRAY<INT>, sig BIGINT> of an array of element hashes; null for null and empty sets."""

    @F.arrow_udf(_SIGNED)
    def sign(a):
        import pyarrow as pa

        a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        lengths = np.asarray(a.value_lengths().fill_null(0))
        some = lengths > 0
        flat = np.asarray(a.flatten()).astype(np.int64, copy=False)
        n = int(some.sum())
        starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]]).astype(np.int64)
        m = minima(flat, starts, plan) if n else np.zeros((plan.bands * plan.rows, 0), np.uint32)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * plan.bands), pa.array(np.ascontiguousarray(band_keys(m, plan)).ravel()))
        rows = pa.StructArray.from_arrays([bands, pa.array(signature(m))], ["bands", "sig"])
        if n == len(a):
            return rows
        index = np.where(some, np.cumsum(some) - 1, 0)
        return rows.take(pa.array(index, mask=~some))

    return sign(elements)


def word_shingles(text: Column, words: int, least: int) -> Column:
    """An array that holds the distinct hashes of the runs of ``words`` words of an array of text blocks; empty if it has fewer than ``least`` words, repeats counted.

    Words are the runs of letters and digits of the lower-cased blocks joined by
    a blank. The words are bound to a lambda's variable and the result is meant
    to be exploded: so they are found once and no filter finds them again.
    """
    joined = F.lower(F.array_join(text, " "))
    found = F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    enough = F.filter(F.when(F.length(joined) >= 2 * least - 1, F.array(found)), lambda w: F.size(w) >= max(least, words))
    run = lambda w: lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(words)])
    return F.transform(enough, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), run(w))))


def slide_sets(slides: DataFrame, words: int = 3, least: int = 40) -> DataFrame:
    """(record_type, key, elements) of the slides with enough words."""
    return slides.select(F.lit("slide").alias("record_type"), F.col("slide_key").alias("key"), F.explode(word_shingles(F.col("text"), words, least)).alias("elements"))


def deck_sets(assets: DataFrame, least: int = 5) -> DataFrame:
    """(record_type, key, elements) of the decks with enough distinct files; letter case is ignored, nulls left out."""
    files = assets.where(F.col("sha256").isNotNull() & F.col("deck_id").isNotNull()).select("deck_id", F.xxhash64(F.lower("sha256")).alias("h"))
    d = files.groupBy("deck_id").agg(F.collect_set("h").alias("elements")).where(F.size("elements") >= least)
    return d.select(F.lit("deck").alias("record_type"), F.col("deck_id").alias("key"), "elements")


def prepared(sets: DataFrame, plan: Plan) -> DataFrame:
    """(record_type, key, s1, s2, bands, sig): the set's 128-bit key, band keys and signature; repeated keys are kept."""
    d = sets.withColumn("m", signed(F.col("elements"), plan)).withColumn("o", F.array_sort("elements"))
    return d.select("record_type", "key", F.xxhash64("o").alias("s1"), F.xxhash64(F.lit("s"), "o").alias("s2"), "m.bands", "m.sig")


def members(rows: DataFrame) -> DataFrame:
    """(record_type, key, rep): the least key with the same set, for each key once."""
    own = rows.select("record_type", "key", "s1", "s2").distinct()
    reps = own.groupBy("record_type", "s1", "s2").agg(F.min("key").alias("rep"), F.count("*").alias("n"))
    single = reps.where("n = 1").select("record_type", F.col("rep").alias("key"), "rep")
    several = own.join(reps.where("n > 1"), ["record_type", "s1", "s2"]).select("record_type", "key", "rep")
    return single.unionByName(several)


def candidates(rows: DataFrame, placed: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """(record_type, a, b) of representatives that share a band and pass the estimate, each once, a < b."""
    out = None
    for kind, plan in plans.items():
        copies = small_side(placed.where((F.col("record_type") == kind) & (F.col("key") != F.col("rep"))).select("key"))
        d = rows.where(F.col("record_type") == kind).join(copies, "key", "left_anti").select("key", "sig", F.posexplode("bands").alias("band", "k"))
        d = d.select((F.col("band").cast("bigint") * (1 << 32) + F.col("k").cast("bigint")).alias("k"), "key", "sig")
        # tasks grow with the rows, whatever the session's number of partitions
        spark = rows.sparkSession
        tasks = -(-placed.where(F.col("record_type") == kind).count() * plan.bands // TASK_ROWS)
        d = d.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")
        # both sides are the very same plan, without renaming, so that they share one exchange
        equal = F.lit(BITS) - F.bit_count(F.col("x.sig").bitwiseXOR(F.col("y.sig")))
        pairs = d.alias("x").join(d.alias("y"), F.col("x.k") == F.col("y.k")).where((F.col("x.key") < F.col("y.key")) & (equal >= plan.least_equal_bits()))
        pairs = pairs.select(F.lit(kind).alias("record_type"), F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out


def verified(pairs: DataFrame, sets_of: dict, plans: dict[str, Plan]) -> DataFrame:
    """(record_type, a, b, similarity) of the candidate pairs (cut from their lineage) at or above the threshold, on their whole sets."""
    out = None
    for kind, plan in plans.items():
        p = pairs.where(F.col("record_type") == kind)
        needed = p.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        sets = sets_of[kind](small_side(needed)).select("key", "elements").dropDuplicates(["key"])
        both = p.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - F.col("common")
        d = both.withColumn("common", common).where(F.col("common") >= plan.threshold * union).select("record_type", "a", "b", (F.col("common") / union).alias("similarity"))
        out = d if out is None else out.unionByName(d)
    return out


def similar(slides: DataFrame, assets: DataFrame, plans: dict[str, Plan] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between representatives (record_type, a, b, similarity) and memberships (record_type, key, rep), both cut.

    Slides of fewer than 40 words and decks of fewer than 5 distinct files don't
    take part; null texts and hashes are left out; redelivered rows count once.
    """
    plans = plans or {"slide": SLIDES, "deck": DECKS}
    rows = cut(prepared(slide_sets(slides), plans["slide"]).unionByName(prepared(deck_sets(assets), plans["deck"])))
    placed = cut(members(rows))
    pairs = cut(candidates(rows, placed, plans))
    sets_of = {
        "slide": lambda needed: slide_sets(slides.join(needed.withColumnRenamed("key", "slide_key"), "slide_key", "left_semi")),
        "deck": lambda needed: deck_sets(assets.join(needed.withColumnRenamed("key", "deck_id"), "deck_id", "left_semi")),
    }
    return verified(pairs, sets_of, plans), placed


def all_pairs(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(record_type, key_a, key_b): the links carried over to all members, and the pairs of copies."""
    on = ["record_type"]
    a = placed.select(*on, F.col("rep").alias("a"), F.col("key").alias("x"))
    b = placed.select(*on, F.col("rep").alias("b"), F.col("key").alias("y"))
    across = links.join(a, [*on, "a"]).join(b, [*on, "b"]).select(*on, F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    several = placed.join(placed.where("key <> rep").select(*on, "rep").distinct(), [*on, "rep"], "left_semi")
    inside = several.select(*on, "rep", F.col("key").alias("key_a")).join(several.select(*on, "rep", F.col("key").alias("key_b")), [*on, "rep"]).where("key_a < key_b")
    return across.unionByName(inside.select(*on, "key_a", "key_b"))


def classes(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(record_type, key, class_id, n_links): every record's class of equal sets, and the number of other classes similar to it."""
    ends = links.select("record_type", F.explode(F.array("a", "b")).alias("rep")).groupBy("record_type", "rep").agg(F.count("*").alias("n_links"))
    return placed.join(ends, ["record_type", "rep"], "left").select("record_type", "key", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
