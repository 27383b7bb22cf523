"""Near-duplicate components by MinHash bands and odd sketches, confirmed on full sets.

1. Each text becomes the set of its distinct word shingles; a profile has the
   set's size and fingerprint, MinHash band keys and an *odd sketch*: the MinHash
   samples folded into a parity bitmap. The population count of the XOR of two
   bitmaps estimates a high similarity closely without the samples.
2. Texts with the same set are one class, its smallest document stands for it.
3. Classes that share a band key are candidates. They are not paired with each
   other: first every class is compared with one centre of its bucket, and the
   links found are contracted to components. In buckets that still hold several
   components, the classes outside the largest one are compared with a few random
   members of it; those that are left after that meet the rest of the bucket.
4. Sizes and odd sketches discard candidates that are clearly below the
   threshold. Next to the sketch of the samples stands one of the whole set: each
   odd bit of an XOR of those needs at least one shingle that only one text has,
   so it discards without any error. Every link is confirmed on the full sets.

With 28 bands of 4 rows two texts of similarity 0.8 share no band with
probability (1 - 0.8^4)^28 = 4e-7; the sketch bound leaves out a pair of
similarity 0.8 with about 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (
    WHITE,
    byte_table,
    components,
    find_words,
    hash_runs,
    hash_words,
    list_array,
    mix,
    prepare,
    row_uid,
    stored,
    text_slices,
    with_groups,
)

#: Bands, rows of a band, bits of an odd sketch (four words of 64).
BANDS, BAND_ROWS, SKETCH_BITS = 28, 4, 256
SAMPLES = BANDS * BAND_ROWS
#: Random members of a bucket's largest component that the classes outside of it are compared with.
CENTRES = 4
#: Bits of the parity bitmap over the whole set (sixteen words of 64).
PARITY_BITS = 1024
#: XOR bits up to which two sketches may be of similarity 0.8: the mean is 39 there, the bound six deviations above.
SKETCH_SIGMAS = 6.0

_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**63, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INSIDE, _TO = byte_table(WHITE, lower=True)


def sketch_limit(percent: int, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """XOR bits that a pair at the threshold stays within, by ``SKETCH_SIGMAS`` deviations.

    A sample differs with probability ``1 - J`` and then flips two bits, so the
    number of flips has a binomial spread; a bit is odd after ``m`` flips with
    probability ``(1 - exp(-2 m / bits)) / 2``.
    """
    j = percent / 100
    flips = 2 * samples * (1 - j)
    spread = 2 * np.sqrt(samples * j * (1 - j))
    odd = (1 - np.exp(-2 * flips / bits)) / 2
    deviation = np.sqrt((np.exp(-2 * flips / bits) * spread) ** 2 + bits * odd * (1 - odd))
    return int(np.ceil(bits * odd + SKETCH_SIGMAS * deviation))


def shingle_sets(texts: pa.Array, width: int):
    """``(sets, row bounds)`` of slices of rows: distinct shingle hashes, sorted within each row."""
    for first, data, offsets in text_slices(texts):
        starts, ends, bounds = find_words(data, offsets, _INSIDE)
        words = hash_words(data, starts, ends, _TO)
        n = np.diff(bounds)
        sets, sizes = [], np.zeros(len(n), np.int64)
        shingles = hash_runs(words, width)
        for r in np.flatnonzero(n):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= width:
                s = np.unique(shingles[a:b - width + 1])
            else:
                s = hash_runs(words[a:b], b - a) + np.uint64(b - a)
            sets.append(s)
            sizes[r] = len(s)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield first, flat, np.concatenate([[0], np.cumsum(sizes)])


def _parity(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of the bits that are hit an odd number of times."""
    return np.packbits((np.bincount(bits, minlength=size) % 2).astype(np.uint8)).view(np.int64)


_PROFILE = pa.struct([
    ("n", pa.int64()), ("print", pa.int64()), ("check", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
    ("parity", pa.list_(pa.int64())),
])


def profile(text: Column, width: int) -> Column:
    """Set size, a 128-bit fingerprint of the set, band keys and odd sketch; sketches are NULL for an empty set."""

    @F.arrow_udf("struct<n:bigint,print:bigint,check:bigint,bands:array<bigint>,sketch:array<bigint>,parity:array<bigint>>")
    def profiled(texts: pa.Array) -> pa.Array:
        out = []
        for _, flat, bounds in shingle_sets(texts, width):
            for r in range(len(bounds) - 1):
                s = flat[bounds[r]:bounds[r + 1]]
                if not len(s):
                    out.append((0, 0, 0, None, None, None))
                    continue
                least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):
                    np.minimum(least, (s[at:at + 4096, None] * _MULTIPLIERS).min(axis=0), out=least)
                least = mix(least)
                rows = least.reshape(BANDS, BAND_ROWS)
                keys = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(BAND_ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
                # Sample i with its value falls on one bit; bits hit twice are even again.
                bit = (mix(least + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
                sketch = _parity(bit, SKETCH_BITS)
                spread = mix(s)
                parity = _parity((spread % np.uint64(PARITY_BITS)).astype(np.int64), PARITY_BITS)
                both = spread.sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                out.append((len(s), int(both[0].view(np.int64)), int(both[1].view(np.int64)), keys.view(np.int64), sketch, parity))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PROFILE, strict=True)], fields=list(_PROFILE))

    return profiled(text)


def shingle_set(text: Column, width: int) -> Column:
    """The distinct shingles of a text as sorted 64-bit hashes."""

    @F.arrow_udf("array<bigint>")
    def listed(texts: pa.Array) -> pa.Array:
        parts = [list_array(flat.view(np.int64), bounds, pa.int64()) for _, flat, bounds in shingle_sets(texts, width)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return listed(text)


def _odd_bits(a: str, b: str, words: int) -> Column:
    xor = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(words)]
    return sum(xor[1:], xor[0])


def _plausible(a: str, b: str, percent: int) -> Column:
    """Neither the sizes nor the odd sketches rule the pair out."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    # At similarity J two sets differ in (1 - J) / (1 + J) of their sizes' sum.
    whole = _odd_bits(f"{a}.parity", f"{b}.parity", PARITY_BITS // 64) * (100 + percent) <= (small + large) * (100 - percent)
    return (small * 100 >= large * percent) & (_odd_bits(f"{a}.sketch", f"{b}.sketch", SKETCH_BITS // 64) <= sketch_limit(percent)) & whole


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * 100 >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _open_buckets(members: DataFrame, sketched: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows ``(key, rep, comp, major, n, sketch, parity)`` of the buckets that hold several components; ``major`` is the largest."""
    known = sketched.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = stored(known.withColumn("comp", F.coalesce("component", "rep")).drop("component"), "known")
    held = stored(members.select("key", "rep").join(known.select("rep", "comp"), "rep"), "held")
    parts = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    largest = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("c", "comp"))["comp"].alias("major"))
    largest = stored(largest.where("parts > 1").select("key", "major"), "largest")
    return stored(held.join(largest, "key").join(known.drop("comp"), "rep"), "open")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(uid, id, n_shingles, component)`` per row of ``docs``; ``component`` is the smallest id reachable.

    Ids are BIGINT and not NULL in a component's name: rows with a NULL id take
    part through the internal key and sort last. Rows that agree in id and text
    are one document. A text without words (also NULL or empty) has size 0 and
    is linked with nothing. ``uid`` is ``row_uid(id, text)``.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumn("uid", row_uid(F.col("id"), F.col("text")))
    profiles = stored(rows.select("uid", "id", profile(F.col("text"), width).alias("p")).select("uid", "id", "p.*"), "profiles")
    full = profiles.where("n > 0").withColumn("class", F.xxhash64("n", "print", "check"))
    # One row per distinct set; its sketch is that of any member.
    reps = full.groupBy("class").agg(F.min("id").alias("rep_id"), F.min("uid").alias("rep"), F.max("n").alias("n"))
    reps = stored(reps, "reps")
    classes = full.join(reps.select(F.col("rep").alias("uid"), F.col("rep").alias("_r")), "uid", "left_semi")
    classes = stored(classes.select(F.col("uid").alias("rep"), "n", "sketch", "parity", "bands").dropDuplicates(["rep"]), "classes")

    keys = classes.select("rep", F.explode("bands").alias("key"))
    order = F.xxhash64("rep")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("h")).where("c > 1")
    shared = stored(shared.select("key", "h"), "shared")
    members = stored(keys.join(shared, "key").select("key", "rep", "h"), "members")
    inside = members.select("rep").distinct()
    sketched = stored(classes.join(inside, "rep", "left_semi").select("rep", "n", "sketch", "parity"), "sketched")

    texts = rows.join(sketched.select(F.col("rep").alias("uid")), "uid", "left_semi").dropDuplicates(["uid"])
    sets = stored(texts.select(F.col("uid").alias("rep"), shingle_set(F.col("text"), width).alias("set")), "sets")

    # Round 1: each class and the bucket's centre, the class of least hash. Buckets of like classes share few centres.
    a = sketched.select(F.col("rep").alias("a"), F.struct("n", "sketch", "parity").alias("x"))
    b = sketched.select(F.xxhash64("rep").alias("h"), F.col("rep").alias("b"), F.struct("n", "sketch", "parity").alias("y"))
    stars = members.select(F.col("rep").alias("a"), "h").distinct().where(F.xxhash64("a") != F.col("h"))
    stars = stars.join(a, "a").join(b, "h").where(_plausible("x", "y", percent)).select("a", "b")
    links = stored(_confirmed(stored(stars, "stars"), sets, percent), "links")
    joined = components(links)

    # Round 2: classes outside a bucket's largest component and a few random members of that component.
    open_rows = _open_buckets(members, sketched, joined)
    pick = [F.min_by("rep", F.xxhash64(F.lit(i), "rep", "key")) for i in range(CENTRES)]
    centres = open_rows.where("comp = major").groupBy("key").agg(F.array(*pick).alias("b"))
    centres = stored(centres.select("key", F.explode("b").alias("b")), "centres")
    again = open_rows.where("comp <> major").select("key", F.col("rep").alias("a"), F.struct("n", "sketch", "parity").alias("x"))
    again = again.join(centres, "key").drop("key").join(b.drop("h"), "b").where(_plausible("x", "y", percent)).select("a", "b").distinct()
    linked = stored(_confirmed(stored(again, "again"), sets, percent), "more")
    joined = components(joined.toDF("a", "b").unionByName(linked))

    # Round 3: across the components that a bucket still holds.
    open_rows = _open_buckets(members, sketched, joined)
    minor = open_rows.where("comp <> major").alias("x")
    anyone = open_rows.alias("y")
    across = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.comp") == F.col("y.major")) | (F.col("x.rep") < F.col("y.rep"))) & _plausible("x", "y", percent)
    )
    last = minor.join(anyone, across).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    last = stored(_confirmed(stored(last, "last"), sets, percent), "last_links")
    if not last.isEmpty():
        joined = components(joined.toDF("a", "b").unionByName(last))

    # The smallest id of a component names it; classes and rows take the name.
    named = reps.select("class", "rep", "rep_id", "n").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = stored(named.select("class", "rep_id", F.coalesce("component", "rep").alias("comp")), "named")
    names = with_groups(named, "comp", {"name": F.min("rep_id")}, "names").select("class", "name")
    placed = with_class(full.select("uid", "id", "n", "class"), stored(names, "class_names"))
    alone = profiles.where("n = 0").select("uid", "id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("id").alias("component"))
    return placed.unionByName(alone)


def with_class(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Give each row its class's component. ``names`` has one row per class; rows of a hot class are split by Spark's skew join."""
    met = rows.join(names, "class")
    return met.select("uid", "id", F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component"))
