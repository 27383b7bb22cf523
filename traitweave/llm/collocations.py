"""Phrases whose words occur together more often than apart, from FM-indexes over word ids.

1. Executors cut their texts into shards of bounded size, by language. A shard's
   pieces become one sequence of word ids with a separator after each piece, and
   two FM-indexes are built: of the sequence and of its reverse, sorted as deep as
   the longest phrase asked for.
2. Phrases are intervals in both. Extending every interval by the words before it
   (forward index) and after it (reverse index) gives all phrases of one more word
   with their counts, and names the shorter phrase on either side of each.
3. Counts are summed across shards. A longer phrase can only be frequent if both
   phrases it extends are, so before the next length the frequent ones mark a bit
   map of fixed size that tasks receive; a false mark costs a row, never a phrase.
4. Cuts, containment and the report are joins and windows over frequent phrases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_table, find_words, hash_rows, hash_words, mix, prepare, stored, text_slices

UNKNOWN = "und"
#: Bytes of text in a shard; a longer piece is a shard of its own.
SHARD_BYTES = 6 << 20
#: Bits of the map of frequent phrases.
MAP_BITS = 1 << 26
#: Parts of a language that are ranked on their own before the report.
REPORT_PARTS = 64
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_INSIDE, _TO = byte_table(b" \t" + _BREAKS, lower=True)
_BREAK = np.zeros(256, bool)
_BREAK[list(_BREAKS)] = True
_ANY_BREAK = re.compile(b"[" + re.escape(_BREAKS) + b"]")


# -- the index of one shard ---------------------------------------------------


class FMIndex:
    """Index of a sequence of words 1 to ``size - 1`` in which 0 separates pieces, sorted by the first ``depth`` words.

    A row is a start, in order: ``before`` is the word before it, ``back`` the row of
    the start one word earlier, and ``heads`` are the rows at which the starts with
    each word begin. Equal beginnings are in no particular order,
    which intervals of up to ``depth`` words do not notice.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int):
        text = text.astype(np.int32)
        bits = max(1, int(size - 1).bit_length())
        key, packed, room = text, [text.astype(np.int64)], bits
        for _ in range(1, depth):
            # The next word; behind a separator nothing counts.
            key = np.where(text > 0, np.concatenate([key[1:], [0]]), 0)
            if room + bits > 63:
                packed.append(key.astype(np.int64))
                room = bits
            else:
                packed[-1] = (packed[-1] << bits) | key
                room += bits
        rows = np.argsort(packed[0], kind="stable") if len(packed) == 1 else np.lexsort(packed[::-1])
        del packed, key
        self.before = np.concatenate([text[-1:], text[:-1]])[rows]
        self.back = np.empty(len(text), np.int32)
        self.back[np.argsort(self.before, kind="stable")] = np.arange(len(text), dtype=np.int32)
        #: The interval of each row for phrases of one word.
        self.single = text[rows] - 1
        self.heads = np.searchsorted(self.single, np.arange(-1, size))

    def extend(self, group: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Extend ``count`` intervals by every word before them; ``group`` names the interval of each row, -1 for none.

        Returns per new interval its word, the old interval, its size and the
        rows of the old interval whose word is smaller, then the new ``group``.
        New intervals are in the order of their word and the old interval.
        """
        at = np.flatnonzero((group >= 0) & (self.before > 0))
        pairs, place, sizes = np.unique(self.before[at].astype(np.int64) * count + group[at], return_inverse=True, return_counts=True)
        word, old = pairs // max(count, 1), pairs % max(count, 1)
        renewed = np.full(len(group), -1, np.int32)
        renewed[self.back[at]] = place
        # Rows of the old interval that go to smaller words; separators are the smallest.
        ends = np.bincount(group[(group >= 0) & (self.before == 0)], minlength=count)
        order = np.argsort(old, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        smaller = np.empty(len(pairs), np.int64)
        smaller[order] = run - run[np.searchsorted(old[order], old[order])] + ends[old[order]]
        return word, old, sizes, smaller, renewed


@dataclass
class Phrases:
    """All phrases of one length in order: a column of ``words`` per word, their ``count``, and the place of the phrase without its last (``first``) and without its first word (``rest``) among the shorter ones."""

    words: np.ndarray
    count: np.ndarray
    first: np.ndarray | None = None
    rest: np.ndarray | None = None


def enumerate_phrases(text: np.ndarray, size: int, depth: int) -> Iterator[Phrases]:
    """The phrases of 1, 2, ... ``depth`` words of a sequence that ends with 0, by extending intervals in both directions."""
    forward, reverse = FMIndex(text, size, depth), FMIndex(text[::-1], size, depth)
    # Phrases are numbered in the order of the forward index, where their intervals start at ``start``.
    words, count, start = np.arange(1, size)[:, None], np.diff(forward.heads)[1:], forward.heads[1:-1]
    ahead, behind = forward.single, reverse.single
    yield Phrases(words, count)
    for _ in range(1, depth):
        word, rest, sizes, _, ahead = forward.extend(ahead, len(count))
        rows = np.flatnonzero(ahead >= 0)
        begins = rows[np.flatnonzero(np.diff(ahead[rows], prepend=-1))]
        # The word after, by the reverse index: the interval of the forward index narrows by what goes to smaller words.
        _, first, _, smaller, behind = reverse.extend(behind, len(count))
        found = start[first] + smaller
        order = np.argsort(found)
        if not np.array_equal(begins, found[order]):
            raise AssertionError("forward and reverse index disagree")
        place = np.empty(len(order) + 1, np.int32)
        place[order], place[-1] = np.arange(len(order)), -1
        behind = place[behind]
        words, count, start = np.concatenate([word[:, None], words[rest]], axis=1), sizes, begins
        yield Phrases(words, count, first[order], rest)


# -- texts to shards ----------------------------------------------------------


def _split(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, cut at the end of a piece only."""
    at = 0
    while len(text) - at > most:
        cuts = np.flatnonzero(_BREAK[np.frombuffer(text, np.uint8, count=most, offset=at)])
        later = _ANY_BREAK.search(text, at + most)
        end = at + int(cuts[-1]) + 1 if len(cuts) else later.end() if later else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """``(language, texts)`` of about ``SHARD_BYTES``; what a task holds back is bounded by twice that, over all languages."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            for part in _split(text.as_py(), SHARD_BYTES):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= SHARD_BYTES:
                    yield from ((k, pa.array(v, pa.large_binary())) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, pa.array(v, pa.large_binary())) for k, v in held.items())


def _sequence(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word ids (from 1) with a 0 after each piece, the words by id, and a 64-bit hash of each word."""
    ids, known, offset = [], [], 0
    for _, data, offsets in text_slices(texts):
        starts, ends, bounds = find_words(data, offsets, _INSIDE)
        if not len(starts):
            continue
        lengths = ends - starts
        inside = _INSIDE[data]
        held = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(_TO[data[inside]])]
        ).dictionary_encode()
        new = np.zeros(len(starts), bool)
        first = bounds[:-1]
        new[first[first < len(starts)]] = True
        broken = np.concatenate([[0], np.cumsum(_BREAK[data])])
        new[1:] |= broken[starts[1:]] > broken[ends[:-1]]
        # Room for a separator before each piece but the first.
        at = np.arange(len(starts)) + np.cumsum(new) - 1
        row = np.zeros(at[-1] + 2, np.int64)
        row[at] = held.indices.to_numpy() + 1 + offset
        ids.append(row)
        known.append(held.dictionary)
        offset += len(held.dictionary)
    if not ids:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, np.uint64)
    # The slices' dictionaries become one.
    merged = pa.concat_arrays(known).dictionary_encode()
    to = np.concatenate([[0], merged.indices.to_numpy() + 1])
    words = merged.dictionary
    data = np.frombuffer(words.buffers()[2], np.uint8)
    edges = np.frombuffer(words.buffers()[1], np.int64, count=len(words) + 1, offset=8 * words.offset)
    hashes = hash_words(data, edges[:-1], edges[1:], np.arange(256, dtype=np.uint8))
    return to[np.concatenate(ids)], words, hashes


def _spot(hashes: np.ndarray, lang: np.ndarray | np.uint64) -> np.ndarray:
    """The bit of phrases given as one row of word hashes each."""
    n, k = hashes.shape
    h = hash_rows(hashes.ravel(), np.arange(0, n * k + 1, k)) if n else np.zeros(0, np.uint64)
    return (mix(h ^ lang) % np.uint64(MAP_BITS)).astype(np.int64)


def _lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return hash_words(data, np.array([0]), np.array([len(data)]), np.arange(256, dtype=np.uint8))[0]


def _thinned(text: np.ndarray, hashes: np.ndarray, lang: str, bits: np.ndarray, depth: int) -> np.ndarray:
    """The sequence without what cannot be in a frequent phrase of ``depth`` words: only runs whose every ``depth - 1`` words are marked stay."""
    k = depth - 1
    n = len(text) - k + 1
    if n <= 0:
        return text[:0]
    grams = np.stack([text[i:i + n] for i in range(k)], axis=1)
    whole = (grams > 0).all(axis=1)
    spots = _spot(np.concatenate([[np.uint64(0)], hashes])[grams[whole]], _lang_hash(lang))
    marked = np.zeros(n + 1, bool)
    marked[np.flatnonzero(whole)] = (bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 > 0
    # A phrase starts where this and the next shorter phrase are marked.
    starts = np.flatnonzero(marked[:-1] & marked[1:])
    stays = np.zeros(len(text) + 1, bool)
    for i in range(depth):
        stays[starts + i] = True
    # A word that stays but is not followed within a phrase ends its run.
    linked = np.zeros(len(text) + 1, bool)
    for i in range(depth - 1):
        linked[starts + i] = True
    kept = np.flatnonzero(stays)
    ends = ~linked[kept]
    at = np.arange(len(kept)) + np.cumsum(ends) - ends
    out = np.zeros(len(kept) + int(ends.sum()), np.int64)
    out[at] = text[kept]
    return out


_COUNTED = "lang string, size int, phrase string, f bigint"
_SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _counts(docs: DataFrame, lengths: range, marks=None) -> DataFrame:
    """``(lang, size, phrase, f)`` per shard and phrase of ``lengths`` words; ``marks`` is a broadcast bit map of the phrases one word shorter."""
    depth = lengths[-1]

    def counted(batches):
        for lang, texts in _shards(batches):
            text, words, hashes = _sequence(texts)
            if marks is not None and len(text):
                text = _thinned(text, hashes, lang, marks.value, depth)
            if not len(text):
                continue
            if 0 in lengths:
                yield pa.RecordBatch.from_pylist([{"lang": lang, "size": 0, "phrase": "", "f": int((text > 0).sum())}], schema=_SCHEMA)
            # Only the words that occur get an id.
            used = np.unique(text)
            used = used[used > 0]
            to = np.zeros(len(words) + 1, np.int64)
            to[used] = np.arange(1, len(used) + 1)
            names = words.take(pa.array(used - 1)).cast(pa.binary())
            for found in enumerate_phrases(to[text], len(used) + 1, depth):
                size = found.words.shape[1]
                if size not in lengths:
                    continue
                for a in range(0, len(found.count), 100_000):
                    w, f = found.words[a:a + 100_000], found.count[a:a + 100_000]
                    parts = [names.take(pa.array(w[:, i] - 1)) for i in range(size)]
                    phrase = pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]
                    columns = [pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), size, np.int32)), phrase.cast(pa.string()), pa.array(f)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return docs.mapInArrow(counted, _COUNTED)


def _bit_map(phrases: DataFrame) -> np.ndarray:
    """The map of fixed size with the bits of ``(lang, phrase)`` set; the driver receives at most ``MAP_BITS`` / 8 bytes."""

    @F.arrow_udf("bigint")
    def spot(lang: pa.Array, phrase: pa.Array) -> pa.Array:
        out = []
        inside = np.ones(256, bool)
        inside[0x20] = False
        names = lang.dictionary_encode()
        of = np.array([_lang_hash(v) for v in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()] if len(lang) else np.zeros(0, np.uint64)
        for first, data, offsets in text_slices(phrase):
            starts, ends, bounds = find_words(data, offsets, inside)
            h = hash_words(data, starts, ends, np.arange(256, dtype=np.uint8))
            out.append(_spot(h.reshape(len(bounds) - 1, -1), of[first:first + len(bounds) - 1]))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    # Bit v of the map is bit v of these bit maps when they count from 1.
    spots = phrases.select((spot("lang", "phrase") + 1).alias("at"))
    cells = spots.groupBy(F.bitmap_bucket_number("at").alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in cells.toArrow().to_pylist():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[(r["cell"] - 1) * len(bits):r["cell"] * len(bits)] = bits
    return out


# -- phrases to collocations --------------------------------------------------


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of the phrases with at least ``min_count`` occurrences, and ``(lang, n)``, words per language."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def often(lengths: range, marks=None) -> DataFrame:
        """Size 0 is all words of a language, however rare."""
        summed = _counts(rows, lengths, marks).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        return stored(summed.where((F.col("f") >= min_count) | (F.col("size") == 0)), "frequent")

    found = often(range(0, 3))
    frequent, totals = found.where("size > 0"), found.where("size = 0").select("lang", F.col("f").alias("n"))
    for size in range(3, max_words + 1):
        marks = spark.sparkContext.broadcast(_bit_map(found.where(F.col("size") == size - 1)))
        found = often(range(size, size + 1), marks)
        frequent = frequent.unionByName(found)
    return frequent, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10,
                 contained_percent: int = 50, top: int = 2_000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    A phrase has 2 to ``max_words`` words of one piece and at least ``min_count``
    occurrences ``a``. Its score is the least of ``floor(1000000 a a / (l r))`` over
    its cuts into a first part with ``l`` and a rest with ``r`` occurrences; of equal
    cuts the first counts. Phrases inside a longer one that has at least
    ``contained_percent`` of their occurrences are left out.

    A to Z are lower-cased; NULL and empty texts have no words; a NULL language is
    ``und``; repeated rows count each time; other columns are not looked at. Ties go
    by ``a``, then by the bytes of the phrase. Without frequent phrases there is no row.
    """
    frequent, totals = phrase_counts(docs, text_col, lang_col, max_words, min_count)
    candidates = frequent.where("size > 1")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - size)")
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    a, l, r = (F.col(c).cast("decimal(16,0)") for c in "alr")
    # Products of up to 38 digits are exact, and so is the whole-number division.
    cuts = cuts.withColumns({"up": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "down": l * r}).withColumn("score", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase", "size").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")

    words = F.split("phrase", " ", -1)
    spans = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("width")
    inner = candidates.where("size > 2").select("lang", "size", "f", words.alias("w"), spans)
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("width")), " ").alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * contained_percent, F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Each part of a language is ranked on its own first, so the last ranking sees a bounded number of rows.
    part = F.pmod(F.xxhash64("phrase"), F.lit(REPORT_PARTS))
    best = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
