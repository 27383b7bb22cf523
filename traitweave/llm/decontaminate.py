"""Benchmark decontamination with suffix arrays over the training text.

Every task turns its batch of documents into one array of word numbers and sorts
the suffixes of that shard. Every suffix of every benchmark item is then binary
searched in it: the neighbours of its place give the longest verbatim match, and
the range of suffixes that start with a whole window gives all its occurrences.

Words are numbered by the benchmark's own vocabulary; any other word is 0, which
no item has, and a 0 stands between documents, so a match never leaves one. Only
suffixes that can start a match are sorted: those whose first few words start
some window. Nothing is shuffled. The benchmark goes to the tasks in blocks of at
most ``BLOCK_WORDS`` words, one pass over the documents for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import byte_table, find_words, hash_runs, hash_words, list_array, prepare, text_slices

#: Words of a window; words of benchmark text in one pass; words by which suffixes are ordered.
WINDOW, BLOCK_WORDS, DEPTH = 10, 100_000, 64
#: Words at the start of a suffix by which it is chosen for the suffix array.
HEAD = 4

# Words hold 0-9, a-z and everything beyond ASCII; A-Z are lowered.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_INSIDE, _TO = byte_table(SEPARATORS, lower=True)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


@dataclass
class Queries:
    """A block of benchmark items, ready to be searched."""

    names: list[str]
    vocabulary: np.ndarray  # hashes, sorted
    suffixes: np.ndarray  # word numbers of every item suffix, DEPTH wide, 0 behind the end
    item: np.ndarray  # item of each suffix
    window: np.ndarray  # words of the window that starts there, 0 if none does
    head: int  # words by which training suffixes are chosen
    heads: np.ndarray  # hashes of the first words of every window, sorted

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Queries:
        data = pa.array([t or "" for _, t in items], pa.string())
        hashes, bounds = _hashed(data)
        vocabulary = np.unique(hashes)
        numbers = np.searchsorted(vocabulary, hashes) + 1
        rows, item, size = [], [], []
        for i in range(len(items)):
            own = numbers[bounds[i]:bounds[i + 1]]
            n = len(own)
            for at in range(n):
                row = np.zeros(DEPTH, np.uint32)
                row[:min(DEPTH, n - at)] = own[at:at + DEPTH]
                rows.append(row)
                item.append(i)
                size.append(window if at + window <= n else n if at == 0 else 0)
        size = np.array(size, np.int64)
        suffixes = np.array(rows, np.uint32).reshape(-1, DEPTH)
        head = int(min(HEAD, size[size > 0].min())) if (size > 0).any() else HEAD
        starts = suffixes[size > 0][:, :head].astype(np.uint64)
        heads = np.unique(np.concatenate([hash_runs(r, head) for r in starts])) if len(starts) else np.zeros(0, np.uint64)
        return cls([n for n, _ in items], vocabulary, suffixes, np.array(item, np.int64), size, head, heads)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [], []
    for _, data, offsets in text_slices(texts):
        starts, ends, bounds = find_words(data, offsets, _INSIDE)
        hashes.append(hash_words(data, starts, ends, _TO))
        counts.append(np.diff(bounds))
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)


def suffix_array(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in the order of the suffixes that start there (DEPTH words deep), and those suffixes as sortable rows."""
    padded = np.concatenate([numbers, np.zeros(DEPTH, np.uint32)])
    rows = padded[at[:, None] + np.arange(DEPTH)]
    # What is behind the first 0 does not count.
    rows[np.maximum.accumulate(rows == 0, axis=1)] = 0
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")
    return at[order], rows[order]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows as byte strings whose order is that of the words."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def search(queries: Queries, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, words, item)`` of every occurrence of a window, and per query suffix its longest match: ``(position, words)``."""
    none = np.zeros(0, np.int64)
    runs = hash_runs(numbers.astype(np.uint64), queries.head)
    if len(runs) and len(queries.heads):
        place = np.minimum(np.searchsorted(queries.heads, runs), len(queries.heads) - 1)
        at = np.flatnonzero((queries.heads[place] == runs) & (numbers[:len(runs)] != 0))
    else:
        at = none
    if not len(at):
        return none, none, none, np.full(len(queries.item), -1), np.zeros(len(queries.item), np.int64)
    at, rows = suffix_array(numbers, at)
    keys = _keys(rows)
    # The longest match of a sorted place is with one of its neighbours.
    place = np.searchsorted(keys, _keys(queries.suffixes))
    longest, where = np.zeros(len(place), np.int64), np.full(len(place), -1)
    for beside in (place - 1, place):
        ok = (beside >= 0) & (beside < len(at))
        b = np.clip(beside, 0, len(at) - 1)
        same = (rows[b] == queries.suffixes) & (queries.suffixes != 0)
        length = np.where(ok, np.cumprod(same, axis=1).sum(axis=1), 0)
        where = np.where(length > longest, at[b], where)
        longest = np.maximum(longest, length)
    start, words, item = [], [], []
    for size in np.unique(queries.window[queries.window > 0]):
        chosen = np.flatnonzero((queries.window == size) & (longest >= size))
        if not len(chosen):
            continue
        heads, wanted = _keys(rows[:, :size]), _keys(queries.suffixes[chosen][:, :size])
        lo, hi = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
        n = hi - lo
        flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        start.append(at[flat])
        words.append(np.full(len(flat), size))
        item.append(np.repeat(queries.item[chosen], n))
    if not start:
        return none, none, none, where, longest
    return np.concatenate(start), np.concatenate(words), np.concatenate(item), where, longest


_ADDED = StructType([StructField("_runs", ArrayType(LongType())), StructField("_items", ArrayType(StringType())), StructField("_match", LongType()), StructField("_words", LongType())])


def _searched(docs: DataFrame, text_col: str, queries: Queries) -> DataFrame:
    """``docs`` with three columns more: hit word ranges, items and the longest match of this block."""
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    at = docs.columns.index(text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        names = np.array(q.names, dtype=object)
        for batch in batches:
            ranges, items, match, words = [], [], [], []
            for _, data, offsets in text_slices(batch.column(at)):
                starts, ends, bounds = find_words(data, offsets, _INSIDE)
                hashes = hash_words(data, starts, ends, _TO)
                n = len(offsets) - 1
                # One 0 behind every document.
                numbers = np.zeros(len(hashes) + n, np.uint32)
                moved = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(bounds))
                if len(q.vocabulary):
                    place = np.minimum(np.searchsorted(q.vocabulary, hashes), len(q.vocabulary) - 1)
                    numbers[moved] = np.where(q.vocabulary[place] == hashes, place + 1, 0)
                heads = bounds[:-1] + np.arange(n)
                start, size, item, where, longest = search(q, numbers)
                doc = np.searchsorted(heads, start, "right") - 1
                best = np.zeros(n, np.int64)
                found = where >= 0
                np.maximum.at(best, np.searchsorted(heads, where[found], "right") - 1, longest[found])
                words += np.diff(bounds).tolist()
                order = np.lexsort((start, doc))
                cuts = np.searchsorted(doc[order], np.arange(n + 1))
                for d in range(n):
                    mine = order[cuts[d]:cuts[d + 1]]
                    first = start[mine] - heads[d]
                    ranges.append(_merged(first, first + size[mine]))
                    items.append(sorted(set(names[item[mine]])))
                    match.append(int(best[d]))
            added = [pa.array(ranges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(match, pa.int64()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *_ADDED.names])

    return docs.mapInArrow(tasks, StructType([*docs.schema.fields, *_ADDED.fields]))


def _merged(first: np.ndarray, last: np.ndarray) -> list[int]:
    """Word ranges as ``start, end, start, end``, joined where they meet; starts come sorted."""
    if not len(first):
        return []
    reach = np.maximum.accumulate(last)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    ends = reach[np.concatenate([new[1:] - 1, [len(first) - 1]])]
    return np.stack([first[new], ends], axis=1).ravel().tolist()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks; the driver holds one partition and one block at a time."""
    block, n = [], 0
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null")
    for r in items.toLocalIterator():
        size = len(words_of(r.t))
        if size:
            if block and n + size > BLOCK_WORDS:
                yield block
                block, n = [], 0
            block.append((r.i, r.t))
            n += size
    yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with ``leaks = struct(n_words, ranges, items, longest)``.

    ``ranges`` are the hit word ranges as start, end pairs; ``items`` the names
    (as sorted strings) of the items with an occurring window; ``longest`` the
    longest verbatim match in words that starts where a window may (up to DEPTH).
    An item shorter than a window is one window; one without words or with a
    NULL id has none. NULL texts have no words. Repeated rows and items are
    each treated alike. An empty benchmark hits nothing. A column of ``docs``
    named ``leaks`` is replaced.
    """
    if not 0 < window <= DEPTH:
        raise ValueError(f"a window has 1 to {DEPTH} words")
    prepare(docs.sparkSession)
    names = [c for c in docs.columns if c != "leaks"]
    plain = docs.select(*names, F.col(text_col).alias("_text"), F.lit(None).cast("array<bigint>").alias("_all"),
                        F.array().cast("array<string>").alias("_names"), F.lit(0).cast("bigint").alias("_longest"), F.lit(0).cast("bigint").alias("_n"))
    for block in _blocks(benchmark, item_col, item_text_col):
        plain = _searched(plain, "_text", Queries.of(block, window)).withColumns({
            "_all": F.concat(F.coalesce("_all", F.array().cast("array<bigint>")), "_runs"),
            "_names": F.array_union("_names", "_items"), "_longest": F.greatest("_longest", "_match"),
            "_n": F.col("_words"),
        }).drop(*_ADDED.names)
    leaks = F.struct(F.col("_n").alias("n_words"), F.col("_all").alias("ranges"), F.sort_array("_names").alias("items"), F.col("_longest").alias("longest"))
    return plain.select(*names, leaks.alias("leaks"))


def hit_words(ranges) -> F.Column:
    """Words in the union of ranges given as start, end pairs in any order."""
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), (F.size(ranges) / 2).cast("int") - 1), lambda i: F.struct(ranges[i * 2].alias("a"), ranges[i * 2 + 1].alias("b"))))

    def step(state, p):
        return F.struct(
            (state["n"] + F.greatest(p["b"] - F.greatest(p["a"], state["end"]), F.lit(0))).alias("n"), F.greatest(state["end"], p["b"]).alias("end")
        )

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.when(F.size(ranges) > 0, F.aggregate(pairs, zero, step)["n"]).otherwise(F.lit(0).cast("bigint"))
