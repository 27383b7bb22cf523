"""Removal of repeated word passages by recompression.

Recompression rewrites a text in rounds: runs of one symbol become a symbol, then
neighbouring symbols ``x y`` with ``x`` on the left and ``y`` on the right side of
a coin toss per symbol become one. A symbol's name is a hash of what it stands
for, so it is the same in all texts without any exchange, and what a round does at
a place depends on the symbols next to it only. With every symbol goes its
*context*: the words that decided that it is there. A window of words whose
content is equal therefore holds the same symbols with their context inside the
window, at the same offsets. The longest of them is the window's *anchor*.

Spark rounds:

1. Every text lists its anchors; counting them over all texts reveals those that
   occur once. A window with such an anchor occurs once. The top-level name of
   the whole text reveals copies: only the first of equal texts goes on.
2. Texts that hold shared anchors hash the windows that have one; the first
   place of each window over all texts is found. That verifies the repeats.
3. A text's windows that are not the first of their content are removed.

All grouping is by sums and minima with a partial step before the shuffle; no
group is gathered, and no hot key is joined: what returns to a text is the list
of its own unique anchors and of its own first windows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, byte_table, discard, find_words, hash_rows, hash_runs, hash_words, mix, prepare, row_uid, stored, stored_by, text_slices

#: Words of a window; rounds of recompression.
WINDOW, ROUNDS = 20, 5

_INSIDE, _TO = byte_table(WHITE, lower=False)
_RUN, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)


def recompress(words: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS):
    """The symbols that each round makes: ``(names, first word, context first, context end)``, words first.

    Rows are kept apart by a border that no word equals and nothing merges with;
    a symbol next to a border has it in its context. Positions count the border
    in front of each row; in a round they all ascend.
    """
    n = len(bounds) - 1
    # Word i of row r stands at i + r + 1; borders stand in front of each row and at the end.
    at = np.arange(len(words)) + np.repeat(np.arange(1, n + 1), np.diff(bounds))
    total = len(words) + n + 1
    name = np.zeros(total, np.uint64)
    name[at] = words
    border = np.ones(total, bool)
    border[at] = False
    first = np.arange(total)
    left, right = first, first + 1
    levels = [(name[at], at, at, at + 1)]
    for k in range(rounds):
        # Runs: a maximal run of one word. That it ends, or that a word is no run, the word on each side decides. Later
        # runs stand for periods of several words; they are left to the windows, as each round of runs widens contexts.
        if k == 0:
            same = (name[1:] == name[:-1]) & ~border[1:] & ~border[:-1]
            head = np.flatnonzero(np.concatenate([[True], ~same]))
            length = np.diff(np.concatenate([head, [len(name)]]))
            last = first[head + length - 1]
            name, border, first = name[head], border[head], first[head]
            runs = np.flatnonzero(length > 1)
            name[runs] = mix(name[runs] * _RUN + length[runs].astype(np.uint64))
            left, right = first - 1, last + 2
        # Pairs: the coin of a symbol in this round says on which side it merges.
        coin = (mix(name + np.uint64((k + 1) * int(_PAIR) & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        opens = ~border & coin
        closes = ~border & ~coin
        pair = opens[:-1] & closes[1:]
        merged_left = np.concatenate([pair, [False]])
        merged_right = np.concatenate([[False], pair])
        # A symbol alone depends on the neighbour it did not merge with.
        new_left, new_right = left.copy(), right.copy()
        alone = np.flatnonzero(opens & ~merged_left)
        new_right[alone] = np.maximum(new_right[alone], right[alone + 1])
        alone = np.flatnonzero(closes & ~merged_right)
        new_left[alone] = np.minimum(new_left[alone], left[alone - 1])
        heads = np.flatnonzero(merged_left)
        name = name.copy()
        name[heads] = mix(mix(name[heads] * _PAIR) + name[heads + 1])
        new_right[heads] = np.maximum(right[heads], right[heads + 1])
        new_left[heads] = np.minimum(left[heads], left[heads + 1])
        stay = ~merged_right
        name, border, first, left, right = name[stay], border[stay], first[stay], new_left[stay], new_right[stay]
        made = np.flatnonzero(merged_left[stay])
        levels.append((name[made], first[made], left[made], right[made]))
    return levels


def anchors(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Per word position the anchor of the window that starts there, and where that anchor is (0 without a window).

    The anchor is a symbol of the highest round that has one with its context in
    the window, the first of them: a function of the window's content. Within a
    round contexts ascend at both ends, so the first symbol whose context begins
    in the window is the only one to look at.
    """
    n_words, n = len(words), len(bounds) - 1
    name, place = np.zeros(n_words, np.uint64), np.zeros(n_words, np.int64)
    row = np.repeat(np.arange(n), np.diff(bounds))
    open_words = np.flatnonzero(np.arange(n_words) <= bounds[1:][row] - window)
    for symbol, first, left, right in reversed(recompress(words, bounds)):
        if not len(symbol) or not len(open_words):
            continue
        at = open_words + row[open_words] + 1
        i = np.searchsorted(left, at)
        here = np.minimum(i, len(left) - 1)
        ok = (i < len(left)) & (right[here] <= at + window)
        found = open_words[ok]
        name[found], place[found] = symbol[here[ok]], first[here[ok]]
        open_words = open_words[~ok]
    return name, place


def _word_slices(texts: pa.Array):
    """Slices of rows: ``(bytes, row offsets, starts, ends, word bounds)``."""
    for _, data, offsets in text_slices(texts):
        yield data, offsets, *find_words(data, offsets, _INSIDE)


def _slices(texts: pa.Array):
    """The same with the words' hashes."""
    for data, offsets, starts, ends, bounds in _word_slices(texts):
        yield data, offsets, starts, ends, bounds, hash_words(data, starts, ends, _TO)


_PLACES = "uid bigint, doc_id bigint, key bigint, place int, spans binary"


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per text a row for its top-level name (place -1), and one per anchor occurrence.

    The text's row lists how many consecutive windows use each occurrence.
    """
    for batch in batches:
        row0 = 0
        for _, offsets, _, _, bounds, hashes in _slices(batch.column(2)):
            n = len(offsets) - 1
            key, place = anchors(hashes, bounds, window)
            rows, keys, places, spans = [np.arange(n)], [hash_rows(hashes, bounds)], [np.full(n, -1)], []
            for r in range(n):
                a, b = bounds[r], bounds[r + 1] - window + 1
                if a >= b:
                    spans.append(b"")
                    continue
                new = np.flatnonzero(np.concatenate([[True], (place[a + 1:b] != place[a:b - 1]) | (key[a + 1:b] != key[a:b - 1])]))
                rows.append(np.full(len(new), r))
                keys.append(key[a:b][new])
                places.append(np.arange(len(new)))
                spans.append(np.diff(np.concatenate([new, [b - a]])).astype(np.uint8).tobytes())
            at = pa.array(np.concatenate(rows) + row0)
            spans = pa.array(spans + [None] * (len(at) - n), pa.binary())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "key", "place", "spans"])
            row0 += n


_PARTS = "uid bigint, doc_id bigint, n_words bigint, whole string, text binary, windows array<int>, copy boolean"


def _candidate_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Texts with their candidate windows: those whose anchor is shared. A text without any is finished here."""
    for batch in batches:
        uid, ids, texts, unique, spans = (batch.column(i) for i in range(5))
        row0 = 0
        for data, offsets, _, _, bounds in _word_slices(texts):
            n = len(offsets) - 1
            out = []
            for r in range(n):
                lone = np.asarray(unique[row0 + r].values)
                size = int(bounds[r + 1] - bounds[r])
                copy = not (lone == -1).any()
                at = np.zeros(0, np.int64)
                if size >= window and not copy:
                    counts = np.frombuffer(spans[row0 + r].as_py(), dtype=np.uint8)
                    shared = np.ones(len(counts), bool)
                    shared[lone[lone >= 0]] = False
                    at = np.flatnonzero(np.repeat(shared, counts))
                copy = copy and size >= window
                whole = text = None
                if len(at):
                    text = data[offsets[r]:offsets[r + 1]].tobytes()
                elif not copy:
                    whole = _joined(data[offsets[r]:offsets[r + 1]].tobytes())
                out.append((size, whole, text, at.astype(np.int32), copy))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([uid.slice(row0, n), ids.slice(row0, n), *columns], names=["uid", "doc_id", "n_words", "whole", "text", "windows", "copy"])
            row0 += n


def _joined(text: bytes, gone: np.ndarray | None = None) -> str:
    """SHA-256 of the words joined by one space, without those marked; bytes split at exactly the separators of words."""
    kept = text.split()
    if gone is not None:
        kept = itertools.compress(kept, (~gone).tolist())
    return hashlib.sha256(b" ".join(kept)).hexdigest()


_WINDOWS = "uid bigint, doc_id bigint, hash bigint, at int"


def _window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        uid, ids, texts, windows = (batch.column(i) for i in range(4))
        row0 = 0
        for _, offsets, _, _, bounds, hashes in _slices(texts):
            runs = hash_runs(hashes, window)
            for r in range(len(offsets) - 1):
                at = np.asarray(windows[row0 + r].values)
                many = pa.array(np.full(len(at), row0 + r))
                yield pa.RecordBatch.from_arrays(
                    [uid.take(many), ids.take(many), pa.array(runs[bounds[r] + at].view(np.int64)), pa.array(at, pa.int32())], names=["uid", "doc_id", "hash", "at"]
                )
            row0 += len(offsets) - 1


def _removed_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Remove the words of candidate windows that are not the first of their content."""
    for batch in batches:
        texts, windows, firsts = (batch.column(i) for i in (2, 3, 4))
        removed, ranges, digest = [], [], []
        row0 = 0
        for data, offsets, _, _, bounds in _word_slices(texts):
            for r in range(len(offsets) - 1):
                at, first = windows[row0 + r], firsts[row0 + r]
                at = np.asarray(at.values)
                first = np.asarray(first.values) if first.is_valid else np.zeros(0, np.int32)
                again = np.setdiff1d(at, first)
                mark = np.zeros(int(bounds[r + 1] - bounds[r]) + 1, np.int64)
                np.add.at(mark, again, 1)
                np.add.at(mark, again + window, -1)
                gone = np.cumsum(mark)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                removed.append(int(gone.sum()))
                ranges.append(edge.tolist())
                digest.append(_joined(data[offsets[r]:offsets[r + 1]].tobytes(), gone))
            row0 += len(offsets) - 1
        added = [pa.array(removed, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), *added], names=["uid", "doc_id", "n_words", "n_removed", "ranges", "kept_sha256"])


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(uid, doc_id, n_words, n_removed, ranges, kept_sha256)`` per row of ``docs``.

    A word goes if a window over it has a word sequence that starts earlier: in
    a row with a smaller id (NULL first), or earlier in the same row. ``ranges``
    are the removed word ranges as start, end pairs (NULL for a whole copy, which
    is removed in full). Rows that agree in id and text are one document;
    rows that share an id but not the text are ordered by ``uid``, which is
    ``row_uid(id, text)``. NULL counts as a text without words.
    """
    if not 1 < window < 256:
        raise ValueError("a window has 2 to 255 words")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select(row_uid(F.col("doc_id"), F.col("text")).alias("uid"), "doc_id", "text")
    found = stored(rows.mapInArrow(lambda b: _anchor_rows(b, window), _PLACES), "anchors")
    # What occurs once belongs to the text that the minimum names; of equal texts the first goes on.
    lone = found.where("place >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid"), F.min("place").alias("place"))
    order = F.struct(F.isnotnull("doc_id").alias("given"), "doc_id", "uid")
    first = found.where("place < 0").groupBy("key").agg(F.min(order).alias("o"))
    none = F.lit(None).cast("binary").alias("spans")
    back = lone.where("c = 1").select("uid", "place", none)
    back = back.unionByName(first.select("o.uid", F.lit(-1).alias("place"), none))
    back = back.unionByName(found.where("place < 0").select("uid", F.lit(None).cast("int").alias("place"), "spans"))
    # Places of one text come from everywhere: they are brought together before they are listed.
    own = back.repartition("uid").groupBy("uid").agg(F.collect_list("place").alias("places"), F.max("spans").alias("spans"))
    once = rows.join(own, "uid").select("uid", "doc_id", "text", "places", "spans")
    parts = stored_by(once.mapInArrow(lambda b: _candidate_rows(b, window), _PARTS), "parts", "uid")
    discard(found)
    open_parts = parts.where(F.size("windows") > 0)
    windows = open_parts.select("uid", "doc_id", "text", "windows").mapInArrow(lambda b: _window_rows(b, window), _WINDOWS)
    order = F.struct(F.isnotnull("doc_id").alias("given"), "doc_id", "uid", "at")
    firsts = windows.groupBy("hash").agg(F.min(order).alias("o")).select("o.uid", "o.at").groupBy("uid").agg(F.collect_list("at").alias("firsts"))
    mended = open_parts.join(firsts, "uid", "left").select("uid", "doc_id", "text", "windows", "firsts", "n_words")
    kinds = "uid bigint, doc_id bigint, n_words bigint, n_removed bigint, ranges array<int>, kept_sha256 string"
    mended = mended.mapInArrow(lambda b: _removed_rows(b, window), kinds)
    nothing = hashlib.sha256(b"").hexdigest()
    others = parts.where(F.size("windows") == 0).select(
        "uid", "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(~F.col("copy"), F.array().cast("array<int>")).alias("ranges"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.col("whole")).alias("kept_sha256"),
    )
    return mended.unionByName(others)
