"""Minimax contiguous sharding: equal texts stay together, sizes are as even as can be.

Groups of equal texts are the atoms, ordered by the md5 of the text. The
smallest feasible shard capacity is found by binary search, each candidate is
checked greedily, and the shards are cut there. The check reads prefix sums of
group sizes from a summary by md5 prefix, which Spark aggregates and the driver
holds: where a cut may fall inside a prefix whose groups are not known yet, only
that prefix is aggregated again at the next digits. The driver's part is bounded
by shards x 16^DIGITS rows, whatever the table.

A group larger than an even share would set the capacity for all shards. Such
groups (fewer than there are shards) get a shard of their own first, and the
rest is cut into the remaining shards.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

#: Hex digits by which a prefix is refined at a time.
DIGITS = 3
_WHOLE = 32


class PrefixSums:
    """Group sizes in md5 order, known down to as many digits as a question needed."""

    def __init__(self, groups: DataFrame, skip: list[str]):
        #: rows (key, bytes); ``skip`` are groups that are placed already.
        self.groups = groups.where(~F.col("key").isin(skip)) if skip else groups
        self.keys: list[str] = []
        self.sizes: list[int] = []
        self._add(self.groups, DIGITS)
        self._sum()

    def _add(self, rows: DataFrame, digits: int) -> None:
        found = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes").alias("n"), F.count(F.lit(1)).alias("g"), F.min("key").alias("k"))
        for r in found.collect():
            # A prefix with one group is known in full.
            self.keys.append(r.k if r.g == 1 else r.p)
            self.sizes.append(r.n)

    def _sum(self) -> None:
        order = sorted(range(len(self.keys)), key=self.keys.__getitem__)
        self.keys = [self.keys[i] for i in order]
        self.sizes = [self.sizes[i] for i in order]
        self.before = [0]
        for n in self.sizes:
            self.before.append(self.before[-1] + n)

    @property
    def total(self) -> int:
        return self.before[-1]

    def refine(self, cells: set[int]) -> None:
        """Replace prefixes by what is below them."""
        open_cells = sorted({self.keys[i] for i in cells})
        for digits in sorted({len(p) for p in open_cells}):
            these = [p for p in open_cells if len(p) == digits]
            rows = self.groups.where(F.substring("key", 1, digits).isin(these))
            at = [i for i, k in enumerate(self.keys) if k in set(these)]
            for i in reversed(at):
                del self.keys[i], self.sizes[i]
            self._add(rows, min(_WHOLE, digits + DIGITS))
        self._sum()

    def _known(self, i: int) -> bool:
        return len(self.keys[i]) == _WHOLE

    def lower(self, capacity: int, shards: int) -> tuple[bool, list[int]]:
        """Fill shards and cut before a prefix that is not known: ``(do all fit, first cell of each next shard)``.

        No cut lies beyond the greedy one, so what fits here fits.
        """
        at, cuts = 0, []
        for _ in range(shards):
            end = bisect.bisect_right(self.before, self.before[at] + capacity) - 1
            if end >= len(self.keys):
                return True, cuts
            if end == at:
                return False, [*cuts, end]
            cuts.append(end)
            at = end
        return False, cuts

    def upper(self, capacity: int, shards: int) -> tuple[bool, list[int]]:
        """As ``lower``, but cut inside a prefix that is not known; what does not fit here does not fit."""
        at, cuts = 0, []
        for _ in range(shards):
            x = at + capacity
            end = bisect.bisect_right(self.before, x) - 1
            if end >= len(self.keys):
                return True, cuts
            cuts.append(end)
            x = self.before[end] if self._known(end) else x
            if x == at:
                return False, cuts
            at = x
        return False, cuts

    def unsure(self, lo: int, hi: int, shards: int) -> set[int]:
        """Unknown prefixes in which a cut may fall for capacities between ``lo`` and ``hi``."""
        wide = {i for a, b in zip(self.lower(lo, shards)[1], self.upper(hi, shards)[1]) for i in range(a, b + 1)}
        if len(wide) > 32 * shards:
            wide = {*self.lower(lo, shards)[1], *self.upper(lo, shards)[1]}
        return {i for i in wide if not self._known(i)}


def minimax_cuts(groups: DataFrame, shards: int, skip: list[str] | None = None) -> tuple[int, list[str]]:
    """Smallest capacity and the first key of each shard but the first, for rows ``(key, bytes)`` with unique md5 keys."""
    sums = PrefixSums(groups, skip or [])
    lo, hi = -(-sums.total // shards), sums.total
    if not sums.total:
        return 0, []
    while lo < hi:
        capacity = (lo + hi) // 2
        if sums.lower(capacity, shards)[0]:
            hi = capacity
        elif not sums.upper(capacity, shards)[0]:
            lo = capacity + 1
        else:
            sums.refine(sums.unsure(lo, hi, shards) or sums.unsure(capacity, capacity, shards))
    # The greedy cuts at that capacity, which need the groups around each cut.
    while unknown := {i for i in sums.lower(lo, shards)[1] if not sums._known(i)}:
        sums.refine(unknown)
    return lo, [sums.keys[i] for i in sums.lower(lo, shards)[1]]


def shard_of(groups: DataFrame, shards: int, key: str) -> Column:
    """The shard (0-based) of the md5 in column ``key``; ``groups`` as for ``minimax_cuts``."""
    # Only the largest groups can exceed an even share: fewer of them than shards.
    largest = [(r.key, r.bytes) for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()]
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[str] = []
    for k, n in largest:
        left = shards - len(alone)
        if left < 2 or n * left <= total:
            break
        alone.append(k)
        total -= n
    _, starts = minimax_cuts(groups, shards - len(alone), alone)
    place = F.lit(len(alone))
    for s in starts:
        place = place + (F.col(key) >= F.lit(s)).cast("int")
    for i, k in enumerate(alone):
        place = F.when(F.col(key) == F.lit(k), F.lit(i)).otherwise(place)
    return place.cast("int")


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` per row; with ``keep`` also a struct ``row`` of all columns of ``docs``.

    Size is the UTF-8 length of the text (NULL: none) plus 1. A NULL text is
    the same group as an empty one. Slots count from 0 without a gap in the
    order of the id's md5, a shuffle within the shard that a rerun repeats;
    repeated rows take neighbouring slots. Rows are numbered in cells of one
    shard and three hex digits, and the cells' sizes are added up.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    columns = [
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"),
        F.md5(named.cast("binary")).alias("_order"),
    ]
    keys = stored(docs.select(*columns), "keys")
    groups = stored(keys.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    shard, cell = shard_of(groups, shards, "key"), F.substring("_order", 1, DIGITS)
    sizes = keys.groupBy(shard.alias("shard"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = docs.select(*columns, F.struct(*docs.columns).alias("row")) if keep else keys
    placed = rows.withColumns({"shard": shard, "_cell": cell}).join(sizes, ["shard", "_cell"])
    number = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_order", "id", "key"))
    slot = (F.col("_before") + number - 1).cast("bigint")
    return placed.select("id", "size", "text_crc32", "shard", slot.alias("slot"), *(["row"] if keep else []))
