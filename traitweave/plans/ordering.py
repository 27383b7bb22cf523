"""Cumulative sums, ranks, quantiles and sequence numbers over value order.

A window without partitions, or over a group that holds a third of the table,
sorts everything in one task. The helpers here look at the largest group first.
Groups up to ``MAX_GROUP_ROWS`` use an ordinary window. Larger ones are reduced
to one row per distinct value (ties collapse before the shuffle), range
partitioned, written once so that the partition numbers are stable, summed per
partition and then offset by the sums of the partitions before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .joins import null_safe_join

MAX_GROUP_ROWS = 2_000_000
CHUNK_ROWS = 1_000_000
# Rows that a task sorts for a window, where they have been counted.
TASK_ROWS = 1_000_000
# The exact percentile aggregate keeps a map of a group's values, so it gives
# way to running sums earlier than a window does.
QUANTILE_GROUP_ROWS = 200_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; one small aggregate over the key columns."""
    if not by:
        return df.count()
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _is_large(df: DataFrame, by: Sequence[str], large: bool | None, limit: int = MAX_GROUP_ROWS) -> bool:
    return largest_group(df, by) > limit if large is None else large


def _directed(col: str, descending: bool) -> Column:
    return F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    measures: dict[str, Column],
    descending: bool | Sequence[str] = False,
    large: bool | None = None,
) -> DataFrame:
    """One row per distinct ``order`` value of each group, with for each measure
    ``m`` its aggregate ``m``, the inclusive running sum ``cum_m`` and the group
    sum ``total_m``. ``descending`` may name the columns that go downwards.
    """
    by, order = list(by), list(order)
    names = list(measures)
    large = _is_large(df, by, large)
    steps = df.groupBy(*by, *order).agg(*[c.alias(m) for m, c in measures.items()])
    down = set(descending) if not isinstance(descending, bool) else set(order) if descending else set()
    ordered = [_directed(c, c in down) for c in order]
    cells = list(by)
    if large:
        steps = steps.repartitionByRange(*[F.col(c) for c in by], *ordered)
        steps = checkpointed(steps.withColumn("_slice", F.spark_partition_id()))
        cells = [*by, "_slice"]
    upto = Window.partitionBy(*cells).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select("*", *[F.sum(m).over(upto).alias(f"cum_{m}") for m in names])
    group = Window.partitionBy(*by)
    if not large:
        return local.select("*", *[F.sum(m).over(group).alias(f"total_{m}") for m in names])
    # at most one row per group and slice
    sums = steps.groupBy(*cells).agg(*[F.sum(m).alias(m) for m in names])
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *cells,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_before_{m}") for m in names],
        *[F.sum(m).over(group).alias(f"total_{m}") for m in names],
    )
    joined = null_safe_join(local, offsets, cells)
    return joined.select(
        *by, *order, *names,
        *[(F.col(f"cum_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in names],
        *[f"total_{m}" for m in names],
    )


def average_rank(
    df: DataFrame, by: Sequence[str], col: str, name: str = "rank", descending: bool = True, large: bool | None = None
) -> DataFrame:
    """Rank within ``by``; ties share the mean of their ranks, NULL has none."""
    by = list(by)
    n = 0
    if large is None and by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        large, n = (sizes[0] or 0) > MAX_GROUP_ROWS, sizes[1] or 0
    if not _is_large(df, by, large):
        if n > TASK_ROWS:
            # The session's number of partitions does not grow with the rows.
            df = df.repartition(max(-(-n // TASK_ROWS) * 2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
        ordered = Window.partitionBy(*by).orderBy(_directed(col, descending))
        first = F.rank().over(ordered)
        # The frame of equal values: ranks and ties come from one sort.
        ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
        return df.withColumn(name, F.when(F.col(col).isNotNull(), first + (ties - 1) / F.lit(2.0)))
    steps = running_sums(
        df.where(F.col(col).isNotNull()), by, [col], {"_n": F.count(F.lit(1))}, descending, large=True
    )
    ranks = steps.select(*by, col, (F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / F.lit(2.0)).alias(name))
    return null_safe_join(df, ranks, [*by, col], "left")


def quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: dict[str, float], large: bool | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, NULLs ignored.

    ``weight`` names a column that says how many times a row counts.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    by = list(by)
    present = df.where(F.col(col).isNotNull())
    if not _is_large(present, by, large, QUANTILE_GROUP_ROWS):
        found = present.groupBy(*by).agg(
            F.percentile(
                col, F.array(*[F.lit(p) for p in probs.values()]), F.col(weight) if weight else F.lit(1)
            ).alias("_q"),
            size.alias("n"),
        )
        return found.select(*by, "n", *[F.col("_q")[i].alias(m) for i, m in enumerate(probs)])
    steps = running_sums(present, by, [col], {"_n": size}, large=True)
    upper, lower, size = F.col("cum__n"), F.col("cum__n") - F.col("_n"), F.col("total__n")
    picks = []
    for name, p in probs.items():
        place = (size - 1) * F.lit(p)
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picks.append(F.max(F.when((lower <= at) & (at < upper), F.col(col))).alias(f"_{side}_{name}"))
    found = steps.groupBy(*by).agg(F.max("total__n").alias("n"), *picks)
    out = []
    for name, p in probs.items():
        place = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*by, "n", *out)


def sequence_number(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    start: int = 0,
    name: str = "seq",
    descending: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Consecutive numbers in sorted order, over the table or within groups.

    Remaining columns break ties, NULLs last, so the result is the same on every
    run and for groups of every size. In
    large groups equal rows are counted, numbered as one block and expanded
    again in chunks.
    """
    by, order = list(by), list(order)
    rest = [c for c in df.columns if c not in by and c not in order]
    if not _is_large(df, by, large):
        keys = [_directed(c, descending) for c in order] + [_directed(c, False) for c in rest]
        numbered = F.row_number().over(Window.partitionBy(*by).orderBy(*keys))
        return df.withColumn(name, (numbered - 1 + start).cast("bigint"))
    down = order if descending else []
    steps = running_sums(df, by, [*order, *rest], {"_n": F.count(F.lit(1))}, down, large=True)
    first = F.col("cum__n") - F.col("_n")
    chunk = F.explode(F.sequence(first, F.col("cum__n") - 1, F.lit(CHUNK_ROWS)))
    blocks = steps.withColumn("_first", chunk)
    blocks = blocks.repartition(F.col("_first"), *[F.col(c) for c in order])
    last = F.least(F.col("_first") + CHUNK_ROWS, F.col("cum__n")) - 1
    return blocks.select(*df.columns, F.explode(F.sequence(F.col("_first") + start, last + start)).alias(name))
