"""Order by md5 instead of a random generator.

md5 of ``seed|key`` gives every run, engine and retry the same order, so all
sampling is reproducible and can be checked in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join


def md5_of(seed, *cols: str | Column) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", head.cast("string"), *[p.cast("string") for p in parts]).cast("binary"))


def hash_int(seed, *cols: str | Column) -> Column:
    """The first 52 bits of the md5 as a BIGINT."""
    return F.conv(F.substring(md5_of(seed, *cols), 1, 13), 16, 10).cast("bigint")


def hash_unit(seed, *cols: str | Column) -> Column:
    """A number in [0, 1)."""
    return hash_int(seed, *cols) / F.lit(float(2**52))


def number_by_hash(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    seed,
    rank: str = "rank",
    total: str | None = None,
    limit: Column | None = None,
    digits: int = 3,
) -> DataFrame:
    """Number the rows of each group 1..n in md5 order.

    A group may hold most of the table, so it is never sorted as a whole: the
    leading hex digits of the md5 cut it into ``16**digits`` equal buckets, each
    bucket is numbered on its own, and the sizes of the buckets before it (a
    table of at most ``16**digits`` rows per group) are added. ``total`` names a
    column for the group size. ``limit`` keeps only ranks up to it and drops
    later buckets before the sort; it may use the ``total`` column.
    """
    by = list(by)
    cells = [*by, "_bucket"]
    rows = df.withColumn("_hash", md5_of(seed, *key)).withColumn("_bucket", F.substring("_hash", 1, digits))
    sizes = rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *cells,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(group).alias(total or "_total"),
    )
    placed = null_safe_join(rows, offsets, cells)
    if limit is not None:
        placed = placed.where(F.col("_before") < limit)
    local = F.row_number().over(Window.partitionBy(*cells).orderBy("_hash"))
    out = placed.withColumn(rank, F.col("_before") + local)
    if limit is not None:
        out = out.where(F.col(rank) <= limit)
    return out.drop("_hash", "_bucket", "_before", "_total")
