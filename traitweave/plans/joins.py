"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

# Rows of a lookup table that may be sent to every executor.
BROADCAST_ROWS = 100_000


def broadcast_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast a table whose counted size allows it."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def _renamed(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.withColumnsRenamed({k: f"__{k}" for k in keys})


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left keys."""
    other = _renamed(right, keys)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys])
    return left.join(other, cond, how).drop(*[f"__{k}" for k in keys])


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Attach the columns of ``table`` (unique on ``keys``) to ``rows``.

    The table is written once and counted. Up to ``max_rows`` rows it is
    broadcast, so that rows with few distinct keys (two class labels, sixty
    features) are not shuffled onto a handful of tasks. Beyond that it is
    shuffled on the key, where AQE splits hot partitions of the row side.
    """
    table = checkpointed(table)
    if table.count() <= max_rows:
        table = F.broadcast(table)
    return null_safe_join(rows, table, keys, how)
