"""Mutual-rank network of feature importances, ranks, sorts and top-k."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import average_rank, running_sums, sequence_number
from .reshape import zero_to_null


def rank_desc_average(
    df: DataFrame, by: str | Sequence[str], col: str, name: str = "rank", large: bool | None = None
) -> DataFrame:
    """Descending rank within ``by``; ties share their mean rank, NULL has none.

    ``large`` says whether a group may be too big for one task; when it is not
    given, the largest group is counted first.
    """
    by = [by] if isinstance(by, str) else list(by)
    return average_rank(df, by, col, name, large=large)


def _pair_mean(cells: DataFrame, value: str, name: str) -> DataFrame:
    """Geometric mean over both directions of each unordered pair.

    Min and max are the two values whatever their order, and the square root of
    their product is exact for zeros, where a mean of logarithms is not.
    """
    cells = cells.where((F.col("f1") != F.col("f2")) & F.col(value).isNotNull())
    return (
        cells.groupBy(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sqrt(F.min(value).cast("double") * F.max(value).cast("double")).alias(name),
        )
        .where("_n = 2")
        .drop("_n")
    )


def mutual_rank(ranks: DataFrame) -> DataFrame:
    """``(f1, f2, rank)`` to ``(f1, f2, MR)``; one-way and self pairs vanish."""
    return _pair_mean(ranks, "rank", "MR")


def mutual_rank_nonzero(importances: DataFrame, large: bool | None = None) -> DataFrame:
    """Importances ``(f1 feature, f2 target, v)`` to mutual ranks without zeros.

    The zeros, nearly all cells of an importance matrix, are filtered before
    the rank shuffle: an absent row has no rank, just as a NULL one.
    """
    present = zero_to_null(importances, "v").where(F.col("v").isNotNull())
    return mutual_rank(rank_desc_average(present, "f2", "v", large=large))


def geometric_mean_importance(importances: DataFrame) -> DataFrame:
    """Geometric mean of both importances per pair, zeros included."""
    return _pair_mean(importances, "v", "GFI")


def filter_by_score(importances: DataFrame, scores: DataFrame, min_score: float = 0.4) -> DataFrame:
    """Importances of the targets whose model scored at least ``min_score``."""
    good = scores.where(F.col("score") >= min_score).select(F.col("target").alias("f2")).distinct()
    return importances.join(good, "f2", "left_semi").select(*importances.columns)


def with_sequence(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (), start: int = 0, name: str = "seq"
) -> DataFrame:
    return sequence_number(df, order, by, start, name)


def cumulative_share(df: DataFrame, size: str) -> DataFrame:
    """Per distinct size, largest first: groups and members so far, and their share."""
    steps = running_sums(
        df, [], [size],
        {"groups": F.count(F.lit(1)), "members": F.sum(F.col(size))},
        descending=True,
    )
    return steps.select(
        size, "groups", "members", "cum_groups", "cum_members", "total_members",
        (F.col("cum_members") / F.col("total_members")).alias("share"),
    )


def sort_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("MR", "f1", "f2")


def runs_by_reads(runs: DataFrame) -> DataFrame:
    return runs.orderBy("n_processed", "run")


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The ``k`` most important features; a report, so the limit is the feature."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(k)


def ranked_importance(importance: DataFrame, model_col: str) -> DataFrame:
    """Position 1..n of every feature within its model, most important first."""
    return sequence_number(
        importance, ["importance"], [model_col], start=1, name="position", descending=True
    )


def top_percent(df: DataFrame, col: str, pct: float) -> DataFrame:
    """Rows with percent rank up to ``pct`` by ascending ``col``; ties stay together."""
    present = df.where(F.col(col).isNotNull())
    steps = running_sums(present, [], [col], {"n": F.count(F.lit(1))})
    before = F.col("cum_n") - F.col("n")
    within = before <= (F.col("total_n") - 1) * F.lit(pct / 100)
    cut = steps.where(within).agg(F.max(col)).scalar()
    return present.where(F.col(col) <= cut)


def top_count(n_rows: int, pct: float) -> int:
    """Rows in the top ``pct`` percent, rounded up."""
    return math.ceil(n_rows * pct / 100)
