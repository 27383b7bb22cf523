"""Splits, balancing, folds and shuffles, all in md5 order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hashing import hash_int, hash_unit, md5_of, number_by_hash
from ..plans.joins import broadcast_small
from .neighbours import nearest

#: Rows of a bucket in which a feature is shuffled.
BUCKET_ROWS = 50_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _marked(df: DataFrame, by: list[str], key, seed, wanted, name: str = "part") -> DataFrame:
    numbered = number_by_hash(df, by, _keys(key), seed, "_rank", "_n")
    return numbered.withColumn(name, F.when(F.col("_rank") <= wanted, "test").otherwise("train")).drop("_rank", "_n")


def stratified_holdout(df: DataFrame, label: str, key, frac: float, seed) -> DataFrame:
    """Adds ``part``: ``test`` for the fraction ``frac`` of every class, else ``train``."""
    return _marked(df, [label], key, seed, F.round(F.col("_n") * F.lit(frac)))


def holdout(df: DataFrame, key, frac: float, seed) -> DataFrame:
    """The same without strata; the test size is rounded up."""
    return _marked(df, [], key, seed, F.ceil(F.col("_n") * F.lit(frac)))


def holdout_n_per_class(df: DataFrame, label: str, key, n: int | None, seed, positive=1) -> DataFrame:
    """``n`` test rows from each class; by default a tenth of the positives, rounded down."""
    wanted = F.lit(n)
    if n is None:
        wanted = F.floor(df.where(F.col(label) == F.lit(positive)).agg(F.count(F.lit(1))).scalar() / 10)
    return _marked(df, [label], key, seed, wanted)


def undersample(df: DataFrame, label: str, key, seed, n: int | None = None) -> DataFrame:
    """Cut every class to the size of the smallest one, or to ``n`` rows."""
    smallest = F.lit(n)
    if n is None:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        smallest = counts.agg(F.min("n")).scalar()
    return number_by_hash(df, [label], _keys(key), seed, "_rank", limit=smallest).drop("_rank")


def oversample(df: DataFrame, label: str, key, minority, n: int, seed) -> DataFrame:
    """Replace the minority rows by ``n`` draws with replacement."""
    few = df.where(F.col(label) == F.lit(minority))
    size = few.count()
    pool = number_by_hash(few, [], _keys(key), seed, "_rank")
    draws = df.sparkSession.range(n).select((hash_int(seed, "id") % size + 1).alias("_rank"))
    drawn = draws.join(broadcast_small(pool, size), "_rank").select(*df.columns)
    return df.where(~F.col(label).eqNullSafe(F.lit(minority))).unionByName(drawn)


def with_folds(df: DataFrame, label: str, key, k: int, seed, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 so that every class is spread evenly."""
    numbered = number_by_hash(df, [label], _keys(key), seed, "_rank")
    return numbered.withColumn(name, F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank")


def bucket_digits(rows: int) -> int:
    """``digits`` of ``shuffle_features`` for features of so many rows: no more buckets than keep a task's sort small, or their sizes outgrow the rows."""
    return min(3, max(0, (rows // BUCKET_ROWS).bit_length() + 3 >> 2))


def shuffle_features(long: DataFrame, seed, rounds: int = 1, digits: int = 3) -> DataFrame:
    """Permute the values of every feature on its own.

    Needs all cells of the matrix, zeros included. Two independent md5 orders
    number the cells of a feature; the value at place i of the second goes to
    the key at place i of the first. Shuffling again gives just another uniform
    permutation, so ``rounds`` only selects which one. ``digits`` are those of
    ``number_by_hash``: the numbers are the same, many small features need few.
    """
    keys = number_by_hash(long.select("key", "feature"), ["feature"], ["feature", "key"], f"{seed}:k", "_rank", digits=digits)
    values = number_by_hash(long, ["feature"], ["feature", "key"], f"{seed}:{rounds}", "_rank", digits=digits)
    return keys.join(values.drop("key"), ["feature", "_rank"]).select("key", "feature", "value")


def random_features(long: DataFrame, n: int, draws: int, seed) -> DataFrame:
    """``(draw, feature)``: ``n`` random features, drawn ``draws`` times."""
    names = long.select("feature").distinct()
    each = names.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    return number_by_hash(each, ["draw"], ["draw", "feature"], seed, "_rank", limit=F.lit(n)).select("draw", "feature")


def shuffle_rows(df: DataFrame, key, seed) -> DataFrame:
    return df.orderBy(md5_of(seed, *_keys(key)))


def smote_nc(
    df: DataFrame, label: str, key: str, cont: Sequence[str], cat: Sequence[str], k: int = 5, seed=42, minority=1
) -> DataFrame:
    """Add synthetic minority rows until the minority is as large as the rest.

    Each synthetic row takes a minority row and one of its ``k`` nearest
    minority neighbours: continuous columns lie between the two, categorical
    columns are the most frequent value among the neighbours (ties: smallest).
    A differing category counts as far as the median standard deviation of the
    continuous columns. Adds ``synthetic``; synthetic keys are ``syn_<i>``.
    """
    cont, cat = list(cont), list(cat)
    pool = df.where(F.col(label) == F.lit(minority)).withColumn(key, F.col(key).cast("string"))
    # One driver-side row of |cont| numbers.
    spread = pool.agg(*[F.stddev_pop(c).alias(c) for c in cont]).first() if cont else []
    spread = sorted(v or 0.0 for v in spread)
    half = len(spread) // 2
    # Without continuous columns only unlike categories count, each as 1.
    cost = 1.0 if not spread else spread[half] if len(spread) % 2 else (spread[half - 1] + spread[half]) / 2
    # Categories as coordinates: two different ones are exactly `cost` apart.
    coords = [F.col(c).cast("double") for c in cont]
    marks = F.array(*[F.concat_ws("=", F.lit(c), F.col(c).cast("string")) for c in cat]) if cat else None
    rows = pool.select(F.col(key).alias("id"), F.array(*coords).cast("array<double>").alias("vec"), *([marks.alias("marks")] if cat else []))
    near = nearest(rows, rows, k=k, exclude_self=True, mark_cost=cost)
    picked = near.select(F.col("query").alias(key), F.col("id").alias("_other"), F.col("place"))
    neighbours = picked.join(
        pool.select(F.col(key).alias("_other"), *[F.col(c).alias(f"_o_{c}") for c in [*cont, *cat]]), "_other"
    )
    modes = neighbours.groupBy(key).agg(
        F.max("place").alias("_k"),
        *[F.mode(F.col(f"_o_{c}"), True).alias(f"_m_{c}") for c in cat],
    )
    counts = df.agg(
        F.count_if(F.col(label) == F.lit(minority)).alias("few"),
        F.count_if(~F.col(label).eqNullSafe(F.lit(minority))).alias("many"),
    ).first()
    few, missing = counts["few"], max(counts["many"] - counts["few"], 0)
    base = number_by_hash(pool, [], [key], seed, "_rank").join(modes, key)
    draws = df.sparkSession.range(missing).select(
        F.col("id").alias("_draw"),
        (hash_int(f"{seed}:base", "id") % few + 1).alias("_rank"),
        hash_int(f"{seed}:pick", "id").alias("_pick"),
        hash_unit(f"{seed}:gap", "id").alias("_gap"),
    )
    made = draws.join(broadcast_small(base, few), "_rank").withColumn("place", (F.col("_pick") % F.col("_k") + 1).cast("int"))
    ends = neighbours.select(key, "place", *[f"_o_{c}" for c in cont])
    made = made.join(broadcast_small(ends, few * k), [key, "place"])
    values = {c: F.col(c) + F.col("_gap") * (F.col(f"_o_{c}") - F.col(c)) for c in cont}
    values |= {c: F.col(f"_m_{c}") for c in cat}
    synthetic = made.select(
        F.concat(F.lit("syn_"), F.col("_draw").cast("string")).alias(key),
        F.col(label),
        *[values[c].cast(df.schema[c].dataType).alias(c) for c in [*cont, *cat]],
        F.lit(True).alias("synthetic"),
    )
    original = df.select(F.col(key).cast("string").alias(key), label, *cont, *cat, F.lit(False).alias("synthetic"))
    return original.unionByName(synthetic)

