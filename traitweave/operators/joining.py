"""Alignment, anti-joins and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import sequence_number


def align_outer(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Put k tables with different columns side by side on ``key``.

    Instead of k-1 outer joins the tables are stacked and grouped: one shuffle.
    Tables that share a column name are refused, and a key that a table has
    twice is an error when the result is computed: neither has one right value.
    """
    named = [c for df in dfs for c in df.columns if c != key]
    twice = sorted({c for c in named if named.count(c) > 1})
    if twice:
        raise ValueError(f"columns in several tables: {twice}")
    dfs = [df.withColumn("_table", F.lit(i)) for i, df in enumerate(dfs)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    # A table's number is a power of two: its bit is carried over if the table comes twice.
    bit = F.pow(F.lit(2), "_table").cast("bigint")
    once = F.sum(bit) == F.bit_or(bit)
    key_text = F.concat(F.lit("a table has this key twice: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    grouped = stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in named], once.alias("_once"))
    checked = F.when(F.col("_once"), F.lit(True)).otherwise(F.raise_error(key_text).cast("boolean"))
    return grouped.where(checked).select(key, *named)


def align_long(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """The same in long form: ``(key, feature, value)`` with the table's name
    in front of its columns. Needs no shuffle at all."""
    parts = []
    for name, df in tables.items():
        cols = [c for c in df.columns if c != key]
        part = df.select(key, *[F.col(c).cast("double").alias(f"{name}_{c}") for c in cols])
        parts.append(part.unpivot([key], [f"{name}_{c}" for c in cols], "feature", "value"))
    return stack_rows(*parts)


def attach_target(df: DataFrame, targets: DataFrame, name: str, key: str) -> DataFrame:
    """Left join one label column; keys without a label get 0."""
    label = targets.select(key, F.col(name).alias("_label"))
    joined = df.join(label, key, "left")
    return joined.withColumn(name, F.coalesce("_label", F.lit(0))).drop("_label")


def drop_features(long: DataFrame, names: DataFrame) -> DataFrame:
    """Remove the listed features; unknown names are ignored."""
    return long.join(names.select("feature").distinct(), "feature", "left_anti").select(*long.columns)


def missing_targets(expected: DataFrame, done: DataFrame, col: str = "target") -> DataFrame:
    """Expected targets that are not finished."""
    return expected.select(col).distinct().join(done.select(col).distinct(), col, "left_anti")


def completeness(expected: DataFrame, done: DataFrame, col: str = "target") -> DataFrame:
    """Numbers of distinct expected, finished and missing targets, in one row."""
    sides = expected.select(col, F.lit(1).alias("e"), F.lit(0).alias("d")).unionByName(
        done.select(col, F.lit(0).alias("e"), F.lit(1).alias("d"))
    )
    each = sides.groupBy(col).agg(F.max("e").alias("e"), F.max("d").alias("d"))
    return each.agg(
        F.count_if(F.col("e") == 1).alias("n_expected"),
        F.count_if(F.col("d") == 1).alias("n_done"),
        F.count_if((F.col("e") == 1) & (F.col("d") == 0)).alias("n_missing"),
    )


def minus_keys(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the sample."""
    return df.join(sample.select(key), key, "left_anti").select(*df.columns)


def expand_subexperiments(labels: DataFrame, substring_match: bool = False) -> DataFrame:
    """One sample sheet per control/test combination of every experiment.

    ``labels`` has ``Run``, ``Experiment`` and ``Control_test_label`` in
    ``control_k``, ``test_k``, ``test_k<letter>``. Sheets are named after the
    experiment, followed by the test number unless the experiment has only
    ``control_1`` and ``test_1``. Experiments with a label ending in ``a`` pair
    each control with every test of its number; the others pair ``control_k``
    with ``test_k``. ``substring_match`` also pairs control 1 with test 10 in
    the lettered case.
    """
    members = labels.withColumnsRenamed({"Run": "sample", "Control_test_label": "condition"})
    details = [c for c in members.columns if c != "Experiment"]
    members = members.withColumn("_side", F.substring_index("condition", "_", 1))
    conditions = members.select(
        "Experiment", "condition", "_side", F.substring_index("condition", "_", -1).alias("_tag")
    ).distinct()
    shape = conditions.groupBy("Experiment").agg(
        ((F.count(F.lit(1)) == 2) & (F.count_if(F.col("condition").isin("control_1", "test_1")) == 2)).alias("_plain"),
        F.bool_or(F.col("condition").endswith("a")).alias("_lettered"),
    )
    conditions = conditions.join(shape, "Experiment")
    number = F.array(F.regexp_extract("_tag", "^[0-9]+", 0))
    if substring_match:
        number = F.transform(F.sequence(F.lit(1), F.length("_tag")), lambda n: F.left(F.col("_tag"), n))
    tests = conditions.where("_side = 'test'").select(
        "Experiment",
        F.col("condition").alias("test"),
        F.col("_tag").alias("_ttag"),
        F.explode(F.when(F.col("_lettered"), number).otherwise(F.array("_tag"))).alias("_tag"),
    )
    controls = conditions.where("_side = 'control'").withColumnRenamed("condition", "control")
    # Pairs of distinct conditions: exactly one row per sheet.
    paired = controls.join(tests, ["Experiment", "_tag"], "left").where("not _lettered or test is not null")
    sheet = (
        F.when(F.col("_plain"), F.col("Experiment"))
        .when(F.col("_lettered"), F.concat_ws("_", "Experiment", "_ttag"))
        .otherwise(F.concat_ws("_", "Experiment", "_tag"))
    )
    wanted = paired.select(
        "Experiment", sheet.alias("sheet"), "control", F.explode(F.array("control", "test")).alias("condition")
    ).where(F.col("condition").isNotNull())
    sheets = wanted.join(members, ["Experiment", "condition"]).select("sheet", "control", "_side", *details)
    return sequence_number(sheets, ["_side", "sample"], ["sheet", "control"], start=1, name="row").drop("_side")


def category_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values that only one side has, with the side."""
    sides = a.select(col, F.lit("a").alias("side")).unionByName(b.select(col, F.lit("b").alias("side")))
    each = sides.groupBy(col).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return each.where(F.col("lo") == F.col("hi")).select(F.col(col).alias("value"), F.col("lo").alias("side"))


def stack_rows(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_values(df: DataFrame, cols: Sequence[str], name: str = "value") -> DataFrame:
    """Distinct values over several columns."""
    return df.select(F.explode(F.array(*cols)).alias(name)).distinct()


def reciprocal_pairs(long3: DataFrame, f1: str = "f1", f2: str = "f2", v: str = "v") -> DataFrame:
    """Pairs that occur in both directions, one row each with both values."""
    lo, hi = F.least(f1, f2), F.greatest(f1, f2)
    forward = F.col(f1) < F.col(f2)
    pairs = long3.where((F.col(f1) != F.col(f2)) & F.col(v).isNotNull())
    grouped = pairs.groupBy(lo.alias("f1"), hi.alias("f2")).agg(
        F.max(F.when(forward, F.col(v))).alias("v12"), F.max(F.when(~forward, F.col(v))).alias("v21")
    )
    return grouped.where(F.col("v12").isNotNull() & F.col("v21").isNotNull())
