"""Imputation, scaling, weights and vectors.

Statistics come from the training rows only and are applied to any rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import lookup_join
from ..plans.ordering import quantiles
from ..session import scratch
from .reshape import melt


def fit_median(long: DataFrame) -> DataFrame:
    """Exact median per feature: ``(feature, median)``."""
    return quantiles(long, ["feature"], "value", {"median": 0.5}).select("feature", "median")


def apply_median(long: DataFrame, medians: DataFrame) -> DataFrame:
    filled = lookup_join(long, medians, ["feature"])
    return filled.withColumn("value", F.coalesce("value", "median")).drop("median")


def fit_scaler(long: DataFrame) -> DataFrame:
    """Mean and population standard deviation per feature."""
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def apply_scaler(long: DataFrame, stats: DataFrame) -> DataFrame:
    """Centre and scale; a constant feature becomes 0."""
    joined = lookup_join(long, stats, ["feature"])
    scaled = F.when(F.col("std") == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("mean")) / F.col("std"))
    return joined.withColumn("value", F.when(F.col("value").isNotNull(), scaled)).drop("mean", "std")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(value: float) -> str:
    """A DOUBLE literal, also for values that have no digits."""
    return f"{value!r}D" if math.isfinite(value) else f"DOUBLE('{value!r}')"


class ColumnPreprocessor(Estimator):
    """Median and scaling for continuous columns, zero for categorical ones.

    Fitting keeps three numbers per column and returns a ``SQLTransformer``, so
    fitted pipelines are saved and loaded by MLlib itself. Meant for up to a few
    hundred columns; wider data goes through the long form.
    """

    def __init__(self, cont: Sequence[str], cat: Sequence[str]):
        super().__init__()
        self.cont, self.cat = list(cont), list(cat)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        exprs = ["*"]
        if self.cont:
            # Columns go by number, as their names may hold dots.
            numbered = [F.col(_quoted(c)).cast("double").alias(f"c{i}") for i, c in enumerate(self.cont)]
            long = melt(dataset.select(F.lit(0).alias("key"), *numbered), "key", [f"c{i}" for i in range(len(self.cont))])
            medians = {self.cont[int(r["feature"][1:])]: r["median"] for r in fit_median(long).collect()}
            filled = [F.coalesce(F.col(_quoted(c)).cast("double"), F.lit(medians.get(c, 0.0))) for c in self.cont]
            row = dataset.agg(
                *[F.avg(f).alias(f"m{i}") for i, f in enumerate(filled)],
                *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(filled)],
            ).first()
            for i, c in enumerate(self.cont):
                mean, std = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
                filled_sql = f"coalesce(CAST({_quoted(c)} AS DOUBLE), {_number(medians.get(c, 0.0))})"
                scaled = f"({filled_sql} - {_number(mean)}) / {_number(std)}" if std else "0.0D"
                exprs.append(f"{scaled} AS {_quoted('prep_' + c)}")
        exprs += [f"coalesce(CAST({_quoted(c)} AS DOUBLE), 0.0D) AS {_quoted('prep_' + c)}" for c in self.cat]
        return SQLTransformer(statement=f"SELECT {', '.join(exprs)} FROM __THIS__")


def preprocessor(cont: Sequence[str], cat: Sequence[str], estimator: Estimator | None = None) -> Pipeline:
    """Preprocessing into a ``features`` vector, followed by an estimator if given."""
    names = [f"prep_{c}" for c in [*cont, *cat]]
    stages = [ColumnPreprocessor(cont, cat), VectorAssembler(inputCols=names, outputCol="features")]
    return Pipeline(stages=stages + ([estimator] if estimator else []))


def with_balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weight n / (classes * n_y)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg(F.sum("n") / F.count(F.lit(1))).scalar()
    weights = counts.select(label, (share / F.col("n")).alias(name))
    return lookup_join(df, weights, [label])


def to_vectors(long: DataFrame, names: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """Sparse vectors ``(key, features)`` over the features ``names``.

    Cells that are zero or absent take no space. A NULL cell has no value to
    write and is an error: impute first (``apply_median``). The table is written to the
    shared folder in the layout of a vector column and read back as one, which
    needs no Python per row and also keeps the training data out of the lineage.
    ``rows`` (key, other columns) adds labels and keys without any non-zero cell.
    """
    spark = long.sparkSession
    index = spark.createDataFrame([(f, i) for i, f in enumerate(names)], "feature STRING, idx INT")
    message = F.concat(F.lit("NULL cell, impute first: "), F.col("feature"))
    present = F.when(F.col("value").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("value") != 0)
    cells = lookup_join(long.where(present), index, ["feature"], "inner")
    grouped = cells.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("v")))).alias("cells")
    )
    if rows is not None:
        grouped = rows.join(grouped, "key", "left")
    cells = F.coalesce(F.col("cells"), F.array().cast("array<struct<idx:int,v:double>>"))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(len(names)).alias("size"),
        F.transform(cells, lambda c: c["idx"]).alias("indices"),
        F.transform(cells, lambda c: c["v"]).alias("values"),
    )
    kept = [c for c in grouped.columns if c != "cells"]
    path = scratch(spark, "vectors")
    grouped.select(*kept, vector.alias("features")).write.parquet(path)
    schema = T.StructType([*[grouped.schema[c] for c in kept], T.StructField("features", VectorUDT())])
    return spark.read.schema(schema).parquet(path)
