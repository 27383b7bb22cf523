"""Result tables and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import safe_name


def write_results(df: DataFrame, path: str, target: str = "target") -> None:
    """One table for all targets, partitioned by the file-safe target name.

    A target that is written again replaces what it had; other targets stay.
    Rebalancing on the target first gives few files per target, while AQE still
    splits a target that is too large for one task.
    """
    named = df.withColumn(target, safe_name(target)).hint("rebalance", target)
    named.write.partitionBy(target).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Save a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
