"""Compressed sequence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# The species is the file name up to its first dot.
BEFORE_DOT = r"([^/.]*)[^/]*$"


def clean_sequences(spark: SparkSession, glob: str, species: str = BEFORE_DOT) -> DataFrame:
    """``(species, value)``: the lines of all files without ``*``; ``species`` is a
    pattern on the path. Write it with ``partitionBy('species')``."""
    lines = spark.read.text(glob)
    return lines.select(
        F.regexp_extract(F.col("_metadata.file_path"), species, 1).alias("species"),
        F.replace("value", F.lit("*"), F.lit("")).alias("value"),
    )
