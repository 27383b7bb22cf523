"""Ontology files in OBO format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_obo_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(child, parent)`` for every is_a line of the term stanzas."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.trim("value").alias("value"))
    terms = blocks.where(F.ltrim(F.col("value")).startswith("[Term]"))
    parents = F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))
    return terms.select(
        F.regexp_extract("value", r"(?m)^id: (\S+)", 1).alias("child"), F.explode(parents).alias("parent")
    )
