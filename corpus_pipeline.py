"""From raw documents to training shards: language, copies, leaks, mixture, shards.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``
and returns the documents that go on, with the columns of ``docs``, whatever their
names; the last one adds ``shard`` and ``slot`` (with underscores in front if the
documents have such columns). Between stages the documents are written and read.

A document is a row. NULL and empty texts have no language and go in the first
stage, so later ones meet them only when they are run on their own: there they are
near copies of nothing, hold no benchmark item, weigh nothing and have a place in
a shard. NULLs in other columns are kept; a NULL source is a source, a NULL id the
largest one among near copies. Rows that agree in id and text are one document,
and one of them stays. Empty tables give empty tables.

Near copies are texts whose sets of five-word shingles agree to 80 % or more: the
default for near duplicates here, while the query ``op6`` has its own rule of four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitweave.llm import decontaminate, language_id, mixing, near_dedup, sharding
from traitweave.llm.common import row_uid, stored
from traitweave.llm.queries import SHARDS, WEIGHTS

#: Words of a shingle and least similarity in percent of near copies.
SHINGLE_WORDS, SIMILARITY = 5, 80


def _unused(name: str, docs: DataFrame) -> str:
    """``name`` with as many underscores in front as it needs to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _rows(docs: DataFrame) -> DataFrame:
    """The columns that the operators look at, and the whole row beside them."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts whose language cannot be told."""
    model = language_id.train_language_id(docs)
    return docs.where(language_id.predict_language(F.col("text"), model)["accepted"])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies only the document that names the group stays."""
    found = near_dedup.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILARITY)
    keepers = found.where(F.col("id").eqNullSafe(F.col("component"))).select("uid")
    rows = _rows(docs).withColumn("uid", row_uid(F.col("doc_id").cast("bigint"), F.col("text")))
    # Repeated rows share the key, so one of them is left.
    return rows.join(keepers, "uid", "left_semi").dropDuplicates(["uid"]).select("row.*")


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate.find_leaks(_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks.items") == 0).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights, in whole documents; a document taken twice is there twice."""
    drawn = mixing.draw_mix(docs, WEIGHTS, SHARDS, keep=True)
    return mixing.mixed_rows(drawn, whole=True).select("row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of even size that keep equal texts together, and each row's place in its shard."""
    placed = sharding.shard_documents(docs, SHARDS, keep=True)
    return placed.select("row.*", *[F.col(c).alias(_unused(c, docs)) for c in ("shard", "slot")])


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language identification and near copies have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
