"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are digested,
aggregated to one row per digest, and those whose digest the index does not know
yet (a sort-merge anti-join; the index side is read bucket by bucket and not
shuffled) are appended. Ingesting batch after batch keeps one row per text.

NULL texts count as empty; NULL ids sort first, so among equal texts a row
without an id stays. Repeated rows are copies of each other and all carry the
flag of the row that stays if they share its id. An empty batch adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import HOT_SHARE, prepare, stored

WHITE_RUN = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ").cast("binary"), 256)


class DigestIndex:
    """``(digest, keep_id, batch)``, one row per digest, bucketed and sorted by digest.

    ``location`` is a folder that all executors reach; a folder that holds an
    index already is opened, and the next batch continues it. ``buckets`` is
    fixed when the index is made; a bucket should stay below a few GB.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, digests: DataFrame) -> int:
        """Append the new digests of ``(id, digest)`` rows; returns the number of this batch."""
        batch = (self.rows().agg(F.max("batch")).first()[0] or 0) + 1
        firsts = digests.groupBy("digest").agg(F.when(F.count(F.lit(1)) == F.count("id"), F.min("id")).alias("keep_id"))
        new = firsts.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = new.select("digest", "keep_id", F.lit(batch).cast("bigint").alias("batch"))
        # The same hash as the buckets': a task writes whole buckets.
        new.repartition(self.buckets, "digest").write.insertInto(self.table)
        return batch

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE {self.table}")


def _in_order(digests: DataFrame, batches: int) -> list[DataFrame]:
    """The rows in about equal batches by id, NULL first, so that the first row of a text comes first."""
    cuts = digests.agg(F.percentile_approx("id", F.array(*[F.lit(i / batches) for i in range(1, batches)]))).first()[0] if batches > 1 else None
    edges = [None, *dict.fromkeys(cuts or []), None]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        above = F.lit(True) if low is None else F.col("id") > low
        upto = F.lit(True) if high is None else F.col("id") <= high
        parts.append(digests.where(above & upto if low is not None else F.col("id").isNull() | upto))
    return parts


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """``(id, digest, keep_id, group_size, kept)`` per row of ``docs``.

    The rows are ingested in ``batches`` by id; what stays of each text is then read
    from the index in a sort-merge join. ``group_size`` counts equal texts in
    ``docs``. With an ``index`` that knows a text from an earlier call, ``keep_id`` is
    the row of that call and no row of this one is kept. Rows that share the kept id
    are repeated rows of one document and are all kept.
    """
    spark = docs.sparkSession
    prepare(spark)
    digests = docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest"))
    digests = stored(digests, "digests")
    made = index is None
    index = index or DigestIndex(spark, scratch(spark, "index"))
    first = min(index.ingest(part) for part in _in_order(digests, batches))
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    # One row per text on both sides; the index is read bucket by bucket.
    facts = stored(sizes.hint("merge").join(index.rows().hint("merge"), "digest"), "facts")
    if made:
        index.close()
    # A text with more than one row in HOT_SHARE is one of at most HOT_SHARE texts.
    is_hot = F.col("group_size") * HOT_SHARE > F.lit(digests.count())
    hot = facts.where(is_hot)
    cold = digests.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(facts.where(~is_hot), "digest")
    rows = digests.join(F.broadcast(hot), "digest").unionByName(cold)
    return rows.select(
        "id", F.lower(F.hex("digest")).alias("digest"), "keep_id", "group_size",
        ((F.col("batch") >= first) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
    )
