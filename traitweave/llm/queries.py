"""The registered queries of the operators and their SQL.

Each query applies one operator with production parameters to its whole table
and derives the columns of its contract from the operator's result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations,
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    pii,
    sharding,
    substring_dedup,
    token_count,
    whitening,
)
from .common import prepare

WEIGHTS = (1, 2, 3)
SHARDS = 16
TOKEN_LIMIT = 4096


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", pii.find_pii(F.col("text")).alias("pii"))

    def joined(spans) -> F.Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def number(kind: str) -> F.Column:
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    base = joined(F.filter("pii", lambda s: s["base"]))
    return docs.select("doc_id", *map(number, pii.KINDS), _sha(base).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    drawn = mixing.draw_mix(_table(spark, sf, "documents"), WEIGHTS, SHARDS)
    # Every draw has its place in an output shard.
    placed = F.filter("draws", lambda d: (d["shard"] >= 0) & (d["shard"] < SHARDS))
    taken = F.aggregate(placed, F.lit(0).cast("bigint"), lambda a, d: a + d["words"])
    return drawn.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def op3_html(spark: SparkSession, sf: str) -> DataFrame:
    found = html_extract.extract_main_text(_table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_tokens(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = _table(spark, sf, "documents")
    n = token_count.count_tokens(F.col("text"), model)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return docs.select("doc_id", size.alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf, "documents"), width=4, percent=80)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, _table(spark, sf, "benchmark"))
    hit = decontaminate.hit_words(F.col("leaks.ranges"))
    return found.select(
        "doc_id", "leaks.n_words", hit.alias("n_hit"), F.size("leaks.items").cast("bigint").alias("n_items"),
        _sha(F.concat_ws(",", "leaks.items")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf, "documents"), SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = language_id.train_language_id(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), language_id.predict_language(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.accepted").alias("accepted"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf, "documents"), max_words=3, min_count=10, contained_percent=50, top=2_000)


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf, "documents"), min_chars=20, min_docs=3)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", _sha(F.col("kept_text")).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten_embeddings(_table(spark, sf, "embeddings"))
    each = found.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get("explained", "place").alias("explained"), "identity_error",
    )


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_mixing, op3_html, op4_tokens, op5_exact_dedup, op6_near_dedup, op7_decontamination, op8_substring_dedup,
              op9_sharding, op10_language_id, op11_collocations, op12_line_dedup, op13_whitening, pipeline)
}


@functools.cache
def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
