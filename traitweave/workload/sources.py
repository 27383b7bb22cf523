"""Readers and writers: tables go out to the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ranking import runs_by_reads
from ..session import scratch
from ..sources import ontology as OBO
from ..sources import results as RES
from ..sources import sequences as SEQ
from ..sources import tables as S
from .ontology import item_edges, term_edges
from .tables import importances, table


def _tsv(spark, sf):
    path = scratch(spark, "parts")
    parts = table(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("p_size"), "p_name", "p_retailprice")
    S.write_tsv(parts, path, na="NA")
    return S.read_tsv(spark, path, "p_partkey BIGINT, p_size INT, p_name STRING, p_retailprice DOUBLE")


def _matrix(spark, sf):
    path = scratch(spark, "matrix")
    wide = table(spark, sf, "customer").select(
        F.col("c_name").alias("Gene"), F.col("c_nationkey").alias("ort_nation"), (F.floor(F.col("c_acctbal")) / 4).alias("tpm_balance"),
        F.col("c_custkey").alias("other_key"),
    )
    S.write_tsv(wide, path, na="NA")
    return S.read_feature_matrix(spark, path, {"ort_": "categorical", "tpm_": "continuous"})


def _annotation(spark, sf):
    path = scratch(spark, "annotation")
    blank = F.lit(None).cast("string")
    table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_suppkey")).alias("c1"), F.md5(F.col("l_orderkey").cast("string").cast("binary")).alias("c2"),
        F.col("l_linenumber").alias("c3"), F.col("l_returnflag").alias("c4"), F.concat(F.lit("PF"), F.col("l_partkey")).alias("c5"),
        F.col("l_linestatus").alias("c6"), F.col("l_quantity").cast("int").alias("c7"), (F.col("l_quantity") + 9).cast("int").alias("c8"),
        blank.alias("c9"), F.lit("T").alias("c10"), F.lit("01-01-2020").alias("c11"),
        *[blank.alias(f"c{i}") for i in range(12, 16)],
    ).write.csv(path, sep="\t", header=False)
    return S.read_annotation(spark, path).select("protein", "length", "analysis", "signature", "start", "stop", "status")


def _targets(spark, sf):
    path = scratch(spark, "targets")
    quoted = F.concat(F.lit("|"), F.col("p_name"), F.lit("|"))
    table(spark, sf, "part").select(F.concat_ws("\t", "p_partkey", quoted).alias("line")).write.text(path)
    return S.read_targets(spark, path, col=1)


def _obo(spark, sf):
    """Write the term graph as stanzas, one per term, and read the edges back."""
    path = scratch(spark, "terms")
    stanza = F.concat(
        F.lit("[Term]\nid: "), F.col("child"), F.lit("\nname: term\n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("parent")), lambda p: F.concat(F.lit("is_a: "), p, F.lit(" ! parent"))), "\n"),
        F.lit("\n"),
    )
    term_edges(spark, sf).groupBy("child").agg(stanza.alias("value")).select("value").write.text(path)
    return OBO.read_obo_edges(spark, path)


def _labelled(spark, sf):
    """One folder of tables per market segment; the label is in the path."""
    path = scratch(spark, "by_label")
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows.write.partitionBy("c_mktsegment").csv(path, sep="\t", header=True)
    return S.read_labelled_dir(spark, f"{path}/*/*.csv", "c_custkey BIGINT, c_nationkey INT", "/c_mktsegment=([^/]*)/", "file_path")


def _run_info(spark, sf):
    """One folder per user with a JSON of the number of processed reads."""
    path = scratch(spark, "runs")
    n = F.sum(F.get_json_object("props", "$.k").cast("bigint"))
    info = table(spark, sf, "events").groupBy("user_id").agg(n.alias("n_processed"))
    named = info.select(F.concat(F.col("user_id"), F.lit("_kal_out")).alias("folder"), "n_processed")
    # A file per row: by their bytes, Spark would give all of them to one task.
    named.repartition(4 * spark.sparkContext.defaultParallelism, "folder").write.partitionBy("folder").json(path)
    return runs_by_reads(
        S.read_run_info(spark, f"{path}/*/*.json").withColumn("run", F.regexp_replace("run", "^folder=", ""))
    )


def _edges(spark, sf):
    path = scratch(spark, "edges")
    item_edges(spark, sf).write.csv(path, sep="\t", header=False)
    return S.read_edges(spark, path)


def _results(spark, sf):
    path = scratch(spark, "results")
    RES.write_results(importances(spark, sf).select(F.replace("f2", F.lit("_"), F.lit(":")).alias("target"), F.col("f1").alias("feature"), "v"), path)
    return RES.read_results(spark, path).select("target", "feature", "v")


def _sequences(spark, sf):
    """Compressed text, one folder per language; the species is in the path."""
    path = scratch(spark, "seq")
    docs = table(spark, sf, "documents").select(F.regexp_replace(F.concat("text", F.lit("*")), r"\s+", " ").alias("value"), F.col("lang").alias("species"))
    docs.write.partitionBy("species").option("compression", "gzip").text(path)
    return SEQ.clean_sequences(spark, f"{path}/*/*.gz", "/species=([^/]*)/")


QUERIES = {
    "tsv_roundtrip": (_tsv, "SELECT p_partkey, nullif(p_size, 10) AS p_size, p_name, p_retailprice FROM part"),
    "feature_matrix_scan": (
        _matrix,
        """SELECT c_name AS "Gene", CAST(c_nationkey AS TINYINT) AS ort_nation, CAST(floor(c_acctbal) / 4 AS FLOAT) AS tpm_balance,
        CAST(c_custkey AS DOUBLE) AS other_key FROM customer""",
    ),
    "annotation_scan": (
        _annotation,
        """SELECT 'P' || l_suppkey AS protein, l_linenumber AS length, l_returnflag AS analysis, 'PF' || l_partkey AS signature,
        CAST(l_quantity AS INTEGER) AS start, CAST(l_quantity + 9 AS INTEGER) AS stop, 'T' AS status FROM lineitem""",
    ),
    "target_list_scan": (_targets, "SELECT p_name AS target FROM part"),
    "obo_scan": (
        _obo,
        """SELECT 'c' || c_custkey AS child, 'c' || (c_custkey // 2) AS parent FROM customer WHERE c_custkey > 0
        UNION SELECT 'c' || c_custkey, 'c' || (c_custkey // 3) FROM customer WHERE c_custkey > 0
        UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
        UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation""",
    ),
    "labelled_dir_scan": (_labelled, "SELECT c_custkey, c_nationkey, c_mktsegment AS label FROM customer"),
    "run_info_scan": (
        _run_info,
        "SELECT CAST(user_id AS VARCHAR) AS run, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS n_processed FROM events GROUP BY 1",
    ),
    "edge_list_scan": (
        _edges,
        """SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS dst,
        sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2""",
    ),
    "result_sink": (
        _results,
        """WITH i AS (SELECT l_partkey % (SELECT count(*) FROM supplier) AS f, l_suppkey AS t,
          sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS v FROM lineitem GROUP BY 1, 2)
        SELECT list_element(['go','tpm','pfa','ppi','pep','zzz'], CAST(t % 6 + 1 AS INTEGER)) || '_' || t AS target,
               list_element(['go','tpm','pfa','ppi','pep','zzz'], CAST(f % 6 + 1 AS INTEGER)) || '_' || f AS feature, v FROM i""",
    ),
    "sequence_clean_up": (
        _sequences,
        r"""SELECT lang AS species, replace(regexp_replace(text || '*', '\s+', ' ', 'g'), '*', '') AS "value" FROM documents""",
    ),
}
