"""Feature-table construction, joins and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregating as A
from ..operators import joining as J
from ..operators import reshape as P
from .tables import rounded, table


def _items(spark, sf):
    return table(spark, sf, "lineitem")


def _column_range(spark, sf):
    items = _items(spark, sf)
    return items.select(*P.column_range(items, "l_quantity", "l_tax"))


def _numeric(spark, sf):
    part = table(spark, sf, "part")
    return part.select("p_partkey", *P.columns_of_type(part, "double"))


def _holes(spark, sf):
    """Parts with missing sizes and prices."""
    return table(spark, sf, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(10)).alias("size"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"),
    )


HOLES = """
holes AS (SELECT p_partkey, nullif(p_size, 10) AS size, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price FROM part)"""


def _feature_kinds(spark, sf):
    parts = table(spark, sf, "part")
    names = parts.select(F.concat_ws("_", F.substring_index("p_name", " ", 1), "p_brand").alias("feature"))
    kinds = parts.select(F.substring_index("p_name", " ", 1).alias("word")).distinct()
    kind = F.when(F.length("word") > 4, "continuous").otherwise("categorical")
    return P.feature_kinds(names, kinds.select(F.concat("word", F.lit("_")).alias("prefix"), kind.alias("kind")))


def _term_lists(spark, sf):
    """Space-separated parts per supplier, as in a term table."""
    return A.join_strings(_items(spark, sf).withColumn("l_partkey", F.col("l_partkey").cast("string")), "l_suppkey", "l_partkey")


def _indicator(spark, sf):
    return A.indicator(_items(spark, sf).select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", prefix="go_")


INDICATOR = """
ind AS (SELECT l_suppkey AS key, 'go_' || l_partkey AS feature, count(*) AS value FROM lineitem GROUP BY 1, 2)"""


def _wide_indicator(spark, sf):
    cells = A.indicator(_items(spark, sf), "l_orderkey", "l_returnflag", prefix="ort_")
    return A.widen(cells, ["ort_A", "ort_N", "ort_R"])


def _clean_ids(spark, sf):
    members = _items(spark, sf).select(
        "l_suppkey",
        F.concat_ws("|", F.lit("sp"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), "l_linenumber").alias("id"),
    )
    return P.clean_ids(A.join_strings(members, "l_suppkey", "id", ", "), ["id"])


def _transcripts(spark, sf):
    named = _items(spark, sf).select(
        F.concat_ws(".", F.concat(F.lit("AT"), F.col("l_orderkey")), F.col("l_linenumber")).alias("transcript"),
        F.col("l_quantity").alias("q"),
    )
    return P.transcript_to_gene(named, "transcript", on_many="max")


def _differential(spark, sf):
    """Per part: a q value with gaps and a signed effect."""
    return _items(spark, sf).groupBy("l_partkey").agg(
        F.nullif(F.min("l_discount"), F.lit(0.01)).alias("qval"),
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).otherwise(-F.col("l_quantity") / 2)).alias("b"),
    )


DIFFERENTIAL = """
diff AS (SELECT l_partkey, nullif(min(l_discount), 0.01) AS qval,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE -l_quantity / 2 END) AS b FROM lineitem GROUP BY 1)"""


def _runs(spark, sf):
    """Run accessions of both archives, and of neither, in three lengths."""
    base = F.element_at(F.array(F.lit("ERR"), F.lit("SRR"), F.lit("DRR")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    digits = F.lpad(F.col("o_orderkey").cast("string"), 6, "1")
    longer = F.concat(digits, F.when(F.col("o_custkey") % 2 == 0, "7").otherwise(""), F.when(F.col("o_custkey") % 10 == 0, "8").otherwise(""))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(base, longer).alias("run"))


RUNS = """
runs AS (SELECT o_orderkey AS id, list_element(['ERR','SRR','DRR'], CAST(o_orderkey % 3 + 1 AS INTEGER)) || lpad(CAST(o_orderkey AS VARCHAR), 6, '1')
  || CASE WHEN o_custkey % 2 = 0 THEN '7' ELSE '' END || CASE WHEN o_custkey % 10 = 0 THEN '8' ELSE '' END AS run FROM orders)"""


def _complement(spark, sf):
    flag = F.when(F.col("l_returnflag") == "A", "up").otherwise("down")
    name = F.concat_ws("_", F.lit("dge"), "l_partkey", flag)
    names = _items(spark, sf).select(name.alias("feature")).distinct()
    return names.select("feature", C.complement_name("feature").alias("mate"))


def _duration(spark, sf):
    text = lambda c: F.date_format(c, C.LOG_TIME)
    times = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    logged = times.select("user_id", text("a").alias("time_start"), text("b").alias("time_end"))
    return P.with_duration(logged, "time_start", "time_end")


def _job_ids(spark, sf):
    names = table(spark, sf, "orders").select(F.concat_ws("_", "o_orderstatus", "o_custkey", "o_orderkey", F.lit("scores")).alias("file"))
    return names.select(C.job_id("file").alias("job")).distinct()


def _align(spark, sf):
    items = _items(spark, sf)
    a = items.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty_a"))
    r = items.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty_r"))
    n = items.where("l_returnflag = 'N'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_n"))
    return J.align_outer([a, r, n], "l_partkey")


def _align_long(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.max("s_suppkey").alias("last"))
    return J.align_long({"cust": c, "supp": s}, "nation")


def _attach(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("y")).distinct()
    return J.attach_target(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), big, "y", "c_custkey")


def _drop_features(spark, sf):
    rare = table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("go_"), F.col("p_partkey")).alias("feature"))
    return J.drop_features(_indicator(spark, sf), rare)


def _expected(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("target"))


def _done(spark, sf):
    return _items(spark, sf).select(F.col("l_orderkey").alias("target"))


def _labels(spark, sf, numbers=("1", "2")):
    """Experiments (customers of a nation block) with numbered conditions; every
    third experiment has lettered tests."""
    number = F.floor(F.col("c_custkey") / 10)
    k = F.when(F.col("c_custkey") % 2 == 0, numbers[0]).otherwise(numbers[1])
    letter = F.when(number % 3 == 0, F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b")).otherwise("")
    label = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.concat(F.lit("control_"), k)).otherwise(
        F.concat(F.lit("test_"), k, letter)
    )
    return table(spark, sf, "customer").select(
        F.col("c_name").alias("Run"), F.concat(F.lit("E"), number).alias("Experiment"), label.alias("Control_test_label")
    )


SUBEXPERIMENTS_SQL = """WITH m AS (
  SELECT c_name AS sample, 'E' || (c_custkey // 10) AS e,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'control_' || (c_custkey % 2 + 1)
              ELSE 'test_' || (c_custkey % 2 + 1) || CASE WHEN (c_custkey // 10) % 3 <> 0 THEN '' WHEN c_nationkey % 2 = 0 THEN 'a' ELSE 'b' END END AS condition
  FROM customer),
c AS (SELECT DISTINCT e, condition FROM m),
s AS (SELECT e, bool_or(condition LIKE '%a') AS lettered,
        count(*) = 2 AND count(*) FILTER (condition IN ('control_1', 'test_1')) = 2 AS plain FROM c GROUP BY e),
ctl AS (SELECT e, condition AS control, split_part(condition, '_', 2) AS num, lettered, plain FROM c JOIN s USING (e) WHERE condition LIKE 'control%'),
tst AS (SELECT e, condition AS test, split_part(condition, '_', 2) AS tag,
          CASE WHEN lettered THEN regexp_extract(split_part(condition, '_', 2), '^[0-9]+') ELSE split_part(condition, '_', 2) END AS num
        FROM c JOIN s USING (e) WHERE condition LIKE 'test%'),
p AS (SELECT ctl.e, control, test, CASE WHEN plain THEN ctl.e WHEN lettered THEN ctl.e || '_' || tag ELSE ctl.e || '_' || ctl.num END AS sheet
      FROM ctl LEFT JOIN tst ON ctl.e = tst.e AND ctl.num = tst.num WHERE NOT lettered OR test IS NOT NULL),
w AS (SELECT e, sheet, control, control AS condition FROM p UNION ALL SELECT e, sheet, control, test FROM p WHERE test IS NOT NULL)
SELECT sheet, control, sample, w.condition, row_number() OVER (PARTITION BY sheet, control ORDER BY split_part(w.condition, '_', 1), sample) AS row
FROM w JOIN m ON w.e = m.e AND w.condition = m.condition"""


def _annotations(spark, sf):
    analysis = F.element_at(F.array(*[F.lit(a) for a in ("Pfam", "MobiDBLite", "TMHMM", "Gene3D")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return _items(spark, sf).select(
        F.col("l_suppkey").alias("protein"), analysis.alias("analysis"), F.concat(F.lit("PF"), F.col("l_quantity").cast("int")).alias("signature")
    )


def _manifest(spark, sf):
    """Files present per run, from the event types a user has in an hour."""
    suffix = F.element_at(
        F.array(F.lit(".fastq.gz"), F.lit("_1.fastq.gz"), F.lit("_2.fastq.gz"), F.lit(".log"), F.lit(".txt")),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    run = F.concat_ws("x", "user_id", F.date_format("ts", "yyyyMMdd"))
    n = F.get_json_object("props", "$.k").cast("bigint") % 10
    return table(spark, sf, "events").select(run.alias("run"), F.concat(run, suffix).alias("file"), n.alias("n_processed"))


LAYOUT_SQL = """WITH m AS (SELECT user_id || 'x' || strftime(ts, '%Y%m%d') AS run, event_id % 5 AS s,
   CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS n FROM events),
r AS (SELECT run, bool_or(s = 0) AS a, bool_or(s = 1) AS b, bool_or(s = 2) AS c, max(n) AS n FROM m GROUP BY run),
l AS (SELECT run, n, CASE WHEN a AND NOT b AND NOT c THEN 'single' WHEN a AND b AND c THEN 'three_files'
   WHEN NOT a AND b AND c THEN 'paired' ELSE 'fail' END AS layout FROM r)
SELECT run, layout, layout <> 'fail' AS passes, n = 0 AS zero_reads FROM l"""

QUERIES = {
    "project_columns": (
        lambda spark, sf: P.project(_items(spark, sf), ["l_orderkey", "l_partkey", "l_returnflag"]),
        "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem",
    ),
    "drop_columns": (
        lambda spark, sf: P.drop_cols(table(spark, sf, "supplier"), ["s_name", "s_acctbal"]),
        "SELECT s_suppkey, s_nationkey FROM supplier",
    ),
    "column_range": (_column_range, "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"),
    "columns_by_type": (_numeric, "SELECT p_partkey, p_retailprice FROM part"),
    "equality_filter": (
        lambda spark, sf: P.where_equals(_items(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", "R"),
        "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'",
    ),
    "distinct_rows": (
        lambda spark, sf: P.distinct_rows(_items(spark, sf), ["l_suppkey", "l_quantity"]),
        "SELECT DISTINCT l_suppkey, l_quantity FROM lineitem",
    ),
    "fill_zero": (
        lambda spark, sf: P.fill_zero(_holes(spark, sf), ["size", "price"]),
        f"WITH {HOLES} SELECT p_partkey, coalesce(size, 0) AS size, coalesce(price, 0) AS price FROM holes",
    ),
    "fill_median": (
        lambda spark, sf: rounded(P.fill_median(_holes(spark, sf).drop("size"), "price"), "price"),
        f"WITH {HOLES} SELECT p_partkey, round(coalesce(price, (SELECT median(price) FROM holes)), 6) AS price FROM holes",
    ),
    "downcast": (
        lambda spark, sf: P.downcast(_items(spark, sf).select("l_orderkey", "l_quantity", "l_linenumber"), ["l_quantity"], ["l_linenumber"]),
        "SELECT l_orderkey, CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_linenumber AS TINYINT) AS l_linenumber FROM lineitem",
    ),
    "feature_kinds": (
        _feature_kinds,
        """SELECT DISTINCT split_part(p_name, ' ', 1) || '_' || p_brand AS feature,
        CASE WHEN length(split_part(p_name, ' ', 1)) > 4 THEN 'continuous' ELSE 'categorical' END AS kind FROM part""",
    ),
    "join_strings": (
        _term_lists,
        """SELECT l_suppkey, string_agg(p, ' ' ORDER BY p) AS l_partkey
        FROM (SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS p FROM lineitem) GROUP BY 1""",
    ),
    "explode_list": (
        lambda spark, sf: P.explode_list(_term_lists(spark, sf), "l_partkey"),
        "SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS l_partkey FROM lineitem",
    ),
    "clean_ids": (
        _clean_ids,
        """SELECT l_suppkey, string_agg(o, ' ' ORDER BY o, n) AS id FROM (
          SELECT DISTINCT l_suppkey, lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS o, l_linenumber AS n FROM lineitem) GROUP BY 1""",
    ),
    "single_transcripts_to_genes": (
        lambda spark, sf: P.transcript_to_gene(
            table(spark, sf, "orders").select(
                F.concat(F.lit("AT"), F.col("o_orderkey"), F.lit(".1")).alias("transcript"), F.col("o_totalprice").alias("q")
            ), "transcript",
        ),
        "SELECT 'AT' || o_orderkey AS transcript, o_totalprice AS q FROM orders",
    ),
    "transcript_to_gene": (_transcripts, "SELECT 'AT' || l_orderkey AS transcript, max(l_quantity) AS q FROM lineitem GROUP BY 1"),
    "regulation_flags": (
        lambda spark, sf: P.regulation_flags(_differential(spark, sf)),
        f"""WITH {DIFFERENTIAL} SELECT l_partkey, qval, b, CASE WHEN qval < 0.05 AND b > 0 THEN 1 ELSE 0 END AS up,
        CASE WHEN qval < 0.05 AND b < 0 THEN 1 ELSE 0 END AS down FROM diff""",
    ),
    "accession_path": (
        lambda spark, sf: P.accession_path(_runs(spark, sf), "run"),
        f"""WITH {RUNS} SELECT id, run,
        CASE WHEN left(run, 3) IN ('ERR', 'SRR') AND length(run) = 9 THEN left(run, 6) || '/' || run || '/'
             WHEN left(run, 3) IN ('ERR', 'SRR') AND length(run) = 10 THEN left(run, 6) || '/00' || right(run, 1) || '/' || run || '/' END AS path,
        CASE WHEN left(run, 3) NOT IN ('ERR', 'SRR') THEN 'database unrecognised' WHEN length(run) IN (9, 10) THEN 'ok'
             ELSE 'length unrecognised' END AS status FROM runs""",
    ),
    "run_path": (
        lambda spark, sf: P.with_run_path(_runs(spark, sf), "run"),
        f"WITH {RUNS} SELECT id, run, './kal_output/' || run || '_kal_out' AS path FROM runs",
    ),
    "rename_features": (
        lambda spark, sf: P.rename_features(
            table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("feature")), "dge_", {" ": "_"}
        ),
        "SELECT p_partkey AS key, 'dge_' || replace(p_name, ' ', '_') AS feature FROM part",
    ),
    "complement_name": (
        _complement,
        """SELECT DISTINCT 'dge_' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '_up' ELSE '_down' END AS feature,
        'dge_' || l_partkey || CASE WHEN l_returnflag = 'A' THEN '_down' ELSE '_up' END AS mate FROM lineitem""",
    ),
    "encode_minority": (
        lambda spark, sf: P.encode_minority(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic"),
        """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
        SELECT doc_id, toxic, CASE WHEN toxic = (SELECT toxic FROM c ORDER BY n, toxic LIMIT 1) THEN 1
          WHEN toxic = (SELECT toxic FROM c ORDER BY n DESC, toxic DESC LIMIT 1) THEN 0 END AS y FROM labels""",
    ),
    "run_duration": (
        _duration,
        """SELECT user_id, strftime(min(ts), '%d/%m/%Y %H:%M:%S') AS time_start, strftime(max(ts), '%d/%m/%Y %H:%M:%S') AS time_end,
        date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS seconds FROM events GROUP BY 1""",
    ),
    "job_ids": (_job_ids, "SELECT DISTINCT o_orderstatus || '_' || o_custkey AS job FROM orders"),
    "align_outer": (
        _align,
        """SELECT coalesce(a.l_partkey, r.l_partkey, n.l_partkey) AS l_partkey, qty_a, qty_r, n_n
        FROM (SELECT l_partkey, sum(l_quantity) AS qty_a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a
        FULL JOIN (SELECT l_partkey, sum(l_quantity) AS qty_r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON a.l_partkey = r.l_partkey
        FULL JOIN (SELECT l_partkey, count(*) AS n_n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) n ON n.l_partkey = coalesce(a.l_partkey, r.l_partkey)""",
    ),
    "align_long": (
        _align_long,
        """SELECT c_nationkey AS nation, 'cust_n' AS feature, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY 1
        UNION ALL SELECT s_nationkey, 'supp_n', count(*) FROM supplier GROUP BY 1
        UNION ALL SELECT s_nationkey, 'supp_last', max(s_suppkey) FROM supplier GROUP BY 1""",
    ),
    "attach_target": (
        _attach,
        """SELECT c_custkey, c_nationkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS INTEGER) AS y FROM customer""",
    ),
    "drop_features": (
        _drop_features,
        f"WITH {INDICATOR} SELECT * FROM ind WHERE feature NOT IN (SELECT 'go_' || p_partkey FROM part WHERE p_size > 25)",
    ),
    "missing_targets": (
        lambda spark, sf: J.missing_targets(_expected(spark, sf), _done(spark, sf)),
        "SELECT o_orderkey AS target FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    ),
    "completeness": (
        lambda spark, sf: J.completeness(_expected(spark, sf), _done(spark, sf)),
        """SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS n_expected, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_done,
        (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS n_missing""",
    ),
    "subexperiments": (lambda spark, sf: J.expand_subexperiments(_labels(spark, sf)), SUBEXPERIMENTS_SQL),
    "subexperiments_by_prefix": (
        lambda spark, sf: J.expand_subexperiments(_labels(spark, sf, ("1", "10")), substring_match=True),
        SUBEXPERIMENTS_SQL.replace("(c_custkey % 2 + 1)", "CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 10 END").replace(
            "ctl.num = tst.num", "CASE WHEN ctl.lettered THEN starts_with(tst.tag, ctl.num) ELSE ctl.num = tst.tag END"
        ),
    ),
    "stack_rows": (
        lambda spark, sf: J.stack_rows(
            table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")),
            table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")),
        ),
        "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier",
    ),
    "annotation_counts": (
        lambda spark, sf: A.annotation_counts(_annotations(spark, sf)),
        """WITH a AS (SELECT l_suppkey AS protein, l_linenumber % 4 AS k, CAST(l_quantity AS INTEGER) AS s FROM lineitem)
        SELECT protein, nullif(count(*) FILTER (k = 0), 0) AS num_counts, nullif(count(DISTINCT s) FILTER (k = 0), 0) AS num_u_counts,
        nullif(count(*) FILTER (k = 1), 0) AS mob_counts, nullif(count(*) FILTER (k = 2), 0) AS tmh_counts
        FROM a WHERE k < 3 GROUP BY protein""",
    ),
    "indicator_distinct": (
        lambda spark, sf: A.indicator(_items(spark, sf).select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey", distinct=True, prefix="go_"),
        f"WITH {INDICATOR} SELECT key, feature, CAST(1 AS BIGINT) AS value FROM ind",
    ),
    "indicator_long": (_indicator, f"WITH {INDICATOR} SELECT * FROM ind"),
    "indicator_wide": (
        _wide_indicator,
        """SELECT l_orderkey AS key, count(*) FILTER (l_returnflag = 'A') AS "ort_A", count(*) FILTER (l_returnflag = 'N') AS "ort_N",
        count(*) FILTER (l_returnflag = 'R') AS "ort_R" FROM lineitem GROUP BY 1""",
    ),
    "drop_singletons": (
        lambda spark, sf: A.drop_singletons(_order_parts(spark, sf)),
        """WITH c AS (SELECT o_custkey AS key, 'go_' || (l_partkey * 100 + l_suppkey % 3) AS feature, count(*) AS value
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT * FROM c WHERE feature NOT IN (SELECT feature FROM c GROUP BY 1 HAVING count(*) = 1)""",
    ),
    "fold_summary": (
        lambda spark, sf: rounded(A.fold_summary(_items(spark, sf), ["l_returnflag", "l_linenumber"], "l_quantity"), "mean", "std"),
        """SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std
        FROM lineitem GROUP BY 1, 2""",
    ),
    "integrity_report": (
        lambda spark, sf: A.integrity_report(
            table(spark, sf, "orders"), unique=["o_orderkey", "o_custkey"], not_null=["o_orderdate"],
            allowed={"o_orderstatus": ["F", "O"]}, positive=["o_custkey"],
        ),
        """WITH r AS (
          SELECT 'unique o_orderkey' AS rule, count(*) - count(DISTINCT o_orderkey) AS n_bad FROM orders
          UNION ALL SELECT 'unique o_custkey', count(*) - count(DISTINCT o_custkey) FROM orders
          UNION ALL SELECT 'not null o_orderdate', count(*) FILTER (o_orderdate IS NULL) FROM orders
          UNION ALL SELECT 'allowed o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
          UNION ALL SELECT 'positive o_custkey', count(*) FILTER (o_custkey < 1) FROM orders)
        SELECT rule, n_bad, n_bad = 0 AS ok FROM r""",
    ),
    "fastq_layout": (lambda spark, sf: A.fastq_layout(_manifest(spark, sf)), LAYOUT_SQL),
    "class_balance": (
        lambda spark, sf: A.class_balance(table(spark, sf, "labels"), "toxic"),
        "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic",
    ),
}


def _order_parts(spark, sf):
    items = _items(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    term = (F.col("l_partkey") * 100 + F.col("l_suppkey") % 3).alias("term")
    return A.indicator(items.select("o_custkey", term), "o_custkey", "term", prefix="go_")
