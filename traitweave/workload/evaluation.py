"""Scores over a prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .tables import rounded, table


def predictions(spark, sf):
    """Orders as predictions: finished or not, scored by price with many ties."""
    score = F.floor(F.col("o_totalprice") / 1000)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("model"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y_true"),
        score.cast("double").alias("score"), (score > 250).cast("int").alias("y_hat"),
    )


PRED = """
pred AS (SELECT o_orderkey AS key, o_orderpriority AS model, CAST(o_orderstatus = 'F' AS INTEGER) AS y_true,
  CAST(floor(o_totalprice / 1000) AS DOUBLE) AS score, CAST(floor(o_totalprice / 1000) > 250 AS INTEGER) AS y_hat FROM orders)"""
CONF = (
    PRED
    + """,
conf AS (SELECT model, count(*) FILTER (y_true <> 1 AND y_hat <> 1) AS tn, count(*) FILTER (y_true <> 1 AND y_hat = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_hat <> 1) AS fn, count(*) FILTER (y_true = 1 AND y_hat = 1) AS tp FROM pred GROUP BY model)"""
)


def _multiclass(spark, sf):
    """Status of an order against a status guessed from its price."""
    guess = F.when(F.col("o_totalprice") < 150000, "F").when(F.col("o_totalprice") < 350000, "O").otherwise("P")
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("y_true"), guess.alias("y_hat"))


REPORT_SQL = """WITH p AS (SELECT o_orderstatus AS t, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'P' END AS h FROM orders),
c AS (SELECT DISTINCT t AS class FROM p UNION SELECT DISTINCT h FROM p),
s AS (SELECT class, (SELECT count(*) FROM p WHERE t = class) AS support, (SELECT count(*) FROM p WHERE h = class) AS said,
        (SELECT count(*) FROM p WHERE t = class AND h = class) AS hit FROM c),
r AS (SELECT class, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall,
        coalesce(2 * hit / nullif(said + support, 0), 0) AS f1, support FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT * FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support) FROM r)"""

ROC_SQL = """
steps AS (SELECT model, score, count(*) FILTER (y_true = 1) AS tp, count(*) FILTER (y_true <> 1) AS fp FROM pred GROUP BY 1, 2),
roc AS (SELECT model, score, tp, fp, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, sum(tp) OVER g AS p, sum(fp) OVER g AS n
        FROM steps WINDOW w AS (PARTITION BY model ORDER BY score DESC), g AS (PARTITION BY model))"""


def _regression(spark, sf):
    """Order price predicted from the mean price of its customer."""
    orders = table(spark, sf, "orders")
    means = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("y_hat"))
    return orders.join(means, "o_custkey").select("o_orderpriority", F.col("o_totalprice").alias("y_true"), "y_hat")


def _cv_results(spark, sf):
    """A search table: mean order price per customer nation and setting."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.groupBy(F.col("c_nationkey").alias("target"), F.concat(F.lit("depth="), "o_orderpriority").alias("params")).agg(
        F.max("o_totalprice").alias("mean")
    )


CV = """
cv AS (SELECT c_nationkey AS target, 'depth=' || o_orderpriority AS params, max(o_totalprice) AS mean
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
best AS (SELECT target, params, mean FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mean DESC, params) AS r FROM cv) WHERE r = 1)"""

QUERIES = {
    "confusion_matrix": (
        lambda spark, sf: E.confusion(predictions(spark, sf), "model"),
        f"WITH {CONF} SELECT model, tn, fp, fn, tp FROM conf",
    ),
    "f1_precision_recall": (
        lambda spark, sf: rounded(E.prf(E.confusion(predictions(spark, sf), "model")), "f1", "precision", "recall"),
        f"""WITH {CONF} SELECT model, tn, fp, fn, tp, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
        round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM conf""",
    ),
    "tpr_tnr": (
        lambda spark, sf: rounded(E.tpr_tnr(E.confusion(predictions(spark, sf), "model")), "tpr", "tnr"),
        f"WITH {CONF} SELECT model, tn, fp, fn, tp, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(tn / nullif(tn + fp, 0), 6) AS tnr FROM conf",
    ),
    "classification_report": (
        lambda spark, sf: rounded(E.classification_report(_multiclass(spark, sf)), "precision", "recall", "f1"),
        REPORT_SQL,
    ),
    "roc_points": (
        lambda spark, sf: rounded(E.roc_points(predictions(spark, sf), by="model"), "tpr", "fpr"),
        f"WITH {PRED}, {ROC_SQL} SELECT model, score AS threshold, round(ctp / p, 6) AS tpr, round(cfp / n, 6) AS fpr FROM roc",
    ),
    "roc_auc": (
        lambda spark, sf: rounded(E.roc_auc(predictions(spark, sf), by="model"), "auc"),
        f"WITH {PRED}, {ROC_SQL} SELECT model, round(sum(fp * (ctp - tp / 2.0)) / (max(p)::DOUBLE * max(n)), 6) AS auc FROM roc GROUP BY model",
    ),
    "roc_auc_overall": (
        lambda spark, sf: rounded(E.roc_auc(predictions(spark, sf)), "auc"),
        f"WITH {PRED.replace('o_orderpriority AS model', '1 AS model')}, {ROC_SQL} SELECT round(sum(fp * (ctp - tp / 2.0)) / (max(p)::DOUBLE * max(n)), 6) AS auc FROM roc",
    ),
    "r_squared": (
        lambda spark, sf: rounded(E.r_squared(_regression(spark, sf), "o_orderpriority"), "r2"),
        """WITH p AS (SELECT o_orderpriority, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS h FROM orders)
        SELECT o_orderpriority, round(1 - sum((y - h) * (y - h)) / (count(*) * var_pop(y)), 6) AS r2 FROM p GROUP BY 1""",
    ),
    "best_parameters": (
        lambda spark, sf: E.best_params(_cv_results(spark, sf), "target"),
        f"WITH {CV} SELECT target, params, mean FROM best",
    ),
    "most_frequent_parameters": (
        lambda spark, sf: E.most_frequent_params(E.best_params(_cv_results(spark, sf), "target")),
        f"WITH {CV} SELECT params, count(*) AS n FROM best GROUP BY 1",
    ),
}
