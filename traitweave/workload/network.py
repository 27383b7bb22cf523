"""Importance network: ranks, mutual ranks and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregating as A
from ..operators import joining as J
from ..operators import ranking as R
from ..operators import reshape as P
from ..operators.stats import permutation_test
from .tables import (
    IMPORTANCES,
    PAIRS,
    RANKS,
    family_sql,
    hash_sql,
    importances,
    rounded,
    table,
)

# Split point of the mutual-rank distribution and bins as used for its plots.
THRESHOLD = 20.0
BINS, FAMILY_BINS = 50, 16
ROUNDS = 10_000


def pairs(spark, sf):
    return R.mutual_rank_nonzero(importances(spark, sf))


def sides(spark, sf):
    return P.split_at(pairs(spark, sf), "MR", THRESHOLD)


def _melt(spark, sf):
    wide = table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.nullif("p_size", F.lit(10)).alias("size"), F.col("p_retailprice").alias("price")
    )
    return P.melt(wide, "key")


def _scores(spark, sf):
    """A model score per target."""
    from .tables import feature_name

    return table(spark, sf, "supplier").select(
        feature_name("s_suppkey").alias("target"), (F.col("s_acctbal") / 10000).alias("score")
    )


def _histogram(df, col, bins, by=None):
    return rounded(A.histogram(df, col, bins, by), "lower", "upper")


HISTOGRAM_SQL = """
edges AS (SELECT {keys} CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                 CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM vals {group}),
bins AS (SELECT {keys} lo, hi, CAST(bin AS INTEGER) AS bin FROM edges, range(1, {n} + 1) t(bin)),
found AS (SELECT {keyv} CAST(least(floor((v - lo) / (hi - lo) * {n}) + 1, {n}) AS INTEGER) AS bin, count(*) AS n
          FROM vals JOIN edges {on} GROUP BY {keyv} 2)
SELECT {keyb} b.bin, round(lo + (hi - lo) / {n} * (b.bin - 1), 6) AS lower, round(lo + (hi - lo) / {n} * b.bin, 6) AS upper,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM bins b LEFT JOIN found f ON b.bin = f.bin {onb}"""


def histogram_sql(n: int, by: str | None = None) -> str:
    if by is None:
        text = HISTOGRAM_SQL.format(keys="", group="", n=n, keyv="", on="ON true", keyb="", onb="")
        return text.replace("GROUP BY  2", "GROUP BY 1")
    return HISTOGRAM_SQL.format(
        keys=f"{by},", group=f"GROUP BY {by}", n=n, keyv=f"vals.{by},", on=f"USING ({by})", keyb=f"b.{by},",
        onb=f"AND b.{by} = f.{by}",
    )


PAIR_FAMILY = f"concat_ws('_', least({family_sql('f1')}, {family_sql('f2')}), greatest({family_sql('f1')}, {family_sql('f2')}))"

SIDES = PAIRS + f", sides AS (SELECT *, CASE WHEN MR >= {THRESHOLD} THEN 'above' ELSE 'below' END AS side FROM pairs)"

PROPORTIONS = (
    SIDES
    + """,
ends AS (SELECT side, split_part(f1, '_', 1) AS c FROM sides UNION ALL SELECT side, split_part(f2, '_', 1) FROM sides),
props AS (
  SELECT c AS feature_cat, count(*) FILTER (side = 'above') AS n_above, count(*) FILTER (side = 'below') AS n_below,
         nullif(count(*) FILTER (side = 'above'), 0)::DOUBLE / (SELECT count(*) FROM ends WHERE side = 'above') AS above_thresh,
         nullif(count(*) FILTER (side = 'below'), 0)::DOUBLE / (SELECT count(*) FROM ends WHERE side = 'below') AS below_thresh
  FROM ends GROUP BY c)"""
)


def _permutation(spark, sf):
    props = A.category_proportions(sides(spark, sf))
    return rounded(permutation_test(props, ROUNDS, 42), "p_value_higher", "one_minus_p_value_higher")


PERMUTATION_SQL = (
    f"WITH {PROPORTIONS},"
    + f"""
placed AS (SELECT *, above_thresh - below_thresh AS prop_diff,
                  row_number() OVER (ORDER BY {hash_sql('42:place', 'feature_cat')}) AS pos FROM props),
rounds AS (SELECT * FROM placed, range(1, {ROUNDS + 1}) t(round)),
a AS (SELECT round, above_thresh AS x, row_number() OVER (PARTITION BY round ORDER BY {hash_sql('42:above_thresh', 'round', 'feature_cat')}) AS pos FROM rounds),
b AS (SELECT round, below_thresh AS y, row_number() OVER (PARTITION BY round ORDER BY {hash_sql('42:below_thresh', 'round', 'feature_cat')}) AS pos FROM rounds)
SELECT feature_cat, round(avg(CAST(coalesce(prop_diff < x - y, false) AS DOUBLE)), 6) AS p_value_higher,
       round(1 - avg(CAST(coalesce(prop_diff < x - y, false) AS DOUBLE)), 6) AS one_minus_p_value_higher
FROM rounds JOIN a USING (round, pos) JOIN b USING (round, pos) GROUP BY feature_cat"""
)

QUERIES = {
    "mutual_rank_nonzero": (
        lambda spark, sf: rounded(pairs(spark, sf), "MR"),
        f"WITH {PAIRS} SELECT f1, f2, round(MR, 6) AS MR FROM pairs",
    ),
    "mutual_rank": (
        lambda spark, sf: rounded(R.mutual_rank(R.rank_desc_average(importances(spark, sf), "f2", "v")), "MR"),
        f"WITH {PAIRS.replace('FROM imp WHERE v <> 0', 'FROM imp')} SELECT f1, f2, round(MR, 6) AS MR FROM pairs",
    ),
    "geometric_mean_importance": (
        lambda spark, sf: rounded(R.geometric_mean_importance(importances(spark, sf)), "GFI"),
        f"""WITH {IMPORTANCES}
        SELECT least(a, b) AS f1, greatest(a, b) AS f2, round(sqrt(min(v) * max(v)), 6) AS GFI
        FROM (SELECT f1 AS a, f2 AS b, v FROM imp WHERE f1 <> f2)
        GROUP BY 1, 2 HAVING count(*) = 2""",
    ),
    "unpivot_matrix": (
        _melt,
        """SELECT p_partkey AS key, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part WHERE p_size <> 10
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice IS NOT NULL""",
    ),
    "zero_to_null": (
        lambda spark, sf: P.zero_to_null(importances(spark, sf), "v"),
        f"WITH {IMPORTANCES} SELECT f1, f2, nullif(v, 0) AS v FROM imp",
    ),
    "rank_per_target": (
        lambda spark, sf: R.rank_desc_average(importances(spark, sf), "f2", "v"),
        f"WITH {RANKS.replace('FROM imp WHERE v <> 0', 'FROM imp')} SELECT f1, f2, v, CAST(rank AS DOUBLE) AS rank FROM ranks",
    ),
    "reciprocal_pairs": (
        lambda spark, sf: J.reciprocal_pairs(importances(spark, sf)),
        f"""WITH {IMPORTANCES} SELECT a.f1, a.f2, a.v AS v12, b.v AS v21
        FROM imp a JOIN imp b ON a.f1 = b.f2 AND a.f2 = b.f1 WHERE a.f1 < a.f2""",
    ),
    "pair_bounds": (
        lambda spark, sf: rounded(A.bounds(pairs(spark, sf), "MR"), "min", "max"),
        f'WITH {PAIRS} SELECT round(min(MR), 6) AS "min", round(max(MR), 6) AS "max", count(MR) AS n FROM pairs',
    ),
    "missing_profile": (
        lambda spark, sf: rounded(
            A.missing_profile(
                table(spark, sf, "lineitem").select(
                    F.nullif("l_linenumber", F.lit(3)).alias("line"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc")
                ),
                ["line", "tax", "disc"],
            ),
            "sparsity",
        ),
        """WITH cells AS (
          SELECT 'line' AS c, CAST(nullif(l_linenumber, 3) AS DOUBLE) AS v FROM lineitem
          UNION ALL SELECT 'tax', l_tax FROM lineitem UNION ALL SELECT 'disc', l_discount FROM lineitem)
        SELECT c AS "column", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v = 0) AS n_zero,
               count(*) FILTER (v = 1) AS n_one, round(avg(CAST(v = 0 AS DOUBLE)), 6) AS sparsity
        FROM cells GROUP BY c""",
    ),
    "value_counts": (
        lambda spark, sf: A.value_counts(importances(spark, sf), "v"),
        f"WITH {IMPORTANCES} SELECT v, count(*) AS n FROM imp GROUP BY v",
    ),
    "pair_histogram": (
        lambda spark, sf: _histogram(pairs(spark, sf), "MR", BINS),
        f"WITH {PAIRS}, vals AS (SELECT MR AS v FROM pairs), {histogram_sql(BINS)}",
    ),
    "importance_histogram": (
        lambda spark, sf: _histogram(importances(spark, sf), "v", FAMILY_BINS),
        f"WITH {IMPORTANCES}, vals AS (SELECT v FROM imp), {histogram_sql(FAMILY_BINS)}",
    ),
    "family_pair_histogram": (
        lambda spark, sf: _histogram(P.with_pair_family(pairs(spark, sf), "f1", "f2"), "MR", FAMILY_BINS, "pair"),
        f"WITH {PAIRS}, vals AS (SELECT {PAIR_FAMILY} AS pair, MR AS v FROM pairs), {histogram_sql(FAMILY_BINS, 'pair')}",
    ),
    "box_by_prefix": (
        lambda spark, sf: rounded(
            A.box_summary(P.with_prefix(pairs(spark, sf), "f1"), "MR", "prefix"),
            "q1", "median", "q3", "whisker_low", "whisker_high",
        ),
        f"""WITH {PAIRS}, vals AS (SELECT split_part(f1, '_', 1) AS prefix, MR AS v FROM pairs),
        q AS (SELECT prefix, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med,
                     quantile_cont(v, 0.75) AS q3 FROM vals GROUP BY prefix),
        m AS (SELECT *, v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS ok FROM vals JOIN q USING (prefix))
        SELECT prefix, max(n) AS n, round(max(q1), 6) AS q1, round(max(med), 6) AS median, round(max(q3), 6) AS q3,
               round(min(v) FILTER (ok), 6) AS whisker_low, round(max(v) FILTER (ok), 6) AS whisker_high,
               count(*) FILTER (NOT ok) AS n_outliers
        FROM m GROUP BY prefix""",
    ),
    "threshold_split": (
        lambda spark, sf: rounded(sides(spark, sf), "MR"),
        f"WITH {SIDES} SELECT f1, f2, round(MR, 6) AS MR, side FROM sides",
    ),
    "name_prefix": (
        lambda spark, sf: P.with_prefix(pairs(spark, sf), "f1").groupBy("prefix").count().withColumnRenamed("count", "n"),
        f"WITH {PAIRS} SELECT split_part(f1, '_', 1) AS prefix, count(*) AS n FROM pairs GROUP BY 1",
    ),
    "feature_family": (
        lambda spark, sf: P.with_family(importances(spark, sf).select("f1").distinct(), "f1"),
        f"WITH {IMPORTANCES} SELECT DISTINCT f1, {family_sql('f1')} AS family FROM imp",
    ),
    "pair_family": (
        lambda spark, sf: P.with_pair_family(pairs(spark, sf), "f1", "f2").groupBy("pair").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {PAIRS} SELECT {PAIR_FAMILY} AS pair, count(*) AS n FROM pairs GROUP BY 1",
    ),
    "category_proportions": (
        lambda spark, sf: rounded(A.category_proportions(sides(spark, sf)), "above_thresh", "below_thresh", "prop_diff"),
        f"""WITH {PROPORTIONS} SELECT feature_cat, n_above, n_below, round(above_thresh, 6) AS above_thresh,
        round(below_thresh, 6) AS below_thresh, round(above_thresh - below_thresh, 6) AS prop_diff FROM props""",
    ),
    "permutation_test": (_permutation, PERMUTATION_SQL),
    "category_difference": (
        lambda spark, sf: J.category_diff(
            sides(spark, sf).where("side = 'above'").select("f1"), sides(spark, sf).where("side = 'below'").select("f1"), "f1"
        ),
        f"""WITH {SIDES}, a AS (SELECT DISTINCT f1 FROM sides WHERE side = 'above'), b AS (SELECT DISTINCT f1 FROM sides WHERE side = 'below')
        SELECT f1 AS value, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT f1, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    ),
    "category_union": (
        lambda spark, sf: J.union_values(pairs(spark, sf), ["f1", "f2"]),
        f"WITH {PAIRS} SELECT f1 AS value FROM pairs UNION SELECT f2 FROM pairs",
    ),
    "pairs_sorted": (
        lambda spark, sf: rounded(R.sort_pairs(pairs(spark, sf)), "MR"),
        f"WITH {PAIRS} SELECT f1, f2, round(MR, 6) AS MR FROM pairs ORDER BY pairs.MR, f1, f2",
    ),
    "pair_sequence": (
        lambda spark, sf: rounded(R.with_sequence(pairs(spark, sf), ["MR", "f1", "f2"]), "MR"),
        f"""WITH {PAIRS} SELECT f1, f2, round(MR, 6) AS MR,
        row_number() OVER (ORDER BY pairs.MR, f1, f2) - 1 AS seq FROM pairs""",
    ),
    "top_features": (
        lambda spark, sf: R.top_features(
            importances(spark, sf).groupBy(F.col("f1").alias("feature")).agg(F.sum("v").alias("importance")), 20
        ),
        f"WITH {IMPORTANCES} SELECT f1 AS feature, sum(v) AS importance FROM imp GROUP BY f1 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "top_percent": (
        lambda spark, sf: rounded(R.top_percent(pairs(spark, sf), "MR", 5), "MR"),
        f"""WITH {PAIRS}, r AS (SELECT *, percent_rank() OVER (ORDER BY MR) AS p FROM pairs)
        SELECT f1, f2, round(MR, 6) AS MR FROM r WHERE p <= 0.05""",
    ),
    "score_threshold": (
        lambda spark, sf: R.filter_by_score(importances(spark, sf), _scores(spark, sf)),
        f"""WITH {IMPORTANCES} SELECT f1, f2, v FROM imp WHERE f2 IN (
          SELECT list_element(['go','tpm','pfa','ppi','pep','zzz'], CAST(s_suppkey % 6 + 1 AS INTEGER)) || '_' || s_suppkey
          FROM supplier WHERE s_acctbal / 10000 >= 0.4)""",
    ),
    "score_threshold_mutual_rank": (
        lambda spark, sf: rounded(
            R.mutual_rank_nonzero(R.filter_by_score(importances(spark, sf), _scores(spark, sf))), "MR"
        ),
        "WITH " + PAIRS.replace("FROM imp WHERE v <> 0", """FROM imp WHERE v <> 0 AND f2 IN (
          SELECT list_element(['go','tpm','pfa','ppi','pep','zzz'], CAST(s_suppkey % 6 + 1 AS INTEGER)) || '_' || s_suppkey
          FROM supplier WHERE s_acctbal / 10000 >= 0.4)""") + " SELECT f1, f2, round(MR, 6) AS MR FROM pairs",
    ),
    "ranked_importance": (
        lambda spark, sf: R.ranked_importance(
            importances(spark, sf).select(F.col("f2").alias("model"), F.col("f1").alias("feature"), F.col("v").alias("importance")), "model"
        ),
        f"""WITH {IMPORTANCES} SELECT f2 AS model, f1 AS feature, v AS importance,
        row_number() OVER (PARTITION BY f2 ORDER BY v DESC, f1) AS position FROM imp""",
    ),
    "mean_importance": (
        lambda spark, sf: rounded(
            A.mean_importance(importances(spark, sf).select(F.col("f1").alias("feature"), F.col("v").alias("importance"))), "importance"
        ),
        f"WITH {IMPORTANCES} SELECT f1 AS feature, round(avg(v), 6) AS importance FROM imp GROUP BY f1",
    ),
}
