"""Splits, balancing and shuffles in md5 order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as P
from ..operators import sampling as X
from ..operators.joining import minus_keys
from .tables import IMPORTANCES, PEOPLE, hash_int_sql, hash_sql, importances, people, rounded, table

SEED = 42
NUMBERED = f"""
num AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) AS r,
               count(*) OVER (PARTITION BY y) AS n FROM people)"""

N_CLASS = "floor((SELECT count(*) FROM people WHERE y = 1) / 10)"


def _train_balanced(spark, sf):
    """Hold out a fixed number per class, then balance the rest."""
    rows = people(spark, sf)
    parts = X.holdout_n_per_class(rows, "y", "key", None, SEED)
    train = minus_keys(rows, parts.where("part = 'test'"), "key")
    return X.undersample(train, "y", "key", 7)


def _cells(spark, sf):
    return P.melt(
        table(spark, sf, "part").select(
            F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
        ),
        "key",
    )


CELLS = """
cells AS (SELECT p_partkey AS key, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part
          UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part)"""


def _shuffled_order(spark, sf):
    return X.shuffle_rows(people(spark, sf), "key", SEED).select("key", "y")


# Width of the given embeddings; the sign of the first number doubles as a category.
DIMS = 64


def _smote(spark, sf):
    """Minority labels of the embeddings made as many as all others."""
    vectors = table(spark, sf, "embeddings")
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(DIMS)]
    wide = vectors.select(
        F.col("vec_id").alias("key"), (F.col("label") == 0).cast("int").alias("y"),
        *cols, (F.element_at("embedding", 1) > 0).cast("int").alias("sign"),
    )
    made = X.smote_nc(wide, "y", "key", XS, ["sign"], k=5, seed=SEED)
    return rounded(made, *XS)


XS = [f"x{i}" for i in range(DIMS)]
SMOTE_SQL = f"""WITH wide AS (
  SELECT CAST(vec_id AS VARCHAR) AS key, CAST(label = 0 AS INTEGER) AS y,
         {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}' for i in range(DIMS))}, CAST(embedding[1] > 0 AS INTEGER) AS sign
  FROM embeddings),
pool AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(SEED, 'key')}) AS r FROM wide WHERE y = 1),
spread AS ({' UNION ALL '.join(f'SELECT stddev_pop(x{i}) AS s FROM pool' for i in range(DIMS))}),
d AS (SELECT a.key AS key, b.key AS other, b.sign AS osign, {', '.join(f'b.x{i} AS o{i}' for i in range(DIMS))},
        {' + '.join(f'(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})' for i in range(DIMS))}
          + CASE WHEN a.sign <> b.sign THEN (SELECT median(s) * median(s) FROM spread) ELSE 0 END AS dist
      FROM pool a JOIN pool b ON a.key <> b.key),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, other) AS place FROM d) WHERE place <= 5),
votes AS (SELECT key, osign, count(*) AS n FROM near GROUP BY 1, 2),
modes AS (SELECT key, osign AS sign FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, osign) AS i FROM votes) WHERE i = 1),
draws AS (SELECT id, {hash_int_sql(f'{SEED}:base', 'id')} % (SELECT count(*) FROM pool) + 1 AS r,
            {hash_int_sql(f'{SEED}:pick', 'id')} % 5 + 1 AS place, {hash_int_sql(f'{SEED}:gap', 'id')} / CAST(4503599627370496 AS DOUBLE) AS gap
          FROM range((SELECT count(*) FILTER (y = 0) - count(*) FILTER (y = 1) FROM wide)) t(id))
SELECT key, y, {', '.join(f'round(x{i}, 6) AS x{i}' for i in range(DIMS))}, sign, false AS synthetic FROM wide
UNION ALL
SELECT 'syn_' || id, 1, {', '.join(f'round(x{i} + gap * (o{i} - x{i}), 6)' for i in range(DIMS))}, modes.sign, true
FROM draws JOIN pool USING (r) JOIN near ON near.key = pool.key AND near.place = draws.place JOIN modes ON modes.key = pool.key"""


QUERIES = {
    "stratified_holdout": (
        lambda spark, sf: X.stratified_holdout(people(spark, sf), "y", "key", 0.1, SEED),
        f"WITH {PEOPLE}, {NUMBERED} SELECT key, y, nation, balance, CASE WHEN r <= round(n * 0.1) THEN 'test' ELSE 'train' END AS part FROM num",
    ),
    "plain_holdout": (
        lambda spark, sf: X.holdout(people(spark, sf), "key", 0.2, SEED),
        f"""WITH {PEOPLE}, num AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(SEED, 'key')}) AS r, count(*) OVER () AS n FROM people)
        SELECT key, y, nation, balance, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM num""",
    ),
    "holdout_n_per_class": (
        lambda spark, sf: X.holdout_n_per_class(people(spark, sf), "y", "key", None, SEED),
        f"WITH {PEOPLE}, {NUMBERED} SELECT key, y, nation, balance, CASE WHEN r <= {N_CLASS} THEN 'test' ELSE 'train' END AS part FROM num",
    ),
    "rows_minus_sample": (
        lambda spark, sf: minus_keys(
            people(spark, sf), X.holdout_n_per_class(people(spark, sf), "y", "key", 40, SEED).where("part = 'test'"), "key"
        ),
        f"WITH {PEOPLE}, {NUMBERED} SELECT key, y, nation, balance FROM num WHERE r > 40",
    ),
    "undersample": (
        lambda spark, sf: X.undersample(people(spark, sf), "y", "key", SEED),
        f"WITH {PEOPLE}, {NUMBERED} SELECT key, y, nation, balance FROM num WHERE r <= (SELECT min(n) FROM num)",
    ),
    "split_and_balance": (
        _train_balanced,
        f"""WITH {PEOPLE}, {NUMBERED}, train AS (SELECT key, y, nation, balance FROM num WHERE r > {N_CLASS}),
        b AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(7, 'key')}) AS r, count(*) OVER (PARTITION BY y) AS n FROM train)
        SELECT key, y, nation, balance FROM b WHERE r <= (SELECT min(n) FROM b)""",
    ),
    "oversample": (
        lambda spark, sf: X.oversample(people(spark, sf), "y", "key", 1, 1000, SEED),
        f"""WITH {PEOPLE}, pool AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(SEED, 'key')}) AS r FROM people WHERE y = 1),
        draws AS (SELECT {hash_int_sql(SEED, 'id')} % (SELECT count(*) FROM pool) + 1 AS r FROM range(1000) t(id))
        SELECT key, y, nation, balance FROM people WHERE y <> 1
        UNION ALL SELECT key, y, nation, balance FROM draws JOIN pool USING (r)""",
    ),
    "stratified_folds": (
        lambda spark, sf: X.with_folds(people(spark, sf), "y", "key", 5, SEED),
        f"WITH {PEOPLE}, {NUMBERED} SELECT key, y, nation, balance, CAST(r % 5 AS INTEGER) AS fold FROM num",
    ),
    "shuffle_features": (
        lambda spark, sf: X.shuffle_features(_cells(spark, sf), SEED),
        f"""WITH {CELLS},
        k AS (SELECT key, feature, row_number() OVER (PARTITION BY feature ORDER BY {hash_sql(f'{SEED}:k', 'feature', 'key')}) AS r FROM cells),
        v AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY {hash_sql(f'{SEED}:1', 'feature', 'key')}) AS r FROM cells)
        SELECT key, feature, value FROM k JOIN v USING (feature, r)""",
    ),
    "random_features": (
        lambda spark, sf: X.random_features(importances(spark, sf).select(F.col("f1").alias("feature")), 30, 5, SEED),
        f"""WITH {IMPORTANCES}, d AS (SELECT * FROM (SELECT DISTINCT f1 AS feature FROM imp), range(1, 6) t(draw)),
        n AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {hash_sql(SEED, 'draw', 'feature')}) AS r FROM d)
        SELECT CAST(draw AS INTEGER) AS draw, feature FROM n WHERE r <= 30""",
    ),
    "shuffle_rows": (
        _shuffled_order,
        f"WITH {PEOPLE} SELECT key, y FROM people ORDER BY {hash_sql(SEED, 'key')}",
    ),
    "smote_nc": (_smote, SMOTE_SQL),
}
