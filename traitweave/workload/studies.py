"""Studies with Gaussian naive Bayes on the embeddings, whose every number SQL can say: resampling within folds, repeated runs,
feature blocks, nested folds, permuted features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import resampling as R
from ..operators import studies as ST
from ..operators import tuning as TU
from ..operators.evaluation import prediction_table
from ..operators.sampling import stratified_holdout, with_folds
from ..session import scratch
from ..sources import results as RES
from .models import _EMBEDDED, SEED, _bayes_sql, vectors
from .tables import hash_int_sql, hash_sql, rounded

WIDTH = 64
NAMES = [f"e{i}" for i in range(WIDTH)]
BLOCKS, RUNS, REPEATS = (8, 64), 2, 3

_CONF = """count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 0 AND h = 1) AS fp,
  count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 1 AND h = 1) AS tp"""
_PRF = """tn, fp, fn, tp, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
  coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall"""


def _bayes():
    return M.naive_bayes("gaussian")


def _wide(spark, sf):
    """A column per dimension."""
    rows = vectors(spark, sf).select("key", "label", vector_to_array("features").alias("x"))
    return rows.select("key", "label", *[F.col("x")[i].alias(c) for i, c in enumerate(NAMES)])


def _resampled(spark, sf):
    """Balanced by leaving rows out, or by drawing rows again, within the training part of each fold."""
    rows = with_folds(vectors(spark, sf), "label", "key", 3, SEED).persist()
    models = {"under": R.undersampled(_bayes(), seed=SEED), "over": R.oversampled(_bayes(), seed=SEED)}
    return TU.compare_models(rows, models, "fold")


RESAMPLED_SQL = f"""WITH e AS ({_EMBEDDED}),
f AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) % 3 AS fold FROM e),
t AS (SELECT CAST(k AS VARCHAR) AS k, key, y, v, fold = k AS test FROM f, range(3) t(k)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, y ORDER BY {hash_sql(SEED, 'key')}) AS r, count(*) OVER (PARTITION BY k, y) AS n FROM t WHERE NOT test),
few AS (SELECT k, count(*) FILTER (y = 1) AS few, count(*) FILTER (y = 0) AS many FROM r GROUP BY k),
draws AS (SELECT k, {hash_int_sql(SEED, 'id')} % few + 1 AS r FROM (SELECT k, few, unnest(range(many)) AS id FROM few)),
{_bayes_sql('''SELECT 'under|' || k AS g, key, y, v, test FROM r JOIN few USING (k) WHERE r <= least(few, many)
  UNION ALL SELECT 'over|' || k, key, y, v, test FROM r WHERE y = 0 UNION ALL SELECT 'over|' || k, key, y, v, test FROM draws JOIN r USING (k, r) WHERE y = 1
  UNION ALL SELECT how || k, key, y, v, test FROM t, (VALUES ('under|'), ('over|')) m(how) WHERE test''')},
conf AS (SELECT g, {_CONF} FROM pred WHERE test GROUP BY g)
SELECT split_part(g, '|', 1) AS model, CAST(split_part(g, '|', 2) AS INTEGER) AS fold, {_PRF} FROM conf"""


def _runs_sql(groups: str, columns: str, shuffled: bool) -> str:
    """CTEs of runs: a tenth of the positives from each class is left out, the rest is balanced.

    ``groups`` lists ``(g, seed, k)``; ``k`` dimensions are used.
    """
    mixed = """,
cell AS (SELECT *, {kh} AS kh, {vh} AS vh FROM (SELECT g, seed, key, unnest(range(0, k)) AS i, unnest(v[1:k]) AS x FROM balanced WHERE mixed)),
kr AS (SELECT g, key, i, row_number() OVER (PARTITION BY g, i ORDER BY kh) AS r FROM cell),
vr AS (SELECT g, x, i, row_number() OVER (PARTITION BY g, i ORDER BY vh) AS r FROM cell),
moved AS (SELECT g, key, list(x ORDER BY i) AS v FROM kr JOIN vr USING (g, i, r) GROUP BY 1, 2)""".format(
        kh="md5(concat_ws('|', seed || ':shuffle:k', 'e' || i, key))", vh="md5(concat_ws('|', seed || ':shuffle:1', 'e' || i, key))")
    return f"""e AS ({_EMBEDDED}),
groups AS ({groups}),
cut AS (SELECT g, seed, k, mixed, key, y, v, row_number() OVER (PARTITION BY g, y ORDER BY md5(concat_ws('|', seed || ':split', key))) AS r,
          floor((SELECT sum(y) FROM e) / 10) AS n FROM e, groups),
train AS (SELECT *, row_number() OVER (PARTITION BY g, y ORDER BY md5(concat_ws('|', seed || ':balance', key))) AS b, count(*) OVER (PARTITION BY g, y) AS c FROM cut WHERE r > n),
balanced AS (SELECT * FROM (SELECT *, min(c) OVER (PARTITION BY g) AS least FROM train) WHERE b <= least){mixed if shuffled else ''},
{_bayes_sql("SELECT g, key, y, v[1:k] AS v, FALSE AS test FROM balanced" + (" WHERE NOT mixed UNION ALL SELECT b.g, b.key, b.y, m.v, FALSE FROM balanced b JOIN moved m USING (g, key)" if shuffled else "")
            + " UNION ALL SELECT g, key, y, v[1:k], TRUE FROM cut WHERE r <= n")},
conf AS (SELECT g, {_CONF} FROM pred WHERE test GROUP BY g)
SELECT {columns}, {_PRF} FROM conf JOIN groups USING (g)"""


def _repeated(spark, sf):
    return ST.repeated_runs(_wide(spark, sf).persist(), "key", NAMES, [], {"bayes": _bayes()}, RUNS, SEED)


REPEATED_SQL = "WITH " + _runs_sql(
    f"SELECT run AS g, '{SEED}:' || run AS seed, {WIDTH} AS k, FALSE AS mixed, CAST(run AS INTEGER) AS run FROM range({RUNS}) t(run)", "run, 'bayes' AS model", False
)


def _blocks(spark, sf):
    """Growing blocks of dimensions, as they are and with every training column shuffled."""
    return ST.feature_block_curve(_wide(spark, sf).persist(), "key", NAMES, NAMES, BLOCKS, RUNS, lambda run: _bayes(), SEED)


BLOCKS_SQL = "WITH " + _runs_sql(
    f"""SELECT k || '|' || run || '|' || random AS g, '{SEED}:' || k || ':' || run AS seed, CAST(k AS INTEGER) AS k, random = 'y' AS mixed, CAST(run AS INTEGER) AS run, random,
    CAST(k AS INTEGER) AS num_features FROM (SELECT unnest({list(BLOCKS)}) AS k), range({RUNS}) t(run), (VALUES ('n'), ('y')) m(random)""",
    "num_features, run, random", True,
)


def _nested(spark, sf):
    """One setting to choose from: what is tested are the folds and the bookkeeping."""
    return TU.nested_cv(vectors(spark, sf), {"bayes": (_bayes(), {"smoothing": [1.0]})}, outer=3, inner=2, n_iter=1, seed=SEED)


NESTED_SQL = f"""WITH e AS ({_EMBEDDED}),
f AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(f'{SEED}:outer', 'key')}) % 3 AS fold FROM e),
{_bayes_sql("SELECT g, key, y, v, fold = g AS test FROM f, range(3) t(g)")},
conf AS (SELECT g, {_CONF} FROM pred WHERE test GROUP BY g)
SELECT 'bayes' AS model, CAST(g AS INTEGER) AS fold, 'smoothing=1.0' AS params, {_PRF} FROM conf"""


def _permuted(spark, sf):
    parts = stratified_holdout(vectors(spark, sf), "label", "key", 0.2, SEED).persist()
    model = _bayes().fit(parts.where("part = 'train'"))
    return rounded(ST.permutation_importance(model, parts.where("part = 'test'"), NAMES, REPEATS, SEED), "importance")


# A score is a sum over dimensions, so a swapped value changes one of its terms.
PERMUTED_SQL = f"""WITH e AS ({_EMBEDDED}),
n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) <= round(count(*) OVER (PARTITION BY y) * 0.2) AS test FROM e),
cells AS (SELECT key, y, test, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM n),
prior AS (SELECT y AS c, ln(count(*) / sum(count(*)) OVER ()) AS p FROM n WHERE NOT test GROUP BY y),
stats AS (SELECT y AS c, i, avg(x) AS m, var_pop(x) AS s FROM cells WHERE NOT test GROUP BY 1, 2),
whole AS (SELECT key, y, c, any_value(p) + sum(-0.5 * ln(s) - (x - m) * (x - m) / (2 * s)) AS score FROM cells JOIN stats USING (i) JOIN prior USING (c) WHERE test GROUP BY 1, 2, 3),
base AS (SELECT avg(CAST(h = y AS INTEGER)) AS base FROM (SELECT key, y, max_by(c, score) AS h FROM whole GROUP BY 1, 2)),
copies AS (SELECT key, y, i, x, perm, perm || '|' || i AS feature FROM cells, range({REPEATS}) t(perm) WHERE test),
kr AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY {hash_sql(f'{SEED}:k', 'feature', 'key')}) AS r FROM copies),
vr AS (SELECT feature, x AS swapped, row_number() OVER (PARTITION BY feature ORDER BY {hash_sql(f'{SEED}:1', 'feature', 'key')}) AS r FROM copies),
again AS (SELECT perm, i, key, kr.y, c, score + (x - m) * (x - m) / (2 * s) - (swapped - m) * (swapped - m) / (2 * s) AS score
          FROM kr JOIN vr USING (feature, r) JOIN stats USING (i) JOIN whole USING (key, c)),
said AS (SELECT perm, i, key, y, max_by(c, score) AS h FROM again GROUP BY 1, 2, 3, 4)
SELECT CAST(perm AS INTEGER) AS perm, 'e' || i AS feature, round(any_value(base) - avg(CAST(h = y AS INTEGER)), 6) AS importance FROM said, base GROUP BY 1, 2"""


def _saved(spark, sf):
    """Fit, save, load, predict the rows held out."""
    parts = stratified_holdout(vectors(spark, sf), "label", "key", 0.1, SEED)
    path = scratch(spark, "bayes")
    RES.save_model(Pipeline(stages=[_bayes()]).fit(parts.where("part = 'train'")), path)
    return prediction_table(RES.load_model(path), parts.where("part = 'test'")).select("key", "y_true", "y_hat", F.round("score", 6).alias("score"))


SAVED_SQL = f"""WITH e AS ({_EMBEDDED}),
n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) <= round(count(*) OVER (PARTITION BY y) * 0.1) AS test FROM e),
{_bayes_sql("SELECT 0 AS g, key, y, v, test FROM n")},
odds AS (SELECT key, max(score) FILTER (c = 1) - max(score) FILTER (c = 0) AS d FROM scored GROUP BY key)
SELECT key, CAST(y AS DOUBLE) AS y_true, CAST(h AS DOUBLE) AS y_hat, round(CASE WHEN d > 0 THEN 1 / (1 + exp(-d)) ELSE exp(d) / (1 + exp(d)) END, 6) AS score
FROM pred JOIN odds USING (key) WHERE test"""


QUERIES = {
    "saved_naive_bayes": (_saved, SAVED_SQL),
    "resampled_naive_bayes": (_resampled, RESAMPLED_SQL),
    "naive_bayes_runs": (_repeated, REPEATED_SQL),
    "naive_bayes_blocks": (_blocks, BLOCKS_SQL),
    "naive_bayes_nested": (_nested, NESTED_SQL),
    "naive_bayes_permuted": (_permuted, PERMUTED_SQL),
}
