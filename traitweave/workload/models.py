"""Preprocessing, models, tuning and studies on labelled documents and vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import estimators as ES
from ..operators import evaluation as E
from ..operators import forests as FO
from ..operators import models as M
from ..operators import prep
from ..operators import studies as ST
from ..operators import tuning as TU
from ..operators.neighbours import knn
from ..operators.sampling import holdout, stratified_holdout, with_folds
from ..session import scratch
from ..sources import results as RES
from .tables import CATEGORICAL, CONTINUOUS, documents_wide, hash_sql, rounded, table

SEED = 42
SMALL = {"n_estimators": 5, "max_depth": 5}


def _holes(spark, sf):
    """Long customer matrix with missing balances; nation 3 is missing as well."""
    wide = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_acctbal")).alias("balance"),
        F.nullif("c_nationkey", F.lit(3)).cast("double").alias("nation"),
    )
    return wide.unpivot(["key"], ["balance", "nation"], "feature", "value")


HOLES = """
holes AS (SELECT c_custkey AS key, 'balance' AS feature, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal END AS value FROM customer
          UNION ALL SELECT c_custkey, 'nation', CAST(nullif(c_nationkey, 3) AS DOUBLE) FROM customer),
med AS (SELECT feature, median(value) AS median FROM holes GROUP BY feature),
filled AS (SELECT key, feature, coalesce(value, median) AS value FROM holes JOIN med USING (feature)),
stats AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std FROM filled GROUP BY feature)"""


def _filled(spark, sf):
    long = _holes(spark, sf)
    return prep.apply_median(long, prep.fit_median(long))


def _scaled(spark, sf):
    long = _filled(spark, sf)
    return rounded(prep.apply_scaler(long, prep.fit_scaler(long)), "value", digits=5)


def _preprocessed(spark, sf):
    wide = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_acctbal")).alias("balance"),
        F.nullif("c_nationkey", F.lit(3)).alias("nation"),
    )
    out = prep.preprocessor(["balance"], ["nation"]).fit(wide).transform(wide)
    return rounded(out.select("key", "prep_balance", "prep_nation"), "prep_balance", digits=5)


def _embedded(spark, sf):
    """Embeddings with a held-out tenth per class."""
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )
    return stratified_holdout(rows, "label", "key", 0.1, SEED).persist()


def _knn(p, weights):
    def run(spark, sf):
        rows = _embedded(spark, sf)
        return knn(rows.where("part = 'train'"), rows.where("part = 'test'"), 5, p, weights).select("key", "prediction")

    return run


def knn_sql(p: int, weights: str) -> str:
    return f"""WITH num AS (SELECT vec_id AS key, label, CAST(embedding AS DOUBLE[]) AS vec,
      row_number() OVER (PARTITION BY label ORDER BY {hash_sql(SEED, 'vec_id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    d AS (SELECT a.key AS key, b.key AS id, b.label,
            pow(list_sum(list_transform(range(1, len(a.vec) + 1), lambda i: pow(abs(a.vec[i] - b.vec[i]), {p}))), 1.0 / {p}) AS dist
          FROM num a, num b WHERE a.r <= round(a.n * 0.1) AND b.r > round(b.n * 0.1)),
    near AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, id) AS place FROM d),
    w AS (SELECT key, label, sum({'1.0' if weights == 'uniform' else '1.0 / dist'}) AS w FROM near WHERE place <= 5 GROUP BY 1, 2)
    SELECT key, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC, label) AS r FROM w) WHERE r = 1"""


def vectors(spark, sf):
    """Embeddings as MLlib vectors: one class against the others."""
    rows = table(spark, sf, "embeddings")
    return rows.select(
        F.col("vec_id").alias("key"), (F.col("label") == 0).cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )


def _fitted(make):
    """Train on nine tenths of each class, score the rest: one confusion row."""

    def run(spark, sf):
        parts = stratified_holdout(vectors(spark, sf), "label", "key", 0.1, SEED)
        train = prep.with_balanced_weight(parts.where("part = 'train'"), "label").persist()
        model = make(train)
        return E.prf(E.confusion(E.prediction_table(model, parts.where("part = 'test'"))))

    return run


def _documents(spark, sf):
    return documents_wide(spark, sf)


def _ready(spark, sf):
    """Documents as vectors, preprocessed on all rows."""
    wide = _documents(spark, sf)
    rows = prep.preprocessor(CONTINUOUS, CATEGORICAL).fit(wide).transform(wide).select("key", "label", "features")
    return prep.with_balanced_weight(rows, "label")


def _weighted(spark, sf):
    """Documents as they are: what is fitted on them is fitted within the training part of each fold."""
    return prep.with_balanced_weight(_documents(spark, sf), "label")


def _piped(estimator):
    return prep.preprocessor(CONTINUOUS, CATEGORICAL, estimator)


def _saved(spark, sf):
    """Fit, save, load, predict the rows held out."""
    parts = stratified_holdout(_documents(spark, sf), "label", "key", 0.1, SEED)
    model = prep.preprocessor(CONTINUOUS, CATEGORICAL, M.rf_classifier(**SMALL)).fit(parts.where("part = 'train'"))
    path = scratch(spark, "model")
    RES.save_model(model, path)
    return E.prediction_table(RES.load_model(path), parts.where("part = 'test'"))


def _oob(spark, sf):
    rows = prep.with_balanced_weight(vectors(spark, sf), "label").persist()
    return E.prf(E.confusion(M.oob_evaluate(rows, 8, {"max_depth": 6}, SEED, weight="weight")))


def _oob_regression(spark, sf):
    """Length of a document from its other columns."""
    wide = _documents(spark, sf).withColumn("label", F.col("pep_chars"))
    rows = prep.preprocessor(CONTINUOUS[1:], CATEGORICAL).fit(wide).transform(wide).select("key", "label", "features")
    return E.r_squared(M.oob_evaluate(rows.persist(), 5, {"max_depth": 6, "max_features": "1.0"}, SEED, regression=True))


def _balanced(spark, sf):
    return E.prf(E.confusion(M.balanced_rf(vectors(spark, sf), 8, {"max_depth": 6}, SEED)))


def _regressor(spark, sf):
    """Price of an order line from quantity, discount and tax."""
    items = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("key"),
        F.col("l_extendedprice").alias("label"), "l_quantity", "l_discount", "l_tax",
    )
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(items)
    parts = holdout(rows, "key", 0.1, SEED)
    model = M.rf_regressor(n_estimators=5, max_features="1.0", max_depth=6).fit(parts.where("part = 'train'"))
    return E.r_squared(E.prediction_table(model, parts.where("part = 'test'")))


def _complement(spark, sf):
    """Needs counts: words and lines of documents as they are."""
    cols = ["pep_words", "pep_lines", *CATEGORICAL]
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(_documents(spark, sf)).select("key", "label", "features")
    parts = stratified_holdout(rows, "label", "key", 0.1, SEED)
    model = M.naive_bayes("complement").fit(parts.where("part = 'train'"))
    return E.prf(E.confusion(E.prediction_table(model, parts.where("part = 'test'"))))


_SCORES = """
pred AS (SELECT key, y, max_by(c, score) AS h FROM scored GROUP BY key, y),
conf AS (SELECT count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 0 AND h = 1) AS fp,
  count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 1 AND h = 1) AS tp FROM pred)
SELECT tn, fp, fn, tp, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
  coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM conf"""

# Balanced weights make the priors equal and leave means and variances within a class as they are.
GAUSSIAN_SQL = f"""WITH num AS (
  SELECT vec_id AS key, CAST(label = 0 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS v,
    row_number() OVER (PARTITION BY label = 0 ORDER BY {hash_sql(SEED, 'vec_id')}) AS r, count(*) OVER (PARTITION BY label = 0) AS n FROM embeddings),
cells AS (SELECT key, y, r <= round(n * 0.1) AS test, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM num),
stats AS (SELECT y AS c, i, avg(x) AS m, var_pop(x) AS s FROM cells WHERE NOT test GROUP BY 1, 2),
scored AS (SELECT key, y, c, sum(-0.5 * ln(s) - (x - m) * (x - m) / (2 * s)) AS score FROM cells JOIN stats USING (i) WHERE test GROUP BY 1, 2, 3),
{_SCORES}"""

# A class is weighed by how rare its features are in the other class, with one added to every count.
COMPLEMENT_SQL = rf"""WITH wide AS (
  SELECT doc_id AS key, CAST(toxic AS INTEGER) AS y, [len(string_split_regex(text, '\s+')), len(string_split(text, chr(10))),
    CAST(lang = 'en' AS INTEGER), CAST(lang = 'fr' AS INTEGER), CAST(lang = 'de' AS INTEGER), CAST(lang = 'es' AS INTEGER),
    quality, CAST(regexp_matches(text, '[0-9]') AS INTEGER)] AS v FROM documents JOIN labels USING (doc_id)),
num AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) AS r, count(*) OVER (PARTITION BY y) AS n FROM wide),
cells AS (SELECT key, y, r <= round(n * 0.1) AS test, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM num),
others AS (SELECT 1 - y AS c, i, sum(x) + 1 AS s FROM cells WHERE NOT test GROUP BY 1, 2),
logs AS (SELECT c, i, -ln(s / sum(s) OVER (PARTITION BY c)) AS w FROM others),
scored AS (SELECT key, y, c, sum(x * w) AS score FROM cells JOIN logs USING (i) WHERE test GROUP BY 1, 2, 3),
{_SCORES}"""


def _grid(spark, sf):
    rows = with_folds(_weighted(spark, sf), "label", "key", 3, SEED).persist()
    grid = {"numTrees": [3, 5], "maxDepth": [3, 5]}
    return TU.grid_search(rows, _piped(M.rf_classifier(**SMALL, weight="weight")), grid, "fold").results


def _random(spark, sf):
    rows = with_folds(_weighted(spark, sf), "label", "key", 3, SEED).persist()
    grid = {"numTrees": [3, 5, 8], "maxDepth": [2, 3, 5], "minInfoGain": [0.0, 0.001, 0.001]}
    return TU.random_search(rows, _piped(M.rf_classifier(**SMALL, weight="weight")), grid, 4, SEED, "fold", "precision").results


def _drawn(spark, sf):
    rows = with_folds(_weighted(spark, sf), "label", "key", 3, SEED).persist()
    dists = {"regParam": ("loguniform", 1e-4, 1e-1), "maxIter": ("int", 10, 30)}
    candidates = TU.draw_params(dists, 3, SEED)
    return TU.search(rows, _piped(M.logistic(rows.count(), weight="weight")), candidates, "fold").results


def _nested(spark, sf):
    rows = _weighted(spark, sf).persist()
    models = {"tree": (_piped(M.decision_tree(max_depth=4, weight="weight")), {"maxDepth": [2, 4]})}
    return TU.nested_cv(rows, models, outer=3, inner=2, n_iter=2, seed=SEED)


def _compare(spark, sf):
    rows = with_folds(_weighted(spark, sf), "label", "key", 3, SEED).persist()
    models = {"tree": _piped(M.decision_tree(max_depth=4, weight="weight")), "forest": _piped(M.rf_classifier(**SMALL, weight="weight"))}
    return TU.compare_models(rows, models, "fold")


def _boost_search(spark, sf):
    """Rounds by learning rate, as the studied grids of nine candidates: three folds and three rates take each round together."""
    rows = with_folds(vectors(spark, sf), "label", "key", 3, SEED)
    return FO.boosting_grid(rows, [10, 20, 50], [0.1, 0.5, 1.0], seed=SEED)


def _knn_search(spark, sf):
    rows = with_folds(vectors(spark, sf), "label", "key", 3, SEED).persist()
    return rounded(ES.knn_grid(rows, [3, 5, 9], ["uniform", "distance"]), "mean", "std")


def _five(spark, sf):
    """The studied kinds of model, and nearest neighbours, on the same folds."""
    rows = with_folds(prep.with_balanced_weight(vectors(spark, sf), "label"), "label", "key", 3, SEED).persist()
    models = {
        "forest": M.rf_classifier(**SMALL, weight="weight"), "boost": ES.AdaBoost(10, seed=SEED), "near": ES.KNearest(),
        "balanced": FO.BaggedForest(20, 5, bags="balanced", seed=SEED), "logistic": M.logistic(rows.count(), weight="weight"), "svm": M.linear_svm(rows.count(), weight="weight"),
    }
    return TU.compare_models(rows, models, "fold")


KNN_SEARCH_SQL = f"""WITH e AS (SELECT vec_id AS key, CAST(label = 0 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) % 3 AS fold FROM e),
d AS (SELECT a.key, a.y, a.fold, b.key AS id, b.y AS label, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
      FROM f a JOIN f b ON a.fold <> b.fold),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, id) AS place FROM d) WHERE place <= 9),
grid AS (SELECT k, w, CAST(row_number() OVER (ORDER BY i, j) - 1 AS INTEGER) AS candidate
         FROM (VALUES (1, 3), (2, 5), (3, 9)) a(i, k), (VALUES (1, 'uniform'), (2, 'distance')) b(j, w)),
votes AS (SELECT candidate, k, w, fold, key, y, label, sum(CASE WHEN w = 'uniform' THEN 1.0
            WHEN least_dist = 0 THEN CAST(dist = 0 AS INTEGER) ELSE 1.0 / dist END) AS s
          FROM (SELECT *, min(dist) OVER (PARTITION BY key) AS least_dist FROM near), grid WHERE place <= k GROUP BY ALL),
said AS (SELECT candidate, k, w, fold, key, y, first(label ORDER BY s DESC, label) AS h FROM votes GROUP BY 1, 2, 3, 4, 5, 6),
scores AS (SELECT candidate, k, w, fold, avg(CAST(h = y AS INTEGER)) AS score FROM said GROUP BY 1, 2, 3, 4)
SELECT candidate, 'k=' || k || ', weights=' || w AS params, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std
FROM scores GROUP BY candidate, k, w"""


def _compare_bayes(spark, sf):
    """Gaussian naive Bayes on the folds of the embeddings."""
    rows = with_folds(vectors(spark, sf), "label", "key", 3, SEED).persist()
    return TU.compare_models(rows, {"bayes": M.naive_bayes("gaussian")}, "fold")


def _curve_bayes(spark, sf):
    found = ST.learning_curve(vectors(spark, sf), M.naive_bayes("gaussian"), FRACTIONS, 3, SEED)
    return rounded(found, "mean", "std")


FRACTIONS = [0.1, 0.4, 0.7, 1.0]


def _bayes_sql(parts: str) -> str:
    """Gaussian naive Bayes for each ``g`` of rows ``(g, key, y, v, test)``; ``scored`` has one row per class."""
    return f"""parts AS ({parts}),
cells AS (SELECT g, key, y, test, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM parts),
prior AS (SELECT g, y AS c, ln(count(*) / sum(count(*)) OVER (PARTITION BY g)) AS p FROM parts WHERE NOT test GROUP BY g, y),
stats AS (SELECT g, y AS c, i, avg(x) AS m, var_pop(x) AS s FROM cells WHERE NOT test GROUP BY 1, 2, 3),
scored AS (SELECT g, key, y, test, c, any_value(p) + sum(-0.5 * ln(s) - (x - m) * (x - m) / (2 * s)) AS score
           FROM cells JOIN stats USING (g, i) JOIN prior USING (g, c) GROUP BY 1, 2, 3, 4, 5),
pred AS (SELECT g, key, y, test, max_by(c, score) AS h FROM scored GROUP BY 1, 2, 3, 4)"""


_EMBEDDED = "SELECT vec_id AS key, CAST(label = 0 AS INTEGER) AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
COMPARE_BAYES_SQL = f"""WITH e AS ({_EMBEDDED}),
f AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(SEED, 'key')}) % 3 AS fold FROM e),
{_bayes_sql("SELECT g, key, y, v, fold = g AS test FROM f, range(3) t(g)")},
conf AS (SELECT g, count(*) FILTER (y = 0 AND h = 0) AS tn, count(*) FILTER (y = 0 AND h = 1) AS fp,
  count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 1 AND h = 1) AS tp FROM pred WHERE test GROUP BY g)
SELECT 'bayes' AS model, CAST(g AS INTEGER) AS fold, tn, fp, fn, tp, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
  coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall FROM conf"""

# The rows of a part are scored twice, as training rows (t) and in the fold left out.
CURVE_BAYES_SQL = f"""WITH e AS ({_EMBEDDED}),
f AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {hash_sql(f'{SEED}:fold', 'key')}) % 3 AS fold FROM e),
o AS (SELECT k, key, y, v, fold = k AS test, row_number() OVER (PARTITION BY k, fold = k ORDER BY {hash_sql(f'{SEED}:part', 'key')}) AS r,
        count(*) OVER (PARTITION BY k, fold = k) AS n FROM f, range(3) t(k)),
{_bayes_sql("SELECT CAST(k AS VARCHAR) || '|' || fraction AS g, key, y, v, test FROM o, (SELECT unnest(" + str(FRACTIONS) + ") AS fraction) "
            "WHERE test OR r <= floor(n * fraction + 1e-9)")},
right_share AS (SELECT CAST(split_part(g, '|', 2) AS DOUBLE) AS fraction, CASE WHEN test THEN 'test' ELSE 'train' END AS part, g,
            avg(CAST(h = y AS INTEGER)) AS score FROM pred GROUP BY 1, 2, 3)
SELECT fraction, part, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM right_share GROUP BY 1, 2"""


def _importance(spark, sf):
    rows = _ready(spark, sf)
    return ST.importance_table(spark, M.rf_classifier(**SMALL, weight="weight").fit(rows), CONTINUOUS + CATEGORICAL)


def _permutation(spark, sf):
    """Preprocessing and forest are fitted on four fifths, the others are scored."""
    parts = prep.with_balanced_weight(stratified_holdout(_documents(spark, sf), "label", "key", 0.2, SEED), "label").persist()
    ready = prep.preprocessor(CONTINUOUS, CATEGORICAL).fit(parts.where("part = 'train'"))
    model = M.rf_classifier(**SMALL, weight="weight").fit(ready.transform(parts.where("part = 'train'")))
    return ST.permutation_importance(model, ready.transform(parts.where("part = 'test'")).select("key", "label", "features"), CONTINUOUS + CATEGORICAL, 5, SEED)


def _blocks(spark, sf):
    wide = _documents(spark, sf).persist()
    ranking = [r["feature"] for r in _importance(spark, sf).orderBy(F.col("importance").desc(), "feature").collect()]
    return ST.feature_block_curve(
        wide, "key", ranking, CONTINUOUS, [3, len(ranking)], 1, lambda run: M.rf_classifier(**SMALL, seed=run), SEED
    )


def _curve(spark, sf):
    return ST.learning_curve(_weighted(spark, sf), _piped(M.decision_tree(max_depth=4, weight="weight")), [0.3, 0.6, 1.0], 2, SEED)


def _repeated(spark, sf):
    wide = _documents(spark, sf).persist()
    return ST.repeated_runs(wide, "key", CONTINUOUS, CATEGORICAL, {"forest": M.rf_classifier(**SMALL)}, 2, SEED)


QUERIES = {
    "median_imputer": (
        lambda spark, sf: rounded(_filled(spark, sf), "value"),
        f"WITH {HOLES} SELECT key, feature, round(value, 6) AS value FROM filled",
    ),
    "scaler_parameters": (
        lambda spark, sf: rounded(prep.fit_scaler(_filled(spark, sf)), "mean", "std", digits=5),
        f"WITH {HOLES} SELECT feature, round(mean, 5) AS mean, round(std, 5) AS std FROM stats",
    ),
    "standard_scaler": (
        _scaled,
        f"WITH {HOLES} SELECT key, feature, round((value - mean) / std, 5) AS value FROM filled JOIN stats USING (feature)",
    ),
    "column_preprocessor": (
        _preprocessed,
        f"""WITH {HOLES} SELECT c_custkey AS key, round((value - mean) / std, 5) AS prep_balance,
        CAST(coalesce(nullif(c_nationkey, 3), 0) AS DOUBLE) AS prep_nation
        FROM customer JOIN filled ON key = c_custkey AND feature = 'balance' JOIN stats USING (feature)""",
    ),
    "balanced_weight": (
        lambda spark, sf: rounded(prep.with_balanced_weight(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic"), "weight"),
        """WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
        SELECT doc_id, toxic, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM labels JOIN c USING (toxic)""",
    ),
    "knn_uniform": (_knn(2, "uniform"), knn_sql(2, "uniform")),
    "knn_distance": (_knn(2, "distance"), knn_sql(2, "distance")),
    "knn_manhattan": (_knn(1, "uniform"), knn_sql(1, "uniform")),
    "random_forest": (_fitted(lambda t: M.rf_classifier(n_estimators=10, max_depth=8, weight="weight").fit(t)), None),
    "random_forest_regressor": (_regressor, None),
    "oob_forest": (_oob, None),
    "oob_forest_regressor": (_oob_regression, None),
    "balanced_forest": (_balanced, None),
    "decision_tree": (_fitted(lambda t: M.decision_tree(max_depth=6, weight="weight").fit(t)), None),
    "ada_boost": (_fitted(lambda t: ES.AdaBoost(50, 1.0, SEED).fit(t)), None),
    "ada_boost_search": (_boost_search, None),
    "knn_search": (_knn_search, KNN_SEARCH_SQL),
    "five_model_comparison": (_five, None),
    "gradient_boosting": (_fitted(lambda t: M.gbt(n_estimators=5, weight="weight").fit(t)), None),
    "logistic_regression": (_fitted(lambda t: M.logistic(t.count(), 1.0, 50, "weight").fit(t)), None),
    "linear_svm": (_fitted(lambda t: M.linear_svm(t.count(), 1.0, 50, "weight").fit(t)), None),
    "multilayer_perceptron": (_fitted(lambda t: M.mlp(64, 2, 50, 30).fit(t)), None),
    "gaussian_naive_bayes": (_fitted(lambda t: M.naive_bayes("gaussian", "weight").fit(t)), GAUSSIAN_SQL),
    "complement_naive_bayes": (_complement, COMPLEMENT_SQL),
    "saved_model_predictions": (_saved, None),
    "grid_search": (_grid, None),
    "random_search": (_random, None),
    "drawn_parameter_search": (_drawn, None),
    "nested_cross_validation": (_nested, None),
    "model_comparison": (_compare, None),
    "naive_bayes_comparison": (_compare_bayes, COMPARE_BAYES_SQL),
    "naive_bayes_learning_curve": (_curve_bayes, CURVE_BAYES_SQL),
    "importance_table": (_importance, None),
    "permutation_importance": (_permutation, None),
    "feature_block_curve": (_blocks, None),
    "learning_curve": (_curve, None),
    "repeated_runs": (_repeated, None),
}
