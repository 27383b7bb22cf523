"""Estimators with the studied parameters, mapped onto MLlib.

Factories return unfitted estimators on ``features`` / ``label`` (and
``weight`` where asked). Bagging with out-of-bag scores and boosting are driver
loops over MLlib trees: weights are md5 columns, so a retry sees the same bags.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hashing import hash_unit
from ..plans.joins import lookup_join
from ..session import checkpointed

# MLlib rejects deeper trees. No limit (None) means this one; a larger depth is refused rather than cut.
DEPTH_LIMIT = 30
# Poisson counts above this have a probability below 1e-12 for means up to 1.
POISSON_TERMS = 16
# Rows of a task of a linear model, which makes a job of every step of its optimiser.
PASS_ROWS = 20_000


def _depth(depth: int | None) -> int:
    if depth is not None and depth > DEPTH_LIMIT:
        raise ValueError(f"trees of depth {depth}: MLlib's limit is {DEPTH_LIMIT}")
    return DEPTH_LIMIT if depth is None else depth


def _forest_params(n_estimators, max_features, max_depth, seed, weight):
    params = dict(numTrees=n_estimators, featureSubsetStrategy=str(max_features), maxDepth=_depth(max_depth), seed=seed)
    return params | ({"weightCol": weight} if weight else {})


def rf_classifier(
    n_estimators=50, max_features="sqrt", max_depth=None, criterion="gini", seed=42, weight=None, **extra
) -> RandomForestClassifier:
    """``max_features``: ``sqrt``, a fraction or a number of features."""
    params = _forest_params(n_estimators, max_features, max_depth, seed, weight)
    return RandomForestClassifier(impurity=criterion, **params, **extra)


def rf_regressor(n_estimators=50, max_features="sqrt", max_depth=None, seed=42, weight=None, **extra):
    return RandomForestRegressor(**_forest_params(n_estimators, max_features, max_depth, seed, weight), **extra)


def decision_tree(max_depth=None, min_samples=1, criterion="gini", seed=42, weight=None, **extra):
    params = {"weightCol": weight} if weight else {}
    return DecisionTreeClassifier(
        maxDepth=_depth(max_depth), minInstancesPerNode=min_samples, impurity=criterion, seed=seed, **params, **extra
    )


def gbt(n_estimators=20, learning_rate=0.1, subsample=1.0, max_depth=3, seed=42, weight=None, **extra):
    """Gradient boosting; also stands for the extreme variant."""
    params = {"weightCol": weight} if weight else {}
    return GBTClassifier(
        maxIter=n_estimators, stepSize=learning_rate, subsamplingRate=subsample, maxDepth=_depth(max_depth),
        seed=seed, **params, **extra,
    )


class _FewTasks:
    """A fit makes hundreds of passes, each a job: in no more tasks than the rows fill."""

    tasks = 1

    def _fit(self, dataset: DataFrame):
        return super()._fit(dataset.coalesce(self.tasks))

    def of_rows(self, n_rows: int):
        self.tasks = max(1, -(-n_rows // PASS_ROWS))
        return self


class _Logistic(_FewTasks, LogisticRegression):
    pass


class _LinearSVM(_FewTasks, LinearSVC):
    pass


def logistic(n_rows: int, C=1.0, max_iter=100, weight=None, **extra) -> LogisticRegression:
    """L2 penalty 1 / (C * n): MLlib averages the loss over the rows."""
    params = {"weightCol": weight} if weight else {}
    return _Logistic(regParam=1.0 / (C * n_rows), elasticNetParam=0.0, maxIter=max_iter, **params, **extra).of_rows(n_rows)


def linear_svm(n_rows: int, C=1.0, max_iter=100, weight=None, **extra) -> LinearSVC:
    params = {"weightCol": weight} if weight else {}
    return _LinearSVM(regParam=1.0 / (C * n_rows), maxIter=max_iter, **params, **extra).of_rows(n_rows)


def mlp(n_features: int, n_classes: int = 2, hidden: int = 100, max_iter=100, seed=42, **extra):
    return MultilayerPerceptronClassifier(
        layers=[n_features, hidden, n_classes], solver="l-bfgs", maxIter=max_iter, seed=seed, **extra
    )


def naive_bayes(kind: str = "gaussian", weight=None, **extra) -> NaiveBayes:
    """``gaussian`` or ``complement``."""
    params = {"weightCol": weight} if weight else {}
    return NaiveBayes(modelType=kind, **params, **extra)


def poisson_weight(mean: float | Column, seed, key: str) -> Column:
    """Poisson draw from the md5 of ``seed|key`` by inverting the distribution.

    The rate is at most 1 (a bag draws no row more often on average); a larger
    one would be cut at ``POISSON_TERMS`` and is an error.
    """
    mean = F.lit(float(mean)) if not isinstance(mean, Column) else mean
    mean = F.when(mean > 1, F.raise_error(F.lit("Poisson rate above 1")).cast("double")).otherwise(mean)
    # state: the uniform number, the rate, the current term, the sum of the terms, the draw
    start = F.struct(
        hash_unit(seed, key).alias("u"), mean.alias("rate"), F.exp(-mean).alias("term"), F.exp(-mean).alias("below"),
        F.lit(0.0).alias("draw"),
    )

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * s["rate"] / i
        return F.struct(
            s["u"].alias("u"), s["rate"].alias("rate"), term.alias("term"), (s["below"] + term).alias("below"),
            F.when(s["u"] >= s["below"], s["draw"] + 1).otherwise(s["draw"]).alias("draw"),
        )

    terms = F.sequence(F.lit(1), F.lit(POISSON_TERMS)).cast("array<double>")
    return F.aggregate(terms, start, step, lambda s: s["draw"])


def _bagged(df: DataFrame, n_trees: int, mean, seed, key: str, make_tree, class_weight: str | None = None) -> DataFrame:
    """Out-of-bag scores ``(key, label, p1, n_votes)`` of trees weighted by ``bag_weight``."""
    factor = F.col(class_weight) if class_weight else F.lit(1.0)
    votes = []
    for t in range(n_trees):
        bag = df.withColumn("bag", poisson_weight(mean, f"{seed}:{t}", key))
        inside = bag.where("bag > 0").withColumn("bag_weight", F.col("bag") * factor)
        scored = make_tree(t).fit(inside).transform(bag.where("bag = 0"))
        score = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
        votes.append(scored.select(key, "label", score.alias("p")))
    stacked = reduce(lambda a, b: a.unionByName(b), votes)
    return stacked.groupBy(key, "label").agg(F.avg("p").alias("p1"), F.count(F.lit(1)).alias("n_votes"))


def _tree_maker(factory, params: dict | None, seed: int):
    fixed = {"n_estimators": 1, "weight": "bag_weight", "bootstrap": False}
    return lambda t: factory(**(dict(params or {}) | fixed | {"seed": seed + t}))


def oob_evaluate(
    df: DataFrame, n_trees: int = 50, params: dict | None = None, seed=42, key: str = "key", weight: str | None = None,
    regression: bool = False,
) -> DataFrame:
    """Out-of-bag predictions ``(key, y_true, score, y_hat)`` of a random forest.

    Every tree sees a row Poisson(1) times, times its class weight if given;
    rows it does not see are scored by it. Rows seen by every tree are absent.
    """
    make_tree = _tree_maker(rf_regressor if regression else rf_classifier, params, seed)
    votes = _bagged(df, n_trees, 1.0, seed, key, make_tree, weight)
    y_hat = F.col("p1") if regression else (F.col("p1") > 0.5).cast("int")
    return votes.select(key, F.col("label").alias("y_true"), F.col("p1").alias("score"), y_hat.alias("y_hat"))


def balanced_rf(df: DataFrame, n_trees: int = 50, params: dict | None = None, seed=42, key: str = "key") -> DataFrame:
    """Out-of-bag predictions of a forest whose bags hold both classes equally.

    A row of class y is drawn Poisson(n_smallest / n_y) times.
    """
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    smallest = counts.agg(F.min("n")).scalar()
    rates = counts.select("label", (smallest / F.col("n")).alias("_rate"))
    rated = checkpointed(lookup_join(df, rates, ["label"]))
    votes = _bagged(rated, n_trees, F.col("_rate"), seed, key, _tree_maker(rf_classifier, params, seed))
    return votes.select(
        key, F.col("label").alias("y_true"), F.col("p1").alias("score"), (F.col("p1") > 0.5).cast("int").alias("y_hat")
    )
