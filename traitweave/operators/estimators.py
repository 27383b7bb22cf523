"""AdaBoost and k nearest neighbours as MLlib estimators.

They take parameters by MLlib's rules (``copy`` with a parameter map), so they go
into searches, nested cross-validation, comparisons and pipelines, and are saved
as plain tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..session import checkpointed, scratch
from .evaluation import confusion, prf
from .histogram_trees import Answers, Growth, Job, binned_vectors, grow
from .neighbours import knn, nearest
from .saving import SavedAsTables
from .stumps import Boosted, Stump
from .tuning import grid_candidates, params_text


_STUMPS = "feature int, threshold double, left array<double>, low double, high double, weight double"


class _Boosting(Params):
    numTrees = Param(Params._dummy(), "numTrees", "rounds of boosting", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "learning rate", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the trees", TypeConverters.toInt)


class AdaBoost(Estimator, _Boosting):
    """Two-class discrete boosting of depth-1 trees on ``features`` and ``label``.

    The features are binned once. A round is one job: tasks work out the weights of
    their rows from the stumps so far, and the sums of the two sides of the new
    stump already say its error.
    """

    def __init__(self, n_estimators: int = 50, learning_rate: float = 1.0, seed: int = 42):
        super().__init__()
        self._set(numTrees=n_estimators, stepSize=learning_rate, seed=seed)

    def _fit(self, dataset: DataFrame) -> AdaBoostVote:
        rate, seed = self.getOrDefault(self.stepSize), self.getOrDefault(self.seed)
        # Numbers of rows are only the same in every job once they are written.
        rows = checkpointed(dataset.select(F.monotonically_increasing_id().alias("key"), "features", "label"))
        data = binned_vectors(rows, "key", True)
        n, answers, boosted = data.rows.count(), Answers(loss="weights"), Boosted(rate)
        for t in range(self.getOrDefault(self.numTrees)):
            if boosted.done:
                break
            boosted.take(grow(data, [Job(0, t, chain=boosted.chain)], Growth(max_depth=1), answers, seed, n), data.cuts)
        return AdaBoostVote(boosted.stumps, len(data.names))


class AdaBoostVote(Model, SavedAsTables):
    """The weighted vote of stumps; any number of them is one expression over an array."""

    def __init__(self, stumps: list[Stump], width: int):
        super().__init__()
        self.stumps, self.width = stumps, width

    def _transform(self, dataset: DataFrame) -> DataFrame:
        listed = F.array(*[
            F.struct(
                F.lit(s.feature).alias("feature"), F.lit(s.threshold).alias("threshold"),
                F.lit(s.left).cast("array<double>").alias("left") if s.left is None else F.array(*map(F.lit, s.left)).alias("left"),
                F.lit(s.weight * (2 * s.low - 1)).alias("low"), F.lit(s.weight * (2 * s.high - 1)).alias("high"),
            )
            for s in self.stumps
        ])
        x = vector_to_array("features")

        def add(total, s):
            value = x[s["feature"]]
            low = F.when(s["left"].isNull(), value <= s["threshold"]).otherwise(F.array_contains(s["left"], value))
            return total + F.when(low, s["low"]).otherwise(s["high"])

        score = F.aggregate(listed, F.lit(0.0), add)
        scored = dataset.withColumn("score", score)
        return scored.withColumn("prediction", (F.col("score") > 0).cast("double"))

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the votes' weight that looks at each feature."""
        out = np.zeros(self.width)
        for s in self.stumps:
            out[s.feature] += abs(s.weight)
        return DenseVector(out / out.sum() if out.sum() else out)

    def _save_tables(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.width, *astuple(s)) for i, s in enumerate(self.stumps)]
        spark.createDataFrame(rows, "i int, width int, " + _STUMPS).write.mode("overwrite").parquet(path)

    @classmethod
    def _load_tables(cls, spark: SparkSession, path: str) -> AdaBoostVote:
        rows = spark.read.parquet(path).orderBy("i").collect()
        return cls([Stump(*[r[c] for c in ("feature", "threshold", "left", "low", "high", "weight")]) for r in rows], rows[0]["width"])


class _Voting(Params):
    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    p = Param(Params._dummy(), "p", "order of the distance", TypeConverters.toFloat)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "column that names a row", TypeConverters.toString)


class KNearest(Estimator, _Voting):
    """k nearest neighbours; fitting writes the training vectors."""

    def __init__(self, k: int = 5, p: float = 2.0, weights: str = "uniform", key: str = "key"):
        super().__init__()
        self._set(k=k, p=p, weights=weights, keyCol=key)

    def _fit(self, dataset: DataFrame) -> KNearestVote:
        path = scratch(dataset.sparkSession, "neighbours")
        rows = dataset.select(F.col(self.getOrDefault(self.keyCol)).alias("key"), vector_to_array("features").alias("vec"), "label")
        rows.write.parquet(path)
        return self._copyValues(KNearestVote(path))


class KNearestVote(Model, _Voting, SavedAsTables):
    """Votes of the nearest rows of a written table; ``prediction`` and the winner's share of the votes as ``score`` of class 1."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key = self.getOrDefault(self.keyCol)
        train = dataset.sparkSession.read.parquet(self.path)
        asked = dataset.select(F.col(key).alias("key"), vector_to_array("features").alias("vec"))
        found = knn(train, asked, self.getOrDefault(self.k), self.getOrDefault(self.p), self.getOrDefault(self.weights))
        share = F.when(F.col("prediction") == 1, F.col("share")).otherwise(1 - F.col("share"))
        voted = found.select(F.col("key").alias(key), F.col("prediction").cast("double").alias("prediction"), share.alias("score"))
        return dataset.join(voted, key)

    def _save_tables(self, spark: SparkSession, path: str) -> None:
        """A copy of the training table; the fitted model's own table goes when this process ends."""
        spark.read.parquet(self.path).write.mode("overwrite").parquet(path)

    @classmethod
    def _load_tables(cls, spark: SparkSession, path: str) -> KNearestVote:
        return cls(path)


def knn_grid(folds: DataFrame, ks: Sequence[int], weights: Sequence[str], p: float = 2.0, metric: str = "accuracy", fold: str = "fold", key: str = "key") -> DataFrame:
    """A grid over k nearest neighbours on given folds: ``(candidate, params, mean, std)``.

    The neighbours of a fold are searched once, for the largest k; every candidate
    votes with the first of them.
    """
    rows = checkpointed(folds.select(F.col(key).alias("id"), vector_to_array("features").alias("vec"), F.col("label").cast("double").alias("label"), F.col(fold).alias("fold")))
    found = []
    for i in [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]:
        test, train = rows.where(F.col("fold") == i), rows.where(F.col("fold") != i)
        near = nearest(test.select("id", "vec"), train.select("id", "vec"), max(ks), p)
        near = lookup_join(near, train.select("id", "label"), ["id"], "inner").select(F.col("query").alias("id"), "dist", "place", F.col("label").alias("said"))
        found.append(checkpointed(lookup_join(near, test.select("id", "label"), ["id"], "inner").withColumn("fold", F.lit(i))))
    near = reduce(lambda a, b: a.unionByName(b), found)
    candidates = grid_candidates({"k": ks, "weights": weights})
    listed = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(c["k"]).alias("k"), F.lit(c["weights"]).alias("weights")) for i, c in enumerate(candidates)])
    closest = F.min("dist").over(Window.partitionBy("fold", "id"))
    near = near.withColumn("exact", closest == 0).withColumn("c", F.explode(listed)).where(F.col("place") <= F.col("c.k"))
    by_distance = F.when(F.col("exact"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
    weight = F.when(F.col("c.weights") == "uniform", F.lit(1.0)).otherwise(by_distance)
    votes = near.groupBy(F.col("c.candidate").alias("candidate"), "fold", "id", "label", "said").agg(F.sum(weight).alias("w"))
    said = votes.groupBy("candidate", "fold", "id", "label").agg(F.min_by("said", F.struct(-F.col("w"), F.col("said"))).alias("y_hat"))
    scores = prf(confusion(said.withColumnRenamed("label", "y_true"), ["candidate", "fold"]))
    scores = scores.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    graded = scores.groupBy("candidate").agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    names = folds.sparkSession.createDataFrame([(i, params_text(c)) for i, c in enumerate(candidates)], "candidate int, params string")
    return names.join(graded, "candidate")
