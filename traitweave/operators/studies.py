"""Importances, repeated runs, learning curves and per-target training."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.hashing import number_by_hash
from ..session import checkpointed, scratch
from .evaluation import confusion, prediction_table, prf, r_squared
from .ledger import Study
from .models import oob_evaluate, rf_classifier, rf_regressor
from .prep import preprocessor, to_vectors, with_balanced_weight
from .sampling import bucket_digits, holdout_n_per_class, shuffle_features, undersample, with_folds
from .tuning import random_search

def block_sizes(n: int) -> list[int]:
    """Sizes of growing feature blocks up to all ``n`` features: tens to 100, hundreds to 1000, then thousands."""
    sizes, step = [], 10
    while (size := (sizes[-1] if sizes else 0) + step) < n:
        sizes.append(size)
        step = 10 if size < 100 else 100 if size < 1000 else 1000
    return [*sizes, n]

# Parameters a search may choose, by their names in MLlib and in the factories.
MLLIB_NAMES = {"featureSubsetStrategy": "max_features", "maxDepth": "max_depth", "impurity": "criterion", "minInfoGain": "minInfoGain"}


def importance_table(spark, model: Model, names: Sequence[str], **tags) -> DataFrame:
    """``(feature, importance)`` from impurity importances or signed coefficients.

    The numbers are part of the fitted model, one per feature.
    """
    final = model.stages[-1] if hasattr(model, "stages") else model
    values = final.featureImportances if hasattr(final, "featureImportances") else final.coefficients
    rows = [(f, float(v)) for f, v in zip(names, values.toArray())]
    table = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return table.select(*[F.lit(v).alias(k) for k, v in tags.items()], "feature", "importance")


def permutation_importance(
    model: Model, test: DataFrame, names: Sequence[str], repeats: int = 5, seed=42, key: str = "key"
) -> DataFrame:
    """``(perm, feature, importance)``: accuracy lost when one feature is shuffled.

    The shuffled values are prepared in long form and arrive as one array per
    row; the copies of a row with one value swapped are made, scored and counted
    inside the task that holds the row and are never shuffled.
    """
    names = list(names)
    rows = test.select(key, "label", vector_to_array("features").alias("x"))
    cells = rows.select(F.col(key).alias("key"), F.posexplode("x").alias("feature", "value"))
    copies = cells.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.select(
        "key", F.concat_ws("|", F.col("perm"), F.col("feature")).alias("feature"), "value"
    )
    swapped = shuffle_features(copies, seed).select(
        F.col("key").alias(key),
        F.struct(
            F.substring_index("feature", "|", 1).cast("int").alias("perm"),
            F.substring_index("feature", "|", -1).cast("int").alias("idx"),
            F.col("value").alias("v"),
        ).alias("swap"),
    )
    swaps = swapped.groupBy(key).agg(F.collect_list("swap").alias("swaps"))
    each = rows.join(swaps, key).select(key, "label", "x", F.explode("swaps").alias("swap"))
    x = F.transform("x", lambda v, i: F.when(i == F.col("swap.idx"), F.col("swap.v")).otherwise(v))
    changed = each.select(
        "label", F.col("swap.perm").alias("perm"), F.col("swap.idx").alias("idx"), array_to_vector(x).alias("features")
    )
    right = (F.col("prediction") == F.col("label")).cast("double")
    base = model.transform(test).agg(F.avg(right)).first()[0]
    scores = model.transform(changed).groupBy("perm", "idx").agg(F.avg(right).alias("score"))
    labels = F.array(*[F.lit(n) for n in names])
    return scores.select(
        "perm", F.element_at(labels, F.col("idx") + 1).alias("feature"), (F.lit(base) - F.col("score")).alias("importance")
    )


def shuffle_columns(df: DataFrame, key: str, cols: Sequence[str], seed) -> DataFrame:
    """Permute each of the given columns on its own; other columns stay."""
    filled = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = filled.unpivot(["key"], list(cols), "feature", "value")
    mixed = shuffle_features(long, seed, digits=bucket_digits(df.count())).groupBy(F.col("key").alias(key)).pivot("feature", list(cols)).agg(F.max("value"))
    return df.drop(*cols).join(mixed, key)


def run_once(
    df: DataFrame, key: str, cont: Sequence[str], cat: Sequence[str], estimator: Estimator, seed, shuffled: bool = False,
) -> tuple[Model, DataFrame, DataFrame]:
    """Split off a tenth per class, balance, scale, fit: model, test rows, predictions."""
    parts = holdout_n_per_class(df, "label", key, None, f"{seed}:split")
    balanced = undersample(parts.where("part = 'train'"), "label", key, f"{seed}:balance").persist()
    train = shuffle_columns(balanced, key, [*cont, *cat], f"{seed}:shuffle").persist() if shuffled else balanced
    test = parts.where("part = 'test'")
    model = preprocessor(cont, cat, estimator).fit(train)
    train.unpersist()
    balanced.unpersist()
    return model, test, prediction_table(model, test, key)


def repeated_runs(
    df: DataFrame, key: str, cont: Sequence[str], cat: Sequence[str], estimators: dict[str, Estimator], runs: int, seed=42,
    path: str | None = None, importances: str | None = None, parallelism: int = 4,
) -> DataFrame:
    """One score row per run and model; a run gives all models the same rows.

    A study under ``path``: a stopped one goes on where it was. With
    ``importances`` (a folder) the importances of each run's models go there,
    tagged with run and model.
    """
    names = [*cont, *cat]

    def work(item: dict) -> DataFrame:
        model, _, pred = run_once(df, key, cont, cat, estimators[item["model"]].copy(), f"{seed}:{item['run']}")
        if importances:
            table = importance_table(df.sparkSession, model, names)
            table.write.mode("overwrite").parquet(f"{importances}/run={item['run']}/model={item['model']}")
        return prf(confusion(pred))

    items = [{"run": run, "model": name} for run in range(runs) for name in estimators]
    return Study(df.sparkSession, items, path, parallelism).run(work).results()


def feature_block_curve(
    df: DataFrame, key: str, ranking: Sequence[str], cont: Sequence[str], ks: Sequence[int] | None, runs: int,
    make_estimator: Callable[[int], Estimator], seed=42, path: str | None = None, parallelism: int = 4,
) -> DataFrame:
    """Scores with the top k features for growing k (``block_sizes`` unless given),
    real and with shuffled features: a study under ``path``."""
    continuous = set(cont)

    def work(item: dict) -> DataFrame:
        k, run = item["num_features"], item["run"]
        top = list(ranking[:k])
        some_cont = [c for c in top if c in continuous]
        some_cat = [c for c in top if c not in continuous]
        _, _, pred = run_once(
            df.select(key, "label", *top), key, some_cont, some_cat, make_estimator(run), f"{seed}:{k}:{run}", item["random"] == "y")
        return prf(confusion(pred))

    sizes = ks if ks is not None else block_sizes(len(ranking))
    items = [{"num_features": k, "run": run, "random": mixed} for k in sizes for run in range(runs) for mixed in "ny"]
    return Study(df.sparkSession, items, path, parallelism).run(work).results()


def learning_curve(
    df: DataFrame, est: Estimator, fractions: Sequence[float], k: int, seed=42, key: str = "key", path: str | None = None
) -> DataFrame:
    """Accuracy on growing parts of the training folds: mean and spread over folds. A study under ``path``."""
    folds = checkpointed(with_folds(df, "label", key, k, f"{seed}:fold"))
    right = (F.col("prediction") == F.col("label")).cast("double")

    def work(item: dict) -> DataFrame:
        order = number_by_hash(folds.where(F.col("fold") != item["fold"]), [], [key], f"{seed}:part", "_rank", "_n")
        train = order.where(F.col("_rank") <= F.floor(F.col("_n") * F.lit(item["fraction"]) + F.lit(1e-9))).persist()
        model = est.fit(train)
        scored = model.transform(train).select(F.lit("train").alias("part"), right.alias("right"))
        scored = scored.unionByName(model.transform(folds.where(F.col("fold") == item["fold"])).select(F.lit("test").alias("part"), right.alias("right")))
        scores = checkpointed(scored.groupBy("part").agg(F.avg("right").alias("score")))
        train.unpersist()
        return scores

    items = [{"fold": i, "fraction": float(f)} for i in range(k) for f in fractions]
    found = Study(df.sparkSession, items, path).run(work).results()
    return found.groupBy("fraction", "part").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


@dataclass
class TargetResults:
    """Tables over all targets; ``search`` only when parameters were tuned."""

    importance: DataFrame
    scores: DataFrame
    search: DataFrame | None


def train_targets(
    long: DataFrame, targets: Sequence[str], excluded: DataFrame | None = None, params: dict | None = None,
    n_trees: int = 50, parallelism: int = 4, seed=42, regression: bool = False, path: str | None = None,
    grid: dict[str, Sequence] | None = None, n_iter: int = 10, folds: int = 5,
) -> TargetResults:
    """One leak-free forest per target, tuned if a grid is given.

    The vectors are built once for all targets. A target takes its label from
    its own feature (absent = 0) and slices its relatives, and itself, out of
    the vectors. With a ``grid`` (names of ``rf_classifier`` / ``rf_regressor``
    parameters of MLlib) a random search on stratified folds picks the
    parameters; scores are out-of-bag. Targets run side by side from a driver
    thread pool, each in a scheduler pool of its own; results go to one
    partition folder per target.
    """
    spark = long.sparkSession
    names = [r[0] for r in long.select("feature").distinct().orderBy("feature").collect()]
    vectors = to_vectors(long, names, long.select("key").distinct())
    excluded = checkpointed(excluded.select("target", "feature")) if excluded is not None else None
    path = path or scratch(spark, "targets")
    factory = rf_regressor if regression else rf_classifier
    weight = None if regression else "weight"

    def one(job: tuple[int, str]) -> None:
        slot, target = job
        started = datetime.now()
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"target{slot % parallelism}")
        hidden = {target}
        if excluded is not None:  # at most one entry per feature
            hidden |= {r["feature"] for r in excluded.where(F.col("target") == target).collect()}
        kept = [i for i, f in enumerate(names) if f not in hidden]
        label = long.where(F.col("feature") == target).select("key", F.col("value").cast("double").alias("y"))
        y = F.coalesce("y", F.lit(0.0))
        rows = vectors.join(label, "key", "left").withColumn("label", y if regression else (y > 0).cast("double"))
        sliced = VectorSlicer(inputCol="features", outputCol="kept", indices=kept).transform(rows)
        rows = sliced.select("key", "label", F.col("kept").alias("features"))
        if not regression:
            rows = with_balanced_weight(rows, "label")
        rows = rows.persist()
        folder = f"target={target.replace(':', '_')}"
        est = factory(**(dict(params or {}) | {"n_estimators": n_trees, "seed": seed, "weight": weight}))
        best, n_best = dict(params or {}), n_trees
        if grid:
            part = F.lit(0).alias("part")
            split = with_folds(rows.select("*", part), "part" if regression else "label", "key", folds, seed)
            found = random_search(split, est, grid, n_iter, seed, "fold", "r2" if regression else "f1")
            found.results.write.mode("overwrite").parquet(f"{path}/search/{folder}")
            model, chosen = found.best, found.best_params
            best |= {ours: chosen[theirs] for theirs, ours in MLLIB_NAMES.items() if theirs in chosen}
            n_best = chosen.get("numTrees", n_trees)
        else:
            model = est.fit(rows)
        pred = oob_evaluate(rows, n_best, best, seed, "key", weight, regression)
        scores = r_squared(pred) if regression else prf(confusion(pred))
        importance_table(spark, model, [names[i] for i in kept]).write.mode("overwrite").parquet(f"{path}/fi/{folder}")
        times = [F.lit(t.strftime("%d/%m/%Y %H:%M:%S")) for t in (started, datetime.now())]
        scores = scores.select("*", times[0].alias("time_start"), times[1].alias("time_end"))
        scores.write.mode("overwrite").parquet(f"{path}/scores/{folder}")
        rows.unpersist()

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(one, enumerate(targets)))
    tables = [spark.read.parquet(f"{path}/{t}") for t in (["fi", "scores", "search"] if grid else ["fi", "scores"])]
    return TargetResults(tables[0], tables[1], tables[2] if grid else None)
