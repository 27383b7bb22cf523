import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from traitweave.operators import estimators as ES
from traitweave.operators import evaluation as E
from traitweave.operators import models as M
from traitweave.operators import ontology as T
from traitweave.operators import prep
from traitweave.operators import studies as ST
from traitweave.operators import tuning as TU
from traitweave.operators.sampling import with_folds
from traitweave.plans.hashing import hash_unit


@pytest.fixture(scope="module")
def wide(spark):
    """200 rows: a and b carry the label, the rest is noise."""
    ids = spark.range(200).withColumnRenamed("id", "key")
    y = (F.col("key") % 4 == 0).cast("double")
    return ids.select(
        "key", y.alias("label"), (y * 2 + hash_unit("a", "key")).alias("a"), (y + hash_unit("b", "key")).alias("b"),
        hash_unit("c", "key").alias("c"), (hash_unit("d", "key") > 0.5).cast("int").alias("d"),
    ).persist()


@pytest.fixture(scope="module")
def rows_(wide):
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(wide).select("key", "label", "features").persist()


def _auc(model, rows):
    return E.roc_auc(E.prediction_table(model, rows)).first()[0]


def test_models_learn_and_null_model_does_not(wide, rows_):
    mixed = ST.shuffle_columns(wide, "key", ["a", "b", "c", "d"], 3)
    mixed = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(mixed).persist()
    makers = [
        lambda: M.rf_classifier(5, max_depth=3), lambda: M.decision_tree(3), lambda: M.gbt(3),
        lambda: M.logistic(200), lambda: M.linear_svm(200, max_iter=20), lambda: M.naive_bayes(), lambda: M.mlp(4, hidden=5, max_iter=30),
    ]
    for make in makers:
        assert _auc(make().fit(rows_), rows_) > 0.9
    half = hash_unit("half", "key") < 0.5
    for make in makers[:4]:
        assert abs(_auc(make().fit(mixed.where(half)), mixed.where(~half)) - 0.5) < 0.2


def test_block_sizes_reach_all_features():
    assert ST.block_sizes(7) == [7] and ST.block_sizes(35) == [10, 20, 30, 35]
    assert ST.block_sizes(9500) == [*range(10, 101, 10), *range(200, 1001, 100), *range(2000, 9001, 1000), 9500]


def test_depth_beyond_the_limit_is_refused():
    assert M.rf_classifier(max_depth=None).getMaxDepth() == M.DEPTH_LIMIT
    with pytest.raises(ValueError, match="limit"):
        M.rf_classifier(max_depth=200)
    assert M.decision_tree(None).getMaxDepth() == M.DEPTH_LIMIT


def test_poisson_weights(spark):
    draws = spark.range(20000).select(M.poisson_weight(1.0, "s", "id").alias("w"), M.poisson_weight(0.2, "s", "id").alias("v"))
    row = draws.agg(F.avg("w"), F.var_pop("w"), F.avg((F.col("w") == 0).cast("double")), F.avg("v")).first()
    assert abs(row[0] - 1) < 0.05 and abs(row[1] - 1) < 0.05 and abs(row[2] - math.exp(-1)) < 0.02 and abs(row[3] - 0.2) < 0.02


def test_bagging_scores_rows_not_seen(rows_):
    weighted = prep.with_balanced_weight(rows_, "label")
    pred = M.oob_evaluate(weighted, 4, {"max_depth": 3}, 1, weight="weight")
    assert pred.count() == pred.select("key").distinct().count() > 150
    assert E.roc_auc(pred).first()[0] > 0.9
    assert E.roc_auc(M.balanced_rf(rows_, 4, {"max_depth": 3}, 1)).first()[0] > 0.9


def test_adaboost(rows_):
    model = ES.AdaBoost(4).fit(rows_)
    assert 1 <= len(model.stumps) <= 4
    assert _auc(model, rows_) > 0.9
    assert sum(model.featureImportances) == pytest.approx(1)


def test_own_estimators_in_searches(spark, rows_, tmp_path, rows):
    folds = with_folds(rows_, "label", "key", 2, 1).persist()
    boosted = TU.grid_search(folds, ES.AdaBoost(2), {"numTrees": [1, 3], "stepSize": [0.5, 1.0]}, "fold")
    near = TU.grid_search(folds, ES.KNearest(3), {"k": [1, 5], "weights": ["uniform", "distance"]}, "fold")
    assert boosted.results.count() == near.results.count() == 4
    scores = TU.compare_models(folds, {"boost": ES.AdaBoost(2), "near": ES.KNearest(3), "tree": M.decision_tree(2)}, "fold")
    assert scores.count() == 6 and scores.agg(F.min("f1")).first()[0] > 0.5
    for found, kind in ((boosted, ES.AdaBoostVote), (near, ES.KNearestVote)):
        path = str(tmp_path / kind.__name__)
        found.best.save(path)
        back = kind.load(path)
        assert rows(back.transform(rows_), "key", "prediction") == rows(found.best.transform(rows_), "key", "prediction")


def test_boosting_rounds_like_plain_ones(wide, rows_):
    """Weights, errors and votes of each round against numpy."""
    import numpy as np

    rows_ = rows_.withColumn("label", F.when(F.col("key") % 9 == 0, 1 - F.col("label")).otherwise(F.col("label"))).persist()
    table = rows_.orderBy("key").collect()
    x, y = np.array([r["features"].toArray() for r in table]), np.array([r["label"] for r in table])
    model = ES.AdaBoost(6, 0.7).fit(rows_)
    w = np.ones(len(y))
    for stump in model.stumps:
        low = x[:, stump.feature] <= stump.threshold
        said = np.where(low, stump.low, stump.high)
        error = w[said != y].sum() / w.sum()
        assert stump.weight == pytest.approx(0.7 * np.log((1 - error) / error)) and error < 0.5
        assert [stump.low, stump.high] == [float(w[k & (y == 1)].sum() > w[k].sum() / 2) for k in (low, ~low)]
        w = w * np.exp(stump.weight * (said != y))
    assert len(model.stumps) == 6


def test_search(rows_):
    folds = with_folds(rows_, "label", "key", 3, 1).persist()
    found = TU.grid_search(folds, M.decision_tree(3), {"maxDepth": [1, 2, 2]}, "fold")
    assert found.results.count() == 2 and found.best_params["maxDepth"] in (1, 2)
    drawn = TU.draw_params({"C": ("loguniform", 1e-3, 1e3), "k": ("int", 1, 3), "w": ["u", "d"]}, 50, 1)
    assert {d["k"] for d in drawn} == {1, 2, 3} and all(1e-3 <= d["C"] <= 1e3 for d in drawn)
    assert drawn == TU.draw_params({"C": ("loguniform", 1e-3, 1e3), "k": ("int", 1, 3), "w": ["u", "d"]}, 50, 1)


def test_nested_and_compare(rows_):
    scores = TU.nested_cv(rows_, {"tree": (M.decision_tree(3), {"maxDepth": [1, 3]})}, outer=2, inner=2, n_iter=2)
    assert scores.count() == 2
    folds = with_folds(rows_, "label", "key", 2, 1).persist()
    both = TU.compare_models(folds, {"tree": M.decision_tree(3), "bayes": M.naive_bayes()}, "fold")
    assert both.count() == 4 and both.agg(F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).first()[0] == 400


def test_importances(spark, rows_):
    names = ["a", "b", "c", "d"]
    model = M.rf_classifier(5, max_features="1.0", max_depth=3).fit(rows_)
    table = ST.importance_table(spark, model, names)
    assert table.orderBy(F.col("importance").desc()).first()["feature"] == "a"
    perm = ST.permutation_importance(model, rows_, names, 3, 1)
    assert perm.count() == 12
    best = perm.groupBy("feature").agg(F.avg("importance").alias("m")).orderBy(F.col("m").desc()).first()
    assert best["feature"] == "a" and best["m"] > 0.1


def test_repeated_runs_and_curve(wide, rows_):
    runs = ST.repeated_runs(wide, "key", ["a", "b", "c"], ["d"], {"tree": M.decision_tree(3)}, 2).collect()
    assert [r["tp"] + r["fn"] for r in runs] == [5, 5] and [r["tn"] + r["fp"] for r in runs] == [5, 5]
    curve = ST.learning_curve(rows_, M.decision_tree(3), [0.5, 1.0], 2)
    assert {(r["fraction"], r["part"]) for r in curve.collect()} == {(f, p) for f in (0.5, 1.0) for p in ("train", "test")}


def test_feature_blocks(wide):
    got = ST.feature_block_curve(wide, "key", ["a", "b", "d"], ["a", "b"], [1, 3], 1, lambda run: M.decision_tree(3)).collect()
    assert {(r["num_features"], r["random"]) for r in got} == {(k, x) for k in (1, 3) for x in "ny"}


def test_targets_are_leak_safe(spark, tmp_path):
    cells = [(k, "go_a", 1.0) for k in range(0, 60, 2)] + [(k, "go_b", 1.0) for k in range(0, 60, 4)]
    cells += [(k, "pfa_x", float(k % 2)) for k in range(60)] + [(k, "pfa_y", float(k % 3)) for k in range(60)]
    long = spark.createDataFrame(cells, "key INT, feature STRING, value DOUBLE")
    edges = spark.createDataFrame([("b", "a")], "child STRING, parent STRING")
    targets = spark.createDataFrame([("go_a",)], "target STRING")
    excluded = T.exclusions(targets, edges)
    out = ST.train_targets(long, ["go_a"], excluded, {"max_depth": 3}, 3, 2, path=str(tmp_path / "t"))
    assert {r["feature"] for r in out.importance.collect()} == {"pfa_x", "pfa_y"}
    assert out.scores.count() == 1 and out.scores.first()["f1"] == 1.0
    tuned = ST.train_targets(
        long, ["go_a"], excluded, None, 2, 2, path=str(tmp_path / "u"), grid={"maxDepth": [1, 2], "numTrees": [2]}, n_iter=2, folds=2
    )
    assert tuned.search.count() == 2 and tuned.scores.first()["f1"] == 1.0


def test_copies_of_training_rows_are_not_made_in_python(spark, monkeypatch):
    """Many queries: Python says which cells a row goes to, and Spark makes the copies; blocks of distances are bounded."""
    import numpy as np

    from traitweave.operators import neighbours as N

    monkeypatch.setattr(N, "FEW_QUERIES", 10)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    vecs = np.random.default_rng(4).normal(size=(120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id LONG, vec ARRAY<DOUBLE>")
    queries, train = df.where("id < 40"), df.where("id >= 40")
    for p in (1.0, 2.0):
        near = N.nearest(queries, train, 3, p)
        dist = np.linalg.norm(vecs[:40, None] - vecs[None, 40:], ord=p, axis=2)
        want = {(q, int(i) + 40, place + 1) for q in range(40) for place, i in enumerate(np.argsort(dist[q])[:3])}
        assert {(r["query"], r["id"], r["place"]) for r in near.collect()} == want
    plan = N.nearest(queries, train, 3)._jdf.queryExecution().toString()
    assert "MapInPandas route" not in plan and "route(cell" in plan
    monkeypatch.setattr(N, "FEW_QUERIES", 8192)
    few = N.nearest(queries, train, 3)
    monkeypatch.setattr(N, "CELLS", 100)
    assert sorted(few.collect()) == sorted(N.nearest(queries, train, 3).collect())


def test_linear_models_pass_over_few_tasks(spark, rows_):
    """Every step of an optimiser is a job: its tasks follow the rows, not the partitions."""
    many = rows_.repartition(16).persist()
    for est in (M.linear_svm(many.count(), max_iter=5), M.logistic(many.count(), max_iter=5).copy()):
        spark.sparkContext.setJobGroup(est.uid, "fit")
        est.fit(many)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        track = spark.sparkContext.statusTracker()
        stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup(est.uid) for s in track.getJobInfo(j).stageIds]
        assert {s.numTasks for s in stages if s and "LossFunction" in s.name} == {1}
    assert M.linear_svm(M.PASS_ROWS * 3 + 1).copy().tasks == 4


def test_models_are_compared_side_by_side(rows_):
    import threading

    both = threading.Barrier(2, timeout=60)

    class Waits(ES.AdaBoost):
        def _fit(self, dataset):
            both.wait()  # breaks if the other model is not being fitted
            return super()._fit(dataset)

    folds = with_folds(rows_, "label", "key", 2, 1).persist()
    assert TU.compare_models(folds, {"a": Waits(1), "b": Waits(2)}, "fold").count() == 4


def test_blocks_are_fitted_side_by_side(wide):
    import threading

    both = threading.Barrier(2, timeout=60)

    class Waits(ES.AdaBoost):
        def _fit(self, dataset):
            both.wait()  # breaks if the other block is not being fitted
            return super()._fit(dataset)

    found = ST.feature_block_curve(wide, "key", ["a", "b"], ["a", "b"], [2], 1, lambda run: Waits(1), 1)
    assert sorted(r["random"] for r in found.collect()) == ["n", "y"]


def test_shuffled_columns_take_few_buckets(spark, wide, monkeypatch):
    """200 rows need one bucket a feature, not 4096; their new places are the same."""
    asked = []
    plain = ST.shuffle_features
    monkeypatch.setattr(ST, "shuffle_features", lambda long, seed, rounds=1, digits=3: asked.append(digits) or plain(long, seed, rounds, digits))
    few = ST.shuffle_columns(wide, "key", ["a", "c"], 3)
    monkeypatch.setattr(ST, "shuffle_features", lambda long, seed, rounds=1, digits=3: plain(long, seed, rounds, 3))
    many = ST.shuffle_columns(wide, "key", ["a", "c"], 3)
    assert asked == [0] and few.orderBy("key").collect() == many.orderBy("key").collect()
