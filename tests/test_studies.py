"""Resampling within folds, and studies that stop and go on."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from traitweave.operators import estimators as ES
from traitweave.operators import models as M
from traitweave.operators import resampling as R
from traitweave.operators import studies as ST
from traitweave.operators import tuning as TU
from traitweave.operators.ledger import Study, item_id
from traitweave.operators.sampling import oversample, with_folds
from traitweave.plans.hashing import hash_unit


@pytest.fixture(scope="module")
def noise(spark):
    """Labels that the features say nothing about; one row in six is positive."""
    ids = spark.range(180).withColumnRenamed("id", "key")
    wide = ids.select("key", (F.col("key") % 6 == 0).cast("double").alias("label"), hash_unit("a", "key").alias("a"), hash_unit("b", "key").alias("b"))
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(wide).persist()


def test_resampling_within_folds_does_not_leak(spark, noise):
    # Drawn again before the cut, most positives have a twin among the training rows; the nearest row tells their class.
    whole = oversample(noise, "label", "key", 1.0, 150, 3).withColumn("key", F.monotonically_increasing_id())
    leaky = TU.compare_models(with_folds(whole, "label", "key", 3, 1).persist(), {"near": ES.KNearest(1)}, "fold")
    folds = with_folds(noise, "label", "key", 3, 1).persist()
    near = R.Resampled(ES.KNearest(1, key="row"), lambda df: oversample(df, "label", "key", 1.0, 100, 3).withColumn("row", F.monotonically_increasing_id()))
    honest = TU.compare_models(folds.withColumn("row", F.col("key")), {"near": near}, "fold")
    recall = [df.agg(F.avg("recall")).first()[0] for df in (leaky, honest)]
    assert recall[0] > 0.9 and recall[1] < 0.45
    # The rows that are scored are the rows that there are.
    assert honest.agg(F.sum(F.col("tp") + F.col("fn"))).first()[0] == 30


def test_a_model_sees_rows_as_they_are(noise):
    seen = []

    def sample(df):
        out = df.where("label = 1").unionByName(df.where("label = 0").limit(30))
        seen.append(out.count())
        return out

    model = R.Resampled(M.naive_bayes(), sample).fit(noise)
    assert seen == [60] and model.transform(noise).count() == 180


def test_kinds_of_resampling(noise):
    sizes = {}
    for name, est in {
        "under": R.undersampled(M.naive_bayes()), "over": R.oversampled(M.naive_bayes(), minority=1.0),
        "synthetic": R.with_synthetic(Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), M.naive_bayes()]), ["a", "b"], [], minority=1.0, k=3),
    }.items():
        rows = est.sample(noise if name != "synthetic" else noise.drop("features"))
        sizes[name] = sorted(r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
        assert est.fit(noise if name != "synthetic" else noise.drop("features")) is not None
    assert sizes == {"under": [30, 30], "over": [150, 150], "synthetic": [150, 150]}


def test_parameters_of_the_inner_estimator_are_searched(noise):
    folds = with_folds(noise, "label", "key", 2, 1).persist()
    found = TU.grid_search(folds, R.undersampled(M.decision_tree(3)), {"maxDepth": [1, 3]}, "fold")
    assert found.results.count() == 2 and found.best.depth <= found.best_params["maxDepth"]


def test_a_study_goes_on_where_it_stopped(spark, tmp_path):
    done = []

    def work(item):
        done.append(item["run"])
        if item["run"] == 3 and done.count(3) == 1:
            raise RuntimeError("lost")
        return spark.range(2).select((F.col("id") * item["run"]).alias("v"))

    items = [{"run": r, "kind": k} for r in range(5) for k in "a"]
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="no item"):
        Study(spark, items, path).results()
    with pytest.raises(RuntimeError, match="lost"):
        Study(spark, items, path).run(work)
    assert [r["item"] for r in Study(spark, items, path).pending().collect()] == [item_id(i) for i in items[3:]]
    got = Study(spark, items, path).run(work).results()
    assert done == [0, 1, 2, 3, 3, 4]
    assert sorted((r["run"], r["kind"], r["v"]) for r in got.collect()) == sorted((r, "a", v * r) for r in range(5) for v in range(2))
    # Another process would find everything done, in any order of the items' keys.
    Study(spark, [{"kind": i["kind"], "run": i["run"]} for i in items], path, parallelism=2).run(work)
    assert len(done) == 6


def test_thousands_of_items_are_planned_and_done_in_parts(spark, tmp_path):
    items = [{"num_features": k, "run": run, "random": m} for k in range(19) for run in range(100) for m in "ny"]
    study = Study(spark, items, str(tmp_path / "big"), parallelism=4)
    assert study.pending().count() == 3_800
    study.run(lambda item: spark.range(1).select(F.lit(item["run"]).alias("v")), limit=6)
    assert study.pending().count() == 3_794 and study.results().count() == 6


def test_importances_of_every_run(spark, noise, tmp_path, rows):
    path = str(tmp_path / "fi")
    runs = ST.repeated_runs(noise.select("key", "label", "a", "b"), "key", ["a", "b"], [], {"tree": M.decision_tree(3)}, 2, importances=path)
    assert runs.count() == 2
    assert rows(spark.read.parquet(path), "run", "model", "feature") == [(r, "tree", f) for r in (0, 1) for f in "ab"]
