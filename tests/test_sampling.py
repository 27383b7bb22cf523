import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitweave.operators import neighbours as N
from traitweave.operators.joining import minus_keys
from traitweave.operators import sampling as X
from traitweave.plans.hashing import number_by_hash


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(230)], "key INT, y INT")


def test_numbering_is_complete(people, rows):
    got = number_by_hash(people, ["y"], ["key"], 7, "r", "n")
    for y, n in ((1, 30), (0, 200)):
        part = got.where(F.col("y") == y)
        assert sorted(r[0] for r in part.select("r").collect()) == list(range(1, n + 1))
        assert {r[0] for r in part.select("n").collect()} == {n}
    flat = number_by_hash(people, ["y"], ["key"], 7, "r", digits=0)
    assert rows(got, "key", "r") == rows(flat, "key", "r")


def test_fixed_test_set_and_balance(people, rows):
    parts = X.holdout_n_per_class(people, "y", "key", None, 1)
    assert rows(parts.groupBy("part", "y").count()) == [("test", 0, 3), ("test", 1, 3), ("train", 0, 197), ("train", 1, 27)]
    test = parts.where("part = 'test'")
    train = minus_keys(people, test, "key")
    balanced = X.undersample(train, "y", "key", 1)
    assert rows(balanced.groupBy("y").count()) == [(0, 27), (1, 27)]
    assert balanced.join(test, "key").count() == 0


def test_holdouts(people, rows):
    assert rows(X.stratified_holdout(people, "y", "key", 0.1, 1).where("part='test'").groupBy("y").count()) == [(0, 20), (1, 3)]
    assert X.holdout(people, "key", 0.2, 1).where("part='test'").count() == 46


def test_folds_partition(people, rows):
    folds = X.with_folds(people, "y", "key", 5, 42)
    assert rows(folds.groupBy("fold", "y").count()) == sorted([(f, y, n) for f in range(5) for y, n in ((0, 40), (1, 6))])


def test_oversample(people, rows):
    got = X.oversample(people, "y", "key", 1, 100, 3)
    assert rows(got.groupBy("y").count()) == [(0, 200), (1, 100)]


def test_shuffle_keeps_values(spark, rows):
    long = spark.createDataFrame([(k, f, float(k)) for k in range(50) for f in ("a", "b")], "key INT, feature STRING, value DOUBLE")
    got = X.shuffle_features(long, 1)
    assert rows(got, "feature", "value") == rows(long, "feature", "value")
    assert rows(got, "feature", "key") == rows(long, "feature", "key")
    assert rows(got) != rows(long)


def test_random_features(spark):
    long = spark.createDataFrame([(0, f"f{i}", 1.0) for i in range(40)], "key INT, feature STRING, value DOUBLE")
    got = X.random_features(long, 10, 5, 1)
    assert {r["count"] for r in got.groupBy("draw").count().collect()} == {10}


@pytest.mark.parametrize("few", [0, 8192])
@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_nearest_against_brute_force(spark, monkeypatch, p, few):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "FEW_QUERIES", few)
    rng = np.random.default_rng(2)
    known = np.vstack([rng.normal(size=(90, 3)), np.repeat([[5.0, 5.0, 5.0]], 45, axis=0), rng.normal(8, 0.1, size=(20, 3))])
    asked = np.vstack([rng.normal(size=(20, 3)), [[5.0, 5.0, 5.0], [8.0, 8.0, 8.0]]])
    to_df = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id INT, vec ARRAY<DOUBLE>")
    got = {}
    for r in N.nearest(to_df(asked), to_df(known), 4, p).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"]))
    for i, q in enumerate(asked):
        dist = (np.abs(known - q) ** p).sum(axis=1) ** (1 / p)
        want = np.lexsort((np.arange(len(known)), dist))[:4]
        assert [x for _, x in sorted(got[i])] == want.tolist()


def test_screened_distances_are_those_of_all_pairs():
    """Copies, shifted, huge and tiny numbers, and rows without a distance."""
    rng = np.random.default_rng(3)
    for scale, shift in ((1, 0), (1e-3, 1e6), (1, 1e9), (1e150, 0), (1e-200, 0)):
        a, b = (rng.normal(size=(n, 7)) * scale + shift for n in (600, 2300))
        b[40:90], a[5], a[6], b[8, 2] = b[30], b[30], np.nan, np.inf
        with np.errstate(all="ignore"):
            dist = N.distances(a, b, 2)
        dist[~np.isfinite(dist)] = np.inf
        order = np.argsort(dist, axis=1, kind="stable")[:, :9]
        least = np.take_along_axis(dist, order, axis=1)
        known = np.isfinite(least)
        row, col, found = N.closest((a, None), (b, None), 9)
        assert row.tolist() == np.repeat(np.arange(600), known.sum(axis=1)).tolist()
        assert col.tolist() == order[known].tolist() and found.tolist() == least[known].tolist()


def test_many_queries_go_out_in_few_copies(spark, monkeypatch):
    """A training row that all queries may need is sent once to each task's worth of them; a query without a distance takes no one's neighbours."""
    monkeypatch.setattr(N, "FEW_QUERIES", 10)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    vecs = np.random.default_rng(6).normal(size=(600, 40))
    vecs[3, 1] = np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id LONG, vec ARRAY<DOUBLE>")
    found = N.nearest(df.where("id < 200"), df.where("id >= 200"), 3)
    moved = []
    plain = type(df).repartitionById
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, by: moved.append(self.count()) or plain(self, n, by))
    again = N.nearest(df.where("id < 200"), df.where("id >= 200"), 3)
    assert moved == [600] and sorted(again.collect()) == sorted(found.collect())
    dist = np.linalg.norm(vecs[:200, None] - vecs[None, 200:], axis=2)
    want = {(q, int(i) + 200, place + 1) for q in range(200) if q != 3 for place, i in enumerate(np.argsort(dist[q])[:3])}
    assert {(r["query"], r["id"], r["place"]) for r in found.collect()} == want


def test_nearest_excludes_self(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id INT, vec ARRAY<DOUBLE>")
    got = {r["query"]: r["id"] for r in N.nearest(df, df, 1, exclude_self=True).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


def test_knn_votes(spark):
    train = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 1), (2, [1.2], 1), (3, [9.0], 0)], "key INT, vec ARRAY<DOUBLE>, label INT")
    test = spark.createDataFrame([(10, [0.0]), (11, [1.1])], "key INT, vec ARRAY<DOUBLE>")
    plain = {r["key"]: r["prediction"] for r in N.knn(train, test, 3).collect()}
    near = {r["key"]: r["prediction"] for r in N.knn(train, test, 3, weights="distance").collect()}
    assert plain == {10: 1, 11: 1} and near == {10: 0, 11: 1}


def test_smote_without_continuous_columns(spark):
    data = [(str(i), 1 if i < 5 else 0, "uv"[i % 2]) for i in range(20)]
    made = X.smote_nc(spark.createDataFrame(data, "key STRING, y INT, c STRING"), "y", "key", [], ["c"], k=2)
    assert made.where("y = 1").count() == 15 and made.where("c is null").count() == 0


def test_smote(spark):
    rnd = random.Random(4)
    data = [(str(i), 1 if i < 12 else 0, rnd.random(), rnd.random(), rnd.choice("uv")) for i in range(60)]
    df = spark.createDataFrame(data, "key STRING, y INT, a DOUBLE, b DOUBLE, c STRING")
    got = X.smote_nc(df, "y", "key", ["a", "b"], ["c"], k=5, seed=1).collect()
    new = [r for r in got if r["synthetic"]]
    assert len(new) == 36 and len({r["key"] for r in got}) == 96
    few = [d for d in data if d[1] == 1]
    for r in new:
        assert r["c"] in "uv"
        assert min(d[2] for d in few) <= r["a"] <= max(d[2] for d in few)
        ends = [(p, q) for p in few for q in few if p is not q]
        cross = [abs((r["a"] - p[2]) * (q[3] - p[3]) - (r["b"] - p[3]) * (q[2] - p[2])) for p, q in ends]
        assert min(cross) < 1e-9  # on the line between two minority rows


def test_shuffled_features_do_not_depend_on_the_buckets(spark, rows):
    """Many small features in few buckets: the sizes of the buckets are then a small table."""
    from traitweave.operators.sampling import shuffle_features

    long = spark.createDataFrame([(k, f"f{i}", float(k * 10 + i)) for k in range(30) for i in range(3)], "key INT, feature STRING, value DOUBLE")
    got = [rows(shuffle_features(long, 7, digits=d)) for d in (0, 1, 3)]
    assert got[0] == got[1] == got[2] == rows(shuffle_features(long, 7))
