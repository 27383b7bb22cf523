import math
import random

import pytest
from pyspark.sql import functions as F

from traitweave.operators import aggregating as A
from traitweave.operators import joining as J
from traitweave.operators import ranking as R
from traitweave.operators import reshape as P
from traitweave.operators.stats import permutation_test
from traitweave.plans import ordering as O

WIDE = [
    ("a", None, 0.3, 0.2, None),
    ("b", 0.5, None, 0.4, 0.7),
    ("c", 0.5, 0.0, None, 0.6),
    ("d", 0.0, 0.1, 0.4, None),
]


@pytest.fixture
def importances(spark):
    wide = spark.createDataFrame(WIDE, "f1 STRING, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    return P.melt(wide, "f1", feature="f2", value="v")


def test_average_rank(importances, rows):
    ranked = R.rank_desc_average(importances, "f2", "v")
    assert rows(ranked.where("f2 = 'a'"), "f1", "rank") == [("b", 1.5), ("c", 1.5), ("d", 3.0)]
    assert rows(ranked.where("f2 = 'c'"), "f1", "rank") == [("a", 3.0), ("b", 1.5), ("d", 1.5)]


def test_average_rank_large_groups_agree(spark, rows):
    rnd = random.Random(3)
    data = [(i, "x" if i % 5 else "y", rnd.choice([None, 0.0, 0.0, rnd.random()])) for i in range(500)]
    df = spark.createDataFrame(data, "id INT, t STRING, v DOUBLE")
    small = O.average_rank(df, ["t"], "v", large=False)
    big = O.average_rank(df, ["t"], "v", large=True)
    assert rows(small, "id", "rank") == rows(big, "id", "rank")


def test_mutual_rank(importances, rows):
    ranks = R.rank_desc_average(importances, "f2", "v")
    assert rows(R.mutual_rank(ranks)) == [
        ("a", "b", 1.224745), ("a", "c", 2.12132), ("b", "c", 2.12132), ("b", "d", 1.414214), ("c", "d", 1.732051),
    ]
    assert [r[:2] for r in rows(R.mutual_rank_nonzero(importances))] == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]


def test_geometric_mean_keeps_zero(importances, rows):
    got = {r[:2]: r[2] for r in rows(R.geometric_mean_importance(importances))}
    assert got == {
        ("a", "b"): 0.387298, ("a", "c"): 0.316228, ("b", "c"): 0.0, ("b", "d"): 0.264575, ("c", "d"): 0.489898,
    }


def test_mutual_rank_is_symmetric(importances, rows):
    ranks = R.rank_desc_average(importances, "f2", "v")
    swapped = ranks.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "rank")
    assert rows(R.mutual_rank(ranks)) == rows(R.mutual_rank(swapped))


def test_reciprocal_pairs(spark, rows):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 2.0), ("a", "a", 9.0), ("a", "c", 3.0)], "f1 STRING, f2 STRING, v DOUBLE")
    assert rows(J.reciprocal_pairs(df)) == [("a", "b", 1.0, 2.0)]


def test_histogram_and_box(spark, rows):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.2, 2.0, 2.5, 4.0, 8.0)], "v DOUBLE")
    assert [r[1] for r in rows(A.histogram(df, "v", 4), "bin", "n")] == [4, 1, 0, 1]
    for large in (False, True):
        q = O.quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.75}, large=large)
        assert rows(q, "a", "b", "c") == [(1.4, 2.25, 3.625)]
    assert rows(A.box_summary(df, "v"), "whisker_low", "whisker_high", "n_outliers") == [(1.0, 4.0, 1)]


def test_running_sums_large_groups_agree(spark, rows):
    rnd = random.Random(5)
    data = [(rnd.choice("ppppq"), rnd.randint(0, 40), rnd.randint(0, 9)) for _ in range(600)]
    df = spark.createDataFrame(data, "g STRING, o INT, w INT")
    for down in (False, True):
        got = [
            rows(O.running_sums(df, ["g"], ["o"], {"w": F.sum("w"), "n": F.count(F.lit(1))}, down, large=large),
                 "g", "o", "w", "n", "cum_w", "cum_n", "total_w", "total_n")
            for large in (False, True)
        ]
        assert got[0] == got[1]


def test_sequence_number_large_table_with_copies(spark, rows, monkeypatch):
    monkeypatch.setattr(O, "CHUNK_ROWS", 7)
    df = spark.createDataFrame([(i % 3, "same") for i in range(100)] + [(1, "z")], "a INT, b STRING")
    small = O.sequence_number(df, ["a"], large=False)
    big = O.sequence_number(df, ["a"], large=True)
    assert rows(small, "a", "b", "seq") == rows(big, "a", "b", "seq")
    assert sorted(r[0] for r in big.select("seq").collect()) == list(range(101))


def test_sequence_number_in_groups(spark, rows):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "g STRING, v INT")
    for large in (False, True):
        got = O.sequence_number(df, ["v"], ["g"], start=1, large=large)
        assert rows(got, "g", "v", "seq") == [("x", 1, 1), ("x", 3, 2), ("y", 2, 1)]


def test_split_puts_null_below(spark, rows):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "v DOUBLE")
    assert rows(P.split_at(df, "v", 5.0).groupBy("side").count()) == [("above", 1), ("below", 2)]


def test_families(spark, rows):
    names = ["go_GO:1", "tpm_x", "pfa_y", "ppi_z", "pep_mw", "zzz_q"]
    df = spark.createDataFrame([(n,) for n in names], "f STRING")
    assert dict(rows(P.with_family(df, "f"))) == {
        "go_GO:1": "GO", "tpm_x": "Expression", "pfa_y": "Protein Domain", "ppi_z": "Networks",
        "pep_mw": "Others", "zzz_q": "zzz_q",
    }
    pairs = spark.createDataFrame([("tpm_x", "go_GO:1"), ("go_GO:1", "tpm_x")], "a STRING, b STRING")
    assert P.with_pair_family(pairs, "a", "b").select("pair").distinct().count() == 1


def test_category_proportions(spark, rows):
    pairs = spark.createDataFrame(
        [("go_1", "tpm_1", "above"), ("go_2", "go_3", "below"), ("pfa_1", "go_1", "below")], "f1 STRING, f2 STRING, side STRING"
    )
    got = {r[0]: r[1:] for r in rows(A.category_proportions(pairs), "feature_cat", "above_thresh", "below_thresh", "prop_diff")}
    assert got == {"go": (0.5, 0.75, -0.25), "tpm": (0.5, None, None), "pfa": (None, 0.25, None)}


def test_permutation_test_against_loop(spark):
    data = [(f"c{i}", 0.1 * i, 0.3 - 0.02 * i) for i in range(5)]
    data = [(c, a, b, a - b) for c, a, b in data]
    props = spark.createDataFrame(data, "feature_cat STRING, above_thresh DOUBLE, below_thresh DOUBLE, prop_diff DOUBLE")
    got = {r[0]: r[1] for r in permutation_test(props, 400, 1).collect()}
    rnd, counts = random.Random(0), dict.fromkeys(got, 0)
    for _ in range(4000):
        above, below = [d[1] for d in data], [d[2] for d in data]
        rnd.shuffle(above), rnd.shuffle(below)
        for (c, _, _, diff), x, y in zip(data, above, below):
            counts[c] += diff < x - y
    for c, p in got.items():
        assert math.isclose(p, counts[c] / 4000, abs_tol=0.1)


def test_top_percent_keeps_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 2, 3, 4, 5, 6, 7, 8]], "v INT")
    assert R.top_percent(df, "v", 10).count() == 3
    assert R.top_count(45449474, 1) == 454495


@pytest.mark.parametrize("descending", [False, True])
def test_sequence_number_is_the_same_for_small_and_large_groups(spark, rows, descending):
    data = [(1, None), (1, "a"), (1, "b"), (None, "c"), (None, None), (2, "b"), (2, "b"), (0, None)]
    df = spark.createDataFrame(data, "x INT, t STRING")
    small, large = (rows(O.sequence_number(df, ["x"], descending=descending, large=big)) for big in (False, True))
    assert small == large


@pytest.mark.parametrize("descending", [False, True])
def test_ranks_are_the_same_for_small_and_large_groups(spark, rows, descending):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([None, 1.0, 2.5, 2.5, 7.0, float(i)])) for i in range(200)]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE")
    small, large = (rows(O.average_rank(df, ["g"], "v", descending=descending, large=big)) for big in (False, True))
    assert small == large
    small, large = (rows(O.quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5}, large=big)) for big in (False, True))
    assert small == large


def test_ranks_of_many_rows_are_sorted_in_more_tasks(spark, rows, monkeypatch):
    """The number of tasks follows the rows that were counted, not only the session; ranks stay."""
    from traitweave.plans import ordering

    df = spark.range(600).selectExpr("concat('t', id % 50) as t", "id % 7 as v").unionByName(spark.sql("select 't1' as t, cast(null as bigint) as v union all select null, 3"))
    want = rows(ordering.average_rank(df, ["t"], "v"))
    monkeypatch.setattr(ordering, "TASK_ROWS", 10)
    found = ordering.average_rank(df, ["t"], "v")
    assert found.rdd.getNumPartitions() >= 122 and rows(found) == want
