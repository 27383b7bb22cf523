import random

from traitweave.operators import evaluation as E


def _pred(spark):
    data = [(1, 0.9), (1, 0.6), (0, 0.6), (0, 0.4), (1, 0.3), (0, 0.1)]
    return spark.createDataFrame([(i, y, s, int(s > 0.5)) for i, (y, s) in enumerate(data)], "key INT, y_true INT, score DOUBLE, y_hat INT")


def test_scores(spark, rows):
    conf = E.confusion(_pred(spark))
    assert rows(conf) == [(2, 1, 1, 2)]
    assert rows(E.prf(conf), "f1", "precision", "recall") == [(0.666667, 0.666667, 0.666667)]
    assert rows(E.tpr_tnr(conf), "tpr", "tnr") == [(0.666667, 0.666667)]
    assert rows(E.roc_auc(_pred(spark))) == [(0.722222,)]
    assert len(rows(E.roc_points(_pred(spark)))) == 5


def test_zero_denominator(spark, rows):
    pred = spark.createDataFrame([(1, 0), (0, 0)], "y_true INT, y_hat INT")
    assert rows(E.prf(E.confusion(pred)), "f1", "precision", "recall") == [(0.0, 0.0, 0.0)]


def test_auc_against_pairs(spark):
    rnd = random.Random(9)
    data = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    got = E.roc_auc(spark.createDataFrame(data, "y_true INT, score DOUBLE")).first()[0]
    assert abs(got - want) < 1e-12


def test_report(spark, rows):
    got = {r["class"]: r for r in E.classification_report(_pred(spark)).collect()}
    assert got["1"]["support"] == 3 and round(got["macro avg"]["f1"], 6) == 0.666667
    assert got["weighted avg"]["support"] == 6


def test_r_squared(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y_true DOUBLE, y_hat DOUBLE")
    mean = 7 / 3
    want = 1 - (0.25 + 0 + 1) / sum((y - mean) ** 2 for y in (1, 2, 4))
    assert abs(E.r_squared(df).first()[0] - want) < 1e-12


def test_best_params(spark, rows):
    cv = spark.createDataFrame([("t1", "a=1", 0.5), ("t1", "a=2", 0.7), ("t2", "a=2", 0.6), ("t2", "a=1", 0.6)], "target STRING, params STRING, mean DOUBLE")
    best = E.best_params(cv, "target")
    assert rows(best, "target", "params") == [("t1", "a=2"), ("t2", "a=1")]
    assert rows(E.most_frequent_params(best)) == [("a=1", 1), ("a=2", 1)]
