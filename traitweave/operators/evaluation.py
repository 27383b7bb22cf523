"""Scores from prediction tables ``(y_true, y_hat, score)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import running_sums


def _by(by) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def confusion(pred: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp; the positive class is 1."""
    actual, said = F.col("y_true") == 1, F.col("y_hat") == 1
    return pred.groupBy(*_by(by)).agg(
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(actual & said).alias("tp"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(conf: DataFrame) -> DataFrame:
    """F1, precision, recall; 0 where the denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.withColumns(
        {"f1": _ratio(2 * tp, 2 * tp + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)}
    )


def tpr_tnr(conf: DataFrame) -> DataFrame:
    """Rates of found positives and negatives, NULL without such rows."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return conf.withColumns({"tpr": F.try_divide(tp, tp + fn), "tnr": F.try_divide(tn, tn + fp)})


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means.

    Predictions are first counted per (truth, prediction) pair.
    """
    pairs = pred.groupBy("y_true", "y_hat").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("y_true").cast("string").alias("class"), F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("said"),
                    F.when(F.col("y_true") == F.col("y_hat"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("y_hat").cast("string").alias("class"), F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    each = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])
    scores = each.select(
        "class",
        _ratio(F.col("hit"), F.col("said")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"),
        "support",
    )
    names = ("precision", "recall", "f1")
    macro = scores.agg(
        F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")
    )
    weighted = scores.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return scores.unionByName(macro).unionByName(weighted)


def _thresholds(pred: DataFrame, score: str, label: str, by) -> DataFrame:
    measures = {
        "tp": F.sum((F.col(label) == 1).cast("bigint")),
        "fp": F.sum((F.col(label) != 1).cast("bigint")),
    }
    return running_sums(pred, _by(by), [score], measures, descending=True)


def roc_points(pred: DataFrame, score: str = "score", label: str = "y_true", by=None) -> DataFrame:
    """``(threshold, tpr, fpr)`` for every distinct score; the start (0, 0) is implied."""
    steps = _thresholds(pred, score, label, by)
    return steps.select(
        *_by(by), F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_tp").cast("double"), F.col("total_tp")).alias("tpr"),
        F.try_divide(F.col("cum_fp").cast("double"), F.col("total_fp")).alias("fpr"),
    )


def roc_auc(pred: DataFrame, score: str = "score", label: str = "y_true", by=None) -> DataFrame:
    """Area under the ROC curve, ties counted half.

    Each step adds its negatives times the positives above it plus half of its
    own, so no row needs its predecessor.
    """
    steps = _thresholds(pred, score, label, by)
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / F.lit(2.0)))
    pairs = F.max("total_tp").cast("double") * F.max("total_fp")
    return steps.groupBy(*_by(by)).agg(F.try_divide(area, pairs).alias("auc"))


def r_squared(pred: DataFrame, by=None) -> DataFrame:
    """1 - residual / total sum of squares of ``(y_true, y_hat)``."""
    error = F.sum(F.pow(F.col("y_true") - F.col("y_hat"), F.lit(2)))
    spread = F.count(F.lit(1)) * F.var_pop("y_true")
    return pred.groupBy(*_by(by)).agg((1 - F.try_divide(error, spread)).alias("r2"))


def best_params(cv_results: DataFrame, by: str | Sequence[str], metric: str = "mean") -> DataFrame:
    """The parameter text with the best mean score per run or target; equal
    scores go to the first in text order."""
    return cv_results.groupBy(*_by(by)).agg(
        F.min_by("params", F.struct(-F.col(metric), F.col("params"))).alias("params"), F.max(metric).alias(metric)
    )


def most_frequent_params(best: DataFrame) -> DataFrame:
    """How often each setting was the best one, most frequent first."""
    counts = best.groupBy("params").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "params")


def prediction_table(model, df: DataFrame, key: str = "key") -> DataFrame:
    """``(key, y_true, y_hat, score)``: score is the probability of class 1, or
    the decision value of models without probabilities."""
    out = model.transform(df)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("score") if "score" in out.columns else F.col("prediction")
    return out.select(key, F.col("label").alias("y_true"), F.col("prediction").alias("y_hat"), score.alias("score"))
