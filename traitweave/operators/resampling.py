"""Balancing that happens while a model is fitted, and only there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import oversample, smote_nc, undersample


class Resampled(Estimator):
    """Fits ``estimator`` on resampled rows and returns its model, which sees other rows as they are.

    Within folds the rows that are left out are never drawn, copied or mixed into
    synthetic ones, as they are when a whole table is resampled before it is cut.
    ``sample`` takes and returns a DataFrame; parameters, searched ones too, are
    those of ``estimator``, which may be a pipeline.
    """

    def __init__(self, estimator: Estimator, sample: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.estimator, self.sample = estimator, sample

    def _fit(self, dataset: DataFrame) -> Model:
        # One set of rows for every pass of the estimator.
        rows = self.sample(dataset).persist()
        try:
            return self.estimator.fit(rows)
        finally:
            rows.unpersist()

    def copy(self, extra=None) -> Resampled:
        return Resampled(self.estimator.copy(extra), self.sample)

    def getParam(self, paramName: str):
        """Of the estimator; of the last stage if that is a pipeline."""
        inner = self.estimator
        return (inner.getStages()[-1] if hasattr(inner, "getStages") else inner).getParam(paramName)


def undersampled(estimator: Estimator, label: str = "label", key: str = "key", seed=42) -> Resampled:
    """Every class as large as the smallest one."""
    return Resampled(estimator, lambda df: undersample(df, label, key, seed))


def oversampled(estimator: Estimator, label: str = "label", key: str = "key", minority=1, seed=42) -> Resampled:
    """The minority drawn with replacement until it is as large as the rest."""

    def sample(df: DataFrame) -> DataFrame:
        n = df.where(~F.col(label).eqNullSafe(F.lit(minority))).count()
        return oversample(df, label, key, minority, n, seed)

    return Resampled(estimator, sample)


def with_synthetic(estimator: Estimator, cont: Sequence[str], cat: Sequence[str], label: str = "label", key: str = "key", minority=1, k: int = 5,
                   seed=42) -> Resampled:
    """Synthetic minority rows until the minority is as large as the rest."""
    return Resampled(estimator, lambda df: smote_nc(df, label, key, cont, cat, k, seed, minority).drop("synthetic"))
