"""Stages for ``pyspark.ml.Pipeline`` over plain columns: scaling, powers, any function of a frame, regression by gradient descent.

What is learned from the training rows (moments, weights) is frozen in the fitted stage, so held-out rows are scaled as the training
rows were. Stages chain with each other and with those of ``pyspark.ml``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import ml


class Mapped(Transformer):
    """A stage from a function of a frame."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)


class Scaled(Estimator):
    """Columns by the mean and population deviation of the training rows; a column without spread is centred only. Nulls stay."""

    def __init__(self, columns: Sequence[str]):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> Transformer:
        row = dataset.agg(*[f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        moments = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in self.columns}
        return Mapped(lambda df: df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in moments.items()}))


class Powers(Transformer):
    """Adds ``column_2`` to ``column_degree``."""

    def __init__(self, column: str, degree: int):
        super().__init__()
        if degree < 1:
            raise ValueError("the degree is 1 at least")
        self.column, self.degree = column, degree

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({f"{self.column}_{d}": F.pow(self.column, F.lit(d)) for d in range(2, self.degree + 1)})


class Descent(Estimator):
    """A linear model by :func:`lattica.operators.ml.gradient_descent`; the fitted stage adds ``prediction``.

    Rows with a null among features or label don't teach; a null feature gives a null prediction.
    """

    def __init__(self, features: Sequence[str], label: str, loss: str = "squared", steps: int = 50, rate: float = 0.1, l2: float = 0.0):
        super().__init__()
        self.features, self.label, self.options = list(features), label, {"loss": loss, "steps": steps, "rate": rate, "l2": l2}

    def _fit(self, dataset: DataFrame) -> Transformer:
        rows = dataset.select(*self.features, self.label).dropna()
        w = ml.gradient_descent(rows, self.features, self.label, **self.options)
        return Mapped(lambda df: df.withColumn("prediction", sum((F.col(f) * w[f] for f in self.features), F.lit(w["intercept"]))))


def evaluate(model: PipelineModel | Transformer, df: DataFrame, label: str) -> DataFrame:
    """Pairs of truth and prediction; a stage that changes the label changes its truth too."""
    return model.transform(df).select(F.col(label).alias("truth"), "prediction")
