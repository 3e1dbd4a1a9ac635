"""The contract of forecast models.

``fit(train, val=None)`` learns from feature rows and returns the model. ``predict(rows)`` adds one struct
column ``pred_<name>`` with fields ``yhat`` (array of 24), ``tmax``, ``tmin`` and ``tavg``, in one lazy step.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ForecastModel(Protocol):
    name: str

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> ForecastModel: ...

    def predict(self, rows: DataFrame) -> DataFrame: ...


def prediction(yhat: Column, tmax: Column | None = None, tmin: Column | None = None, tavg: Column | None = None) -> Column:
    """Prediction struct; daily summaries default to those of the hourly forecast."""
    mean = F.aggregate(yhat, F.lit(0.0), lambda a, v: a + v) / F.size(yhat)
    return F.struct(
        yhat.alias("yhat"),
        (F.array_max(yhat) if tmax is None else tmax).alias("tmax"),
        (F.array_min(yhat) if tmin is None else tmin).alias("tmin"),
        (mean if tavg is None else tavg).alias("tavg"),
    )


def with_prediction(rows: DataFrame, name: str, struct: Column) -> DataFrame:
    return rows.withColumn(f"pred_{name}", struct)


def score(models: list[ForecastModel], rows: DataFrame) -> DataFrame:
    for model in models:
        rows = model.predict(rows)
    return rows
