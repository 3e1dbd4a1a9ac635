"""Forecast scores: error, tolerance, direction; leaderboard and exports.

Predictions come as one row per ``(series_id, ts, model)`` with the targets of the day ahead in ``y`` and
the forecast in ``yhat`` (both arrays), plus actual and predicted daily summaries. All models of a row
travel together, so features are computed once however many models are scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HORIZON, KEY, SUMMARY_TARGETS, TS, target_names
from .scalars import attach

# Tolerances in degrees and the size below which a value is left out of MAPE.
TOLERANCES = {"acc_1": 1.0, "acc_2": 2.0}
MAPE_FLOOR = 0.5
RESIDUAL_BINS = 25

SUMMARIES = ("tmax", "tmin", "tavg")


def long_predictions(scored: DataFrame, models: Sequence[str], horizon: int = HORIZON) -> DataFrame:
    """Scored feature rows (one struct column ``pred_<model>`` per model) to one row per model."""
    actual = dict(zip(SUMMARIES, SUMMARY_TARGETS))
    one_each = F.array(*[
        F.struct(F.lit(m).alias("model"), *[F.col(f"pred_{m}")[p].alias(p) for p in ("yhat", *SUMMARIES)])
        for m in models
    ])
    return scored.select(
        KEY, TS, F.col("temp_lag0").alias("now"), F.array(*target_names(horizon)).alias("y"),
        *[F.col(target).alias(f"actual_{s}") for s, target in actual.items()],
        F.inline(one_each),
    )


def _regression(y: Column, yhat: Column, prefix: str = "") -> list[Column]:
    """Error aggregates over the rows where ``y`` is not NULL."""
    error = yhat - y
    relative = F.when(F.abs(y) > MAPE_FLOOR, F.abs(error / y))
    squares, spread = F.sum(error * error), F.var_pop(y) * F.count(y)
    perfect = F.when(squares == 0, 1.0).otherwise(0.0)
    return [
        F.avg(F.abs(error)).alias(f"{prefix}mae"),
        F.sqrt(F.avg(error * error)).alias(f"{prefix}rmse"),
        F.coalesce(F.avg(relative) * 100.0, F.lit(0.0)).alias(f"{prefix}mape"),
        F.when(spread == 0, perfect).otherwise(1.0 - squares / F.nullif(spread, F.lit(0.0))).alias(f"{prefix}r2"),
    ]


def _tolerance(y: Column, yhat: Column) -> list[Column]:
    error = F.abs(yhat - y)
    return [(F.avg((error <= k).cast("double")) * 100.0).alias(n) for n, k in TOLERANCES.items()]


def _direction(rises: Column, predicted: Column) -> list[Column]:
    both, said, did = F.count_if(rises & predicted), F.count_if(predicted), F.count_if(rises)
    share = lambda part, whole: F.when(whole > 0, part / F.nullif(whole, F.lit(0)) * 100.0).otherwise(0.0)
    return [
        share(both, said).alias("directional_precision"),
        share(both, did).alias("directional_recall"),
        share(both * 2, said + did).alias("directional_f1"),
    ]


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row per model with all scores, unrounded.

    A single grouped aggregate with map-side combine over the hours of the day ahead; what counts once per
    row (daily summaries, direction) is taken from its last hour. One partial row per model leaves a task.
    """
    daily = [c for s in SUMMARIES for c in (f"actual_{s}", s)]
    hours = predictions.select("model", "now", *daily, (F.size("y") - 1).alias("_last"), F.posexplode(F.arrays_zip("y", "yhat")))
    flat = hours.select("model", "now", "col.y", "col.yhat", *[F.when(F.col("pos") == F.col("_last"), F.col(c)).alias(c) for c in daily],
                        (F.col("pos") == F.col("_last")).alias("_final"))
    y, yhat, now, final = F.col("y"), F.col("yhat"), F.col("now"), F.col("_final")
    return flat.groupBy("model").agg(
        F.count_if(final).alias("rows"), *_regression(y, yhat), *_tolerance(y, yhat),
        *_direction(final & (y > now), final & (yhat > now)),
        *[e for s in SUMMARIES for e in _regression(F.col(f"actual_{s}"), F.col(s), f"{s}_")],
    )


def metrics_report(scores: DataFrame) -> DataFrame:
    """Nested, rounded record per model for the JSON sink; ties round to even."""
    rounded = lambda c, d: F.bround(c, d).alias(c.split("_", 1)[1] if c.split("_")[0] in SUMMARIES else c)
    regression = lambda p: [rounded(f"{p}mae", 4), rounded(f"{p}rmse", 4), rounded(f"{p}mape", 2), rounded(f"{p}r2", 4)]
    return scores.select(
        F.col("model").alias("model_name"),
        F.struct(
            *regression(""), F.bround("acc_1", 2).alias("acc_1.0C"), F.bround("acc_2", 2).alias("acc_2.0C"),
            *[F.bround(c, 2).alias(c) for c in ("directional_precision", "directional_recall", "directional_f1")],
        ).alias("hourly_24h"),
        *[F.struct(*regression(f"{s}_")).alias(s) for s in SUMMARIES],
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """Models by error, best first. One row per model, so a single-partition window is fine."""
    return scores.select(
        F.row_number().over(Window.orderBy("mae", "model")).alias("place"), "model", "mae", "rmse", "acc_1", "acc_2",
        "directional_f1", "r2",
    ).withColumn("is_best", F.col("place") == 1)


def kpi_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.min_by("model", F.struct("mae", "model")).alias("best_model"), F.min("mae").alias("best_mae"),
        *[F.greatest(F.max(c), F.lit(0.0)).alias(f"best_{c}") for c in ("acc_1", "acc_2", "directional_f1")],
    )


def residuals(predictions: DataFrame, summary: str = "tmax") -> DataFrame:
    """``predicted - actual`` in long form, keyed by model."""
    error = F.col(summary) - F.col(f"actual_{summary}")
    return predictions.select("model", error.alias("value"), F.abs(error).alias("abs_error"))


def residual_summary(residual: DataFrame) -> DataFrame:
    return residual.groupBy("model").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def tail_rows(predictions: DataFrame, n: int = 200, models: int | None = None) -> DataFrame:
    """Predictions at the last ``n`` reference instants: a top-k on time, then a semi-join.

    ``models`` is the largest number of rows an instant of a series can have. With it the top-k comes first, without a
    shuffle of all instants; without it they are made distinct first.
    """
    newest = (F.desc(TS), F.col(KEY))
    instants = predictions.select(KEY, TS)
    if models:
        instants = instants.orderBy(*newest).limit(n * models)
    return predictions.join(instants.distinct().orderBy(*newest).limit(n), [KEY, TS], "left_semi")


def last_profiles(predictions: DataFrame) -> DataFrame:
    """The forecast and the truth at the last instant of each model, of the series with the largest key.

    The instant is found by a plain aggregate; only the rows at it carry their arrays further. Reads ``predictions`` twice.
    """
    last = predictions.groupBy("model").agg(F.max(TS).alias("last_ts"))
    at = attach(predictions.select("model", KEY, TS, "yhat", "y"), last, ["model"]).where(F.col(TS) == F.col("last_ts"))
    row = F.max_by(F.struct("yhat", "y"), KEY)
    return at.groupBy("model", "last_ts").agg(row.alias("_row")).select(
        "model", "last_ts", F.col("_row.yhat").alias("profile"), F.col("_row.y").alias("actual")
    )


def evaluation_export(predictions: DataFrame, n: int = 200, models: int | None = None) -> DataFrame:
    """Per model the last ``n`` daily summaries as arrays in time order, with the last 24-hour profile.

    Reads ``predictions`` four times: pass a written table. ``models`` as in :func:`tail_rows`.
    """
    entry = F.struct(TS, KEY, *[f for s in SUMMARIES for f in (s, f"actual_{s}")], "now")
    tail = tail_rows(predictions, n, models).groupBy("model").agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    series = lambda f: F.transform("_rows", lambda r: r[f])
    stamps = F.transform("_rows", lambda r: F.date_format(r[TS], "yyyy-MM-dd HH:mm"))
    return tail.join(last_profiles(predictions), "model").select(
        "model", stamps.alias("timestamps"), series("now").alias("actual_current_temp"),
        *[series(f"actual_{s}").alias(f"actual_next24_{s}") for s in SUMMARIES],
        *[series(s).alias(s) for s in SUMMARIES],
        F.col("profile").alias("sample_24h_profile"), F.col("actual").alias("actual_last_24h_profile"),
        F.date_format("last_ts", "yyyy-MM-dd HH:mm").alias("last_timestamp"),
    )


def validation_mae(predictions: DataFrame) -> DataFrame:
    """Mean absolute error over all rows and hours, per model."""
    hours = predictions.select("model", F.explode(F.arrays_zip("y", "yhat")).alias("_h"))
    return hours.groupBy("model").agg(F.avg(F.abs(F.col("_h.yhat") - F.col("_h.y"))).alias("val_mae"))
