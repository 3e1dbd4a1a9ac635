"""The forecast job: clean series to features, models, scores and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..models.base import ForecastModel, score
from ..models.baselines import Climatology, Persistence
from ..models.boosting import HistogramBoosting
from ..models.linear import GradientRidge, LinearBase, Ridge
from ..models.restartable import RestartableLinear
from ..operators.evaluate import evaluate, evaluation_export, leaderboard, long_predictions, metrics_report
from ..operators.features import feature_matrix
from ..operators.profile import split_profile, split_report
from ..operators.rate_policy import RatePolicy
from ..operators.split import time_split
from ..schema import CHUNK_HOURS, HORIZON, PROFILE_BOUNDS, TS, Bounds, SplitDates
from ..session import materialise
from ..sources.paths import exists
from ..sources.readers import HISTORY_SCHEMA
from ..sources.writers import begin_run, choose_mode, finish_run, recover_run, write_histories, write_json

# Run state of each model in the output folder.
STATE = {"ridge": "models/ridge", "ridge_gradient": "models/ridge_gradient", "linear": "runs/linear", "trees": "models/trees"}
ALL_MODELS = ("persistence", "climatology", "ridge", "ridge_gradient", "linear", "trees")


@dataclass(frozen=True)
class JobParams:
    models: Sequence[str] = ALL_MODELS
    dates: SplitDates = field(default_factory=SplitDates)
    profile_bounds: Bounds = PROFILE_BOUNDS
    chunk_hours: int = CHUNK_HOURS
    alpha: float = 1.0
    policy: RatePolicy = field(default_factory=RatePolicy)
    epochs_per_iter: int = 5
    max_iters: int = 3
    target_mae: float = 1.0
    learning_rate: float | None = None  # None: each model's own
    tree_horizons: tuple[int, ...] = tuple(range(1, HORIZON + 1))
    tree_iterations: int = 40
    sample_size: int = 200

    def rated_policy(self) -> RatePolicy:
        return self.policy if self.learning_rate is None else replace(self.policy, initial_lr=self.learning_rate)


def fit_models(series: DataFrame, rows: DataFrame, params: JobParams, outputs: str | None, mode: str) -> list[ForecastModel]:
    """Fit (or, on resume, load) the chosen models. ``rows`` are feature rows with a ``split`` column."""
    spark = rows.sparkSession
    train, val = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
    before_test = series.where(F.col(TS) < F.lit(params.dates.test_start).cast("timestamp"))
    rate = {} if params.learning_rate is None else {"learning_rate": params.learning_rate}
    fitted: list[ForecastModel] = []
    for name in params.models:
        path = f"{outputs}/{STATE[name]}" if outputs and name in STATE else None
        if name == "persistence":
            fitted.append(Persistence())
        elif name == "climatology":
            fitted.append(Climatology().fit(before_test))
        elif name == "linear":
            model = RestartableLinear(
                policy=params.policy, epochs_per_iter=params.epochs_per_iter, max_iters=params.max_iters,
                target_mae=params.target_mae, **rate,
            )
            fitted.append(model.fit(train, val, run_path=path, reset=mode == "reset"))
        elif name == "trees":
            if path and mode == "resume" and exists(spark, path):
                fitted.append(HistogramBoosting.load(path))
                continue
            model = HistogramBoosting(params.tree_horizons, params.tree_iterations, policy=params.policy, **rate).fit(train, val)
            if path:
                model.save(path)
            fitted.append(model)
        elif name in ("ridge", "ridge_gradient"):
            model: LinearBase = Ridge(params.alpha) if name == "ridge" else GradientRidge(params.alpha, policy=params.rated_policy())
            model.fit(train, val)
            if path:
                model.save(spark, path)
            fitted.append(model)
        else:
            raise ValueError(f"unknown model {name!r}")
    return fitted


def consolidated_history(models: Sequence[ForecastModel], spark) -> DataFrame:
    """Epoch or stage errors of all models that learn step by step, in one table."""
    rows = []
    for model in models:
        if isinstance(model, RestartableLinear):
            rows += [(model.name, e[1], e[5], e[6]) for e in model.epochs]
        else:
            for i, h in enumerate(getattr(model, "history", []), 1):
                rows.append((model.name, h.get("epoch", h.get("stage", i)), h.get("val_mae"), h.get("learning_rate")))
    return spark.createDataFrame(rows, "run_id string, step int, val_mae double, lr double")


def training_records(models: Sequence[ForecastModel], spark) -> DataFrame:
    """The whole record of each model that learns step by step: epochs, blocks, stages, rate changes, best step and status.

    ``final_learning_rate`` is the rate after the last recorded step.
    """
    records = []
    for model in models:
        events = [{**e, "reason": _watched(model)} for e in getattr(model, "rate_events", [])]
        if isinstance(model, RestartableLinear):
            names = ("iteration", "epoch", "train_loss", "val_loss", "train_mae", "val_mae", "lr")
            record = {
                "epochs": [dict(zip(names, e)) for e in model.epochs],
                "iterations": [{"iteration": b[0], "epochs_run": b[1], "val_mae_c": b[2], "status": b[5]} for b in model.blocks],
                "total_epochs": len(model.epochs), "best_epoch": model.best_epoch, "best_val_mae": model.best_val_mae,
                "target_mae": model.target_mae, "final_status": model.status, "is_adequate": model.status == "adequate",
                "overfitting_detected": model.status == "overfit", "underfitting_detected": model.status == "underfit",
            }
        elif getattr(model, "history", None):
            steps = model.history
            kind = "stages" if "stage" in steps[0] else "epochs"
            errors = [(s["val_mae"], s[kind[:-1]]) for s in steps if s.get("val_mae") is not None]
            best = min(errors, default=(None, None))
            record = {kind: steps, "total_epochs": len(steps) if kind == "epochs" else 0, "best_val_mae": best[0],
                      "best_epoch": best[1], "status": "Completed"}
        else:
            continue
        last = (record.get("epochs") or record.get("stages"))[-1]
        rate = events[-1]["new_lr"] if events else last.get("lr", last.get("learning_rate"))
        records.append({"model": model.name, **record, "lr_decay_events": events, "final_learning_rate": rate})
    schema = T.StructType([T.StructField("model", T.StringType()), *HISTORY_SCHEMA.fields])
    return spark.createDataFrame(records, schema)


def _watched(model: ForecastModel) -> str:
    """What the rate policy of a model watches."""
    return "val_loss" if isinstance(model, RestartableLinear) else "val_mae"


def run_forecast(series: DataFrame, params: JobParams = JobParams(), outputs: str | None = None) -> dict[str, DataFrame]:
    """Whole job on a cleaned hourly series. With ``outputs`` also writes models and reports there.

    A run is written beside the folder and takes its place when it is whole, so a job that dies leaves the run before it readable.

    Series, features and predictions have several readers, so each is written once to the shared folder.
    """
    spark = series.sparkSession
    mode, folder = "reset", outputs
    if folder:
        state = [STATE[m] for m in params.models if m in STATE]
        recover_run(spark, folder)
        mode = choose_mode(spark, folder, state)
        outputs = begin_run(spark, folder, mode, state)
    series = materialise(series)
    rows = materialise(time_split(feature_matrix(series, chunk_hours=params.chunk_hours), params.dates))
    profile = split_profile(rows, bounds=params.profile_bounds)
    models = fit_models(series, rows, params, outputs, mode)
    scored = score(models, rows.where(F.col("split") == "test"))
    predictions = materialise(long_predictions(scored, [m.name for m in models]))
    scores = evaluate(predictions)
    out = {
        "profile": split_report(profile), "predictions": predictions, "scores": scores,
        "leaderboard": leaderboard(scores), "history": consolidated_history(models, spark),
    }
    if outputs:
        write_json(out["profile"], f"{outputs}/data_properties")
        write_json(metrics_report(scores), f"{outputs}/model_metrics")
        write_json(evaluation_export(predictions, params.sample_size, len(models)), f"{outputs}/test_predictions")
        write_histories(training_records(models, spark), f"{outputs}/training_histories")
        finish_run(spark, folder)
    return out
