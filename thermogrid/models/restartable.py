"""Linear model trained in blocks of epochs, with stop rules, history tables and resume.

A run is a folder with two tables: ``epochs`` and ``blocks``. A block is published by writing its epoch rows
under a new ``iteration`` first and its ``blocks`` row (which holds the weights) last; rows of an iteration
without a ``blocks`` row are ignored, so a job that dies half-way leaves no trace in a resumed run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import OVERFIT_MIN_STEPS, OVERFIT_RATIO
from ..operators.rate_policy import RatePolicy, RateState, advance, start
from ..sources.paths import exists
from .linear import Adam, LinearBase, Problem, Scaling, _with_split
from .moments import absolute_errors, cross_products

EPOCHS_SCHEMA = (
    "iteration int, epoch int, train_loss double, val_loss double, train_mae double, val_mae double, lr double"
)
BLOCKS_SCHEMA = (
    "iteration int, epochs_run int, val_mae double, best_val_mae double, best_epoch int, status string, "
    "weights array<array<double>>, best_weights array<array<double>>, optimiser_steps int, "
    "optimiser_mean array<array<double>>, optimiser_square array<array<double>>, "
    "policy_state struct<lr:double,best:double,stale:int,at_floor:int,resting:int,decays:int>"
)


class RestartableLinear(LinearBase):
    """Features to 24 targets with squared loss. The policy watches validation loss.

    Validation and training loss come from cross-products, so the rates of a whole block are known without
    reading rows; one pass per block then measures the absolute errors of all its epochs.
    """

    name = "linear"

    def __init__(
        self,
        learning_rate: float = 0.001,
        policy: RatePolicy | None = None,
        epochs_per_iter: int = 5,
        max_iters: int = 4,
        target_mae: float = 1.0,
        steps_per_epoch: int = 50,
        features: list[str] | None = None,
        targets: list[str] | None = None,
    ):
        super().__init__(features, targets)
        base = policy or RatePolicy()
        self.policy = RatePolicy(**{**base.__dict__, "initial_lr": learning_rate})
        self.epochs_per_iter, self.max_iters, self.target_mae = epochs_per_iter, max_iters, target_mae
        self.steps_per_epoch = steps_per_epoch

    def fit(
        self, train: DataFrame, val: DataFrame | None = None, run_path: str | None = None, reset: bool = False
    ) -> RestartableLinear:
        spark = train.sparkSession
        val = train if val is None else val
        both = _with_split(train, val)
        moments, shift = cross_products(both, [*self.features, *self.targets], "_part")
        n_x = len(self.features)
        scaling = Scaling.fit(moments["train"], n_x, [len(self.targets)], shift)
        learn = Problem(moments["train"], n_x, scaling)
        # An empty validation period is scored on the training rows.
        check = Problem(moments.get("val", moments["train"]), n_x, scaling)

        past = self._resume(spark, run_path) if run_path and not reset else None
        if run_path and reset:
            self._write(spark, run_path, [], None, "overwrite")
        epochs = past["epochs"] if past else []
        weights = past["weights"] if past else np.zeros((n_x + 1, len(self.targets)))
        best_mae, best_epoch = (past["best_val_mae"], past["best_epoch"]) if past else (np.inf, 0)
        best_weights = past["best_weights"] if past else weights
        first_iteration = past["iteration"] + 1 if past else 1

        # A resumed run goes on with the optimiser's stored moments and the whole state of the policy.
        optimiser, state = (past["optimiser"], past["policy_state"] or start(self.policy)) if past else (Adam(weights.shape), start(self.policy))
        self.status, self.rate_events, self.blocks = "In Progress", [], []
        for iteration in range(first_iteration, first_iteration + self.max_iters):
            block, done = [], len(epochs)
            for epoch in range(done + 1, done + self.epochs_per_iter + 1):
                for _ in range(self.steps_per_epoch):
                    weights = optimiser.step(weights, learn.gradient(weights), state.lr)
                used, val_loss = state.lr, check.loss(weights)
                state = advance(self.policy, state, val_loss, epoch)
                if state.event:
                    self.rate_events.append({"step": epoch, "old_lr": used, "new_lr": state.lr, "policy": state.event})
                block.append((iteration, epoch, learn.loss(weights), val_loss, used, weights))
            raw = [scaling.raw_weights(b[-1]) for b in block]
            errors = absolute_errors(both, self.features, self.targets, raw, "_part")
            train_mae, val_mae = errors["train"], errors.get("val", errors["train"])
            rows = [(i, e, tl, vl, float(a), float(b), lr) for (i, e, tl, vl, lr, _), a, b in zip(block, train_mae, val_mae)]
            epochs = epochs + rows
            at = int(np.argmin(val_mae))
            if val_mae[at] < best_mae:
                best_mae, best_epoch, best_weights = float(val_mae[at]), block[at][1], block[at][-1]
            status = self._verdict(epochs, best_mae)
            self.blocks.append((iteration, len(epochs), float(val_mae[-1]), best_mae, best_epoch, status))
            if run_path:
                marker = (*self.blocks[-1], weights.tolist(), best_weights.tolist(),
                          optimiser.count, optimiser.mean.tolist(), optimiser.square.tolist(),
                          (state.lr, state.best, state.stale, state.at_floor, state.resting, state.decays))
                self._write(spark, run_path, rows, marker, "append")
            if status != "continue":
                break
        self.status = status if status != "continue" else "underfit"
        self.epochs, self.best_val_mae, self.best_epoch = epochs, best_mae, best_epoch
        self.weights = scaling.raw_weights(best_weights)
        return self

    def _verdict(self, epochs: list[tuple], best_mae: float) -> str:
        if best_mae <= self.target_mae:
            return "adequate"
        if len(epochs) >= OVERFIT_MIN_STEPS:
            lowest = min(e[3] for e in epochs)
            if epochs[-1][3] > OVERFIT_RATIO * lowest and epochs[-1][2] < epochs[0][2]:
                return "overfit"
        return "continue"

    @staticmethod
    def _write(spark: SparkSession, path: str, rows: list[tuple], marker: tuple | None, mode: str) -> None:
        spark.createDataFrame(rows, EPOCHS_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/epochs")
        markers = [marker] if marker else []
        spark.createDataFrame(markers, BLOCKS_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/blocks")

    @staticmethod
    def _resume(spark: SparkSession, path: str) -> dict | None:
        if not exists(spark, f"{path}/blocks"):
            return None
        blocks = spark.read.schema(BLOCKS_SCHEMA).parquet(f"{path}/blocks")
        last = blocks.orderBy(F.desc("iteration")).limit(1).collect()
        if not last:
            return None
        row = last[0]
        published = spark.read.schema(EPOCHS_SCHEMA).parquet(f"{path}/epochs").join(
            blocks.select("iteration"), "iteration", "left_semi"
        )
        optimiser = Adam(np.shape(row["weights"]))
        optimiser.count = row["optimiser_steps"]
        optimiser.mean, optimiser.square = np.array(row["optimiser_mean"]), np.array(row["optimiser_square"])
        return {
            "optimiser": optimiser, "policy_state": RateState(**row["policy_state"].asDict()) if row["policy_state"] else None, "epochs": [tuple(r) for r in published.orderBy("epoch").collect()],
            "weights": np.array(row["weights"]), "best_weights": np.array(row["best_weights"]),
            "best_val_mae": row["best_val_mae"], "best_epoch": row["best_epoch"], "iteration": row["iteration"],
        }

    def history_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.epochs, EPOCHS_SCHEMA)


class LastStepLinear(LinearBase):
    """Linear map from the last input step of a sliding window to its labels, with early stopping.

    Training stops after ``patience`` epochs without a lower validation loss and keeps the last weights.
    """

    name = "last_step"

    def __init__(
        self, features: list[str], targets: list[str], epochs: int = 20, patience: int = 2,
        learning_rate: float = 0.001, steps_per_epoch: int = 50,
    ):
        super().__init__(features, targets)
        self.epochs, self.patience, self.learning_rate = epochs, patience, learning_rate
        self.steps_per_epoch = steps_per_epoch

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> LastStepLinear:
        moments, shift = cross_products(_with_split(train, val), [*self.features, *self.targets], "_part")
        n_x, n_y = len(self.features), len(self.targets)
        # Inputs and labels arrive standardised, so no scaling is learned here.
        plain = Scaling(np.zeros(n_x), np.ones(n_x), np.zeros(n_y), np.ones(n_y), shift)
        learn = Problem(moments["train"], n_x, plain)
        check = Problem(moments.get("val", moments["train"]), n_x, plain)
        weights, best, waited = np.zeros((n_x + 1, n_y)), np.inf, 0
        optimiser, self.history = Adam(weights.shape), []
        for epoch in range(1, self.epochs + 1):
            for _ in range(self.steps_per_epoch):
                weights = optimiser.step(weights, learn.gradient(weights), self.learning_rate)
            loss = check.loss(weights)
            self.history.append({"epoch": epoch, "loss": learn.loss(weights), "val_loss": loss})
            best, waited = (loss, 0) if loss < best else (best, waited + 1)
            if waited >= self.patience:
                break
        self.weights = weights
        return self


def last_step_rows(windows: DataFrame, features: list[str], label: str, steps: int) -> tuple[DataFrame, list[str], list[str]]:
    """Flat training rows from sliding windows: the last input step and one column for each of the ``steps`` label steps."""
    x_names = [f"x_{c}" for c in features]
    y_names = [f"y_{i}" for i in range(1, steps + 1)]
    last = F.element_at("inputs", -1)
    flat = windows.select(
        "*", *[last[c].alias(n) for c, n in zip(features, x_names)],
        *[F.col("labels")[i][label].alias(n) for i, n in enumerate(y_names)],
    )
    return flat, x_names, y_names
