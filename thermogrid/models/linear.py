"""Ridge and gradient-trained linear models.

Ridge is solved from the triangle of a QR decomposition over all rows, gradient steps go by cross-products; both are read off the data
in two passes. Solving, steps and squared losses then need no data at all. Mean absolute error does need rows: it is computed for many epochs in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rate_policy import RatePolicy, advance, start
from ..schema import SUMMARY_TARGETS, feature_names, target_names
from .base import prediction, with_prediction
from .moments import absolute_errors, affine, cross_products, triangle

WEIGHTS_SCHEMA = "model string, target string, term string, weight double"


def _with_split(train: DataFrame, val: DataFrame | None) -> DataFrame:
    rows = train.withColumn("_part", F.lit("train"))
    return rows if val is None else rows.unionByName(val.withColumn("_part", F.lit("val")))


@dataclass
class Scaling:
    """Shifts and scales of features and targets, and maps back to raw units.

    ``shift`` is what the cross-products were taken around; the means are in raw units.
    """

    mean_x: np.ndarray
    std_x: np.ndarray
    mean_y: np.ndarray
    std_y: np.ndarray
    shift: np.ndarray

    @classmethod
    def fit(cls, moments: np.ndarray, n_x: int, blocks: list[int], shift: np.ndarray) -> Scaling:
        """``blocks`` are sizes of target groups: a group of 24 shares one mean and deviation."""
        n, offset = moments[0, 0], moments[0, 1:] / moments[0, 0]
        var, means = np.maximum(np.diag(moments)[1:] / n - offset**2, 0.0), offset + shift
        std_x = np.sqrt(var[:n_x] * n / max(n - 1, 1))
        mean_y, std_y, at = [], [], n_x
        for size in blocks:
            group = slice(at, at + size)
            centre = means[group].mean()
            spread = np.sqrt((var[group] + (means[group] - centre) ** 2).mean())
            mean_y += [centre] * size
            std_y += [spread] * size
            at += size
        mean_x, mean_y = means[:n_x], np.array(mean_y)
        return cls(mean_x, _no_zero(std_x, mean_x), mean_y, _no_zero(np.array(std_y), mean_y), shift)

    def change(self) -> np.ndarray:
        centre = np.concatenate([self.mean_x, self.mean_y]) - self.shift
        return affine(len(centre) + 1, centre, np.concatenate([self.std_x, self.std_y]))

    def raw_weights(self, weights: np.ndarray) -> np.ndarray:
        """Weights on scaled data (first row: intercept) to weights on raw data."""
        slopes = weights[1:] / self.std_x[:, None] * self.std_y
        intercept = weights[0] * self.std_y + self.mean_y - self.mean_x @ slopes
        return np.vstack([intercept, slopes])


def _no_zero(deviations: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Deviations, with 1 for columns that are constant: each is held against its own mean, whatever its unit."""
    return np.where(deviations <= 1e-12 * np.abs(means), 1.0, deviations)


class Problem:
    """Least squares on scaled data, seen only through its cross-products."""

    def __init__(self, moments: np.ndarray, n_x: int, scaling: Scaling):
        change = scaling.change()
        scaled = change @ moments @ change.T
        self.n, edge = scaled[0, 0], n_x + 1
        # Means of scaled columns that are rounding alone: Adam would blow them up to whole steps of the intercept.
        means = np.where(np.abs(scaled[0, 1:]) <= 1e-10 * self.n, 0.0, scaled[0, 1:])
        scaled[0, 1:] = scaled[1:, 0] = means
        self.xx, self.xy, self.yy = scaled[:edge, :edge], scaled[:edge, edge:], np.diag(scaled)[edge:]

    def gradient(self, w: np.ndarray) -> np.ndarray:
        """Of half the mean squared error of each target."""
        return (self.xx @ w - self.xy) / self.n

    def loss(self, w: np.ndarray) -> float:
        squares = np.einsum("ij,ij->j", w, self.xx @ w) - 2 * np.einsum("ij,ij->j", w, self.xy) + self.yy
        return float(squares.sum() / (self.n * len(self.yy)))



def ridge_weights(r: np.ndarray, n_x: int, scaling: Scaling, alpha: float) -> np.ndarray:
    """Weights on scaled data (first row: intercept) from the triangle of the rows: least squares of it with the penalty's rows below."""
    scaled = r @ scaling.change().T
    penalty = np.sqrt(alpha) * np.eye(n_x + 1)
    penalty[0, 0] = 0.0
    left, right = np.vstack([scaled[:, :n_x + 1], penalty]), np.vstack([scaled[:, n_x + 1:], np.zeros((n_x + 1, r.shape[1] - n_x - 1))])
    return np.linalg.lstsq(left, right, rcond=1e-13)[0]


class LinearBase:
    """Scoring, saving and loading shared by all linear models. ``weights`` are in raw units."""

    name = "linear"
    summary_from_hours = True

    def __init__(self, features: list[str] | None = None, targets: list[str] | None = None):
        self.features = list(features or feature_names())
        self.targets = list(targets or target_names())
        self.weights: np.ndarray | None = None
        self.history: list[dict] = []
        self.rate_events: list[dict] = []

    def predict(self, rows: DataFrame) -> DataFrame:
        """One matrix product per Arrow batch: 27 targets x 74 terms are too many for generated code."""
        weights, n_hours = self.weights, len(self.targets)

        @F.pandas_udf("array<double>")
        def lines(*columns: pd.Series) -> pd.Series:
            inputs = np.column_stack([np.ones(len(columns[0])), *columns])
            return pd.Series(list(inputs @ weights))

        guessed = rows.withColumn("_out", lines(*[F.col(c).cast("double") for c in self.features]))
        out, hours = F.col("_out"), F.slice("_out", 1, n_hours)
        if self.summary_from_hours:
            struct = prediction(hours)
        else:
            struct = prediction(hours, out[n_hours], out[n_hours + 1], out[n_hours + 2])
        return with_prediction(guessed, self.name, struct).drop("_out")

    def weights_table(self, spark: SparkSession) -> DataFrame:
        names = self.targets + ([] if self.summary_from_hours else list(SUMMARY_TARGETS))
        rows = [
            (self.name, target, term, float(self.weights[i, j]))
            for j, target in enumerate(names) for i, term in enumerate(["", *self.features])
        ]
        return spark.createDataFrame(rows, WEIGHTS_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.weights_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark: SparkSession, path: str) -> LinearBase:
        table = spark.read.schema(WEIGHTS_SCHEMA).parquet(path).toPandas()
        names = self.targets + ([] if self.summary_from_hours else list(SUMMARY_TARGETS))
        wide = table.pivot(index="term", columns="target", values="weight").loc[["", *self.features], names]
        self.weights = wide.to_numpy()
        return self


class Ridge(LinearBase):
    """Closed-form ridge on standardised features and targets, all 24 + 3 targets from one solve; nearly equal features are told apart."""

    name = "ridge"
    summary_from_hours = False

    def __init__(self, alpha: float = 1.0, features: list[str] | None = None, targets: list[str] | None = None):
        super().__init__(features, targets)
        self.alpha = alpha

    def _moments(self, train: DataFrame, val: DataFrame | None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        return cross_products(_with_split(train, val), [*self.features, *self.targets, *SUMMARY_TARGETS], "_part")

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Ridge:
        r, shift = triangle(train, [*self.features, *self.targets, *SUMMARY_TARGETS])
        n_x = len(self.features)
        scaling = Scaling.fit(r.T @ r, n_x, [len(self.targets), 1, 1, 1], shift)
        self.weights = scaling.raw_weights(ridge_weights(r, n_x, scaling, self.alpha))
        return self


@dataclass
class GradientRidge(Ridge):
    """Ridge by gradient steps under a learning-rate policy that watches validation MAE.

    Epochs are computed ahead in blocks on the assumption that the rate stays as it is, and the MAE of the
    whole block is measured in one pass. Where the policy changes the rate, the rest of the block is
    computed again; the result is that of epoch-by-epoch training.
    """

    alpha: float = 1.0
    policy: RatePolicy = field(default_factory=lambda: RatePolicy(monitor="val_mae"))
    max_epochs: int = 15
    steps_per_epoch: int = 2
    block: int = 5
    features: list[str] | None = None
    targets: list[str] | None = None

    name = "ridge_gradient"

    def __post_init__(self):
        LinearBase.__init__(self, self.features, self.targets)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> GradientRidge:
        if val is None or not self.policy.enabled:
            return super().fit(train)
        moments, shift = self._moments(train, val)
        n_x, targets = len(self.features), [*self.targets, *SUMMARY_TARGETS]
        scaling = Scaling.fit(moments["train"], n_x, [len(self.targets), 1, 1, 1], shift)
        problem = Problem(moments["train"], n_x, scaling)
        held_out = val.withColumn("_part", F.lit("val"))
        weights, state = np.zeros((n_x + 1, len(targets))), start(self.policy)
        epoch, self.history, self.rate_events = 0, [], []
        while epoch < self.max_epochs:
            ahead = self._epochs(problem, weights, state.lr, min(self.block, self.max_epochs - epoch))
            hourly = [scaling.raw_weights(w)[:, : len(self.targets)] for w in ahead]
            errors = absolute_errors(held_out, self.features, self.targets, hourly, "_part")["val"]
            for weights, error in zip(ahead, errors):
                epoch, used = epoch + 1, state.lr
                state = advance(self.policy, state, float(error), epoch)
                self.history.append({"epoch": epoch, "val_mae": float(error), "learning_rate": used})
                if state.event:
                    self.rate_events.append({"step": epoch, "old_lr": used, "new_lr": state.lr, "policy": state.event})
                    break
        self.final_lr = state.lr
        self.weights = scaling.raw_weights(weights)
        return self

    def _epochs(self, problem: Problem, weights: np.ndarray, lr: float, count: int) -> list[np.ndarray]:
        out = []
        for _ in range(count):
            for _ in range(self.steps_per_epoch):
                slope = problem.gradient(weights)
                slope[1:] += self.alpha * weights[1:]
                weights = weights - lr * slope
            out.append(weights)
        return out


class Adam:
    """Adam steps on a cross-product problem, with state that can be stored and resumed."""

    def __init__(self, shape: tuple[int, int]):
        self.mean, self.square, self.count = np.zeros(shape), np.zeros(shape), 0

    def step(self, weights: np.ndarray, slope: np.ndarray, lr: float) -> np.ndarray:
        self.count += 1
        self.mean = 0.9 * self.mean + 0.1 * slope
        self.square = 0.999 * self.square + 0.001 * slope**2
        mean, square = self.mean / (1 - 0.9**self.count), self.square / (1 - 0.999**self.count)
        return weights - lr * mean / (np.sqrt(square) + 1e-7)
