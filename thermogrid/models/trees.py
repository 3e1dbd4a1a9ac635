"""Boosted trees on MLlib, one ensemble per target, grown in stages.

Each stage boosts on what the stages before it left over, at the rate the policy currently allows, and the
validation error decides the next rate. Targets are fitted from one cached feature table; jobs of
different targets run side by side on the cluster through a small thread pool.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rate_policy import RatePolicy, advance, start
from ..schema import HORIZON, SUMMARY_TARGETS, feature_names
from ..session import materialise
from .base import prediction, with_prediction


def stage_sizes(trees: int, stages: int = 5, least: int = 5) -> list[int]:
    """Trees of each stage: about equal, at least ``least``, the last one taking what is left; exactly ``trees`` in all."""
    size = max(least, trees // stages)
    full = max(1, trees // size)
    return [size] * (full - 1) + [trees - size * (full - 1)]


class BoostedTrees:
    """``horizons`` are the hours fitted; hours between them are read off the straight line.

    All 24 hours is the full model. Fewer make it cheaper: cost is proportional to the targets.
    """

    name = "trees"

    def __init__(
        self, horizons: tuple[int, ...] = tuple(range(1, HORIZON + 1)), max_iter: int = 40, learning_rate: float = 0.1,
        max_depth: int = 5, seed: int = 42, policy: RatePolicy | None = None, parallel: int = 4,
        features: list[str] | None = None,
    ):
        self.horizons, self.max_iter, self.max_depth, self.seed, self.parallel = horizons, max_iter, max_depth, seed, parallel
        base = policy or RatePolicy(monitor="val_mae", min_lr=1e-5)
        self.policy = RatePolicy(**{**base.__dict__, "initial_lr": learning_rate})
        self.features = list(features or feature_names())
        self.targets = [f"target_h{h}" for h in horizons] + list(SUMMARY_TARGETS)
        self.stages: dict[str, list[GBTRegressionModel]] = {t: [] for t in self.targets}
        self.rates: list[float] = []
        self.history: list[dict] = []
        self.rate_events: list[dict] = []

    def _assemble(self, rows: DataFrame, *keep: str) -> DataFrame:
        vector = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="skip")
        return vector.transform(rows).select("features", *keep)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> BoostedTrees:
        data = materialise(self._assemble(train, *self.targets))
        held_out = None if val is None else materialise(self._assemble(val, *self.targets))
        staged = held_out is not None and self.policy.enabled
        sizes = stage_sizes(self.max_iter) if staged else [self.max_iter]
        state, done = start(self.policy), 0
        for number, trees in enumerate(sizes, 1):
            with ThreadPoolExecutor(self.parallel) as pool:
                grown = list(pool.map(lambda t: self._grow(data, t, trees, state.lr), self.targets))
            for target, model in zip(self.targets, grown):
                self.stages[target].append(model)
            self.rates.append(state.lr)
            done += trees
            if not staged:
                break
            error, used = self._hourly_mae(held_out), state.lr
            state = advance(self.policy, state, error, number)
            self.history.append({"stage": number, "trees_fitted": done, "val_mae": error, "learning_rate": used})
            if state.event:
                self.rate_events.append({"step": number, "old_lr": used, "new_lr": state.lr, "policy": state.event})
        return self

    def _sum_of_stages(self, rows: DataFrame, target: str) -> DataFrame:
        """Add ``_hat_<target>``: the sum of the target's stage predictions."""
        total = F.lit(0.0)
        added = []
        for i, model in enumerate(self.stages[target]):
            name = f"_p{i}_{target}"
            rows = model.setPredictionCol(name).transform(rows)
            total, added = total + F.col(name), [*added, name]
            if i:  # the library gives an ensemble's first tree full weight; in later stages it counts at the stage's rate too
                rows = model.trees[0].setPredictionCol(f"{name}_first").transform(rows)
                total, added = total - F.col(f"{name}_first") * (1.0 - self.rates[i]), [*added, f"{name}_first"]
        return rows.withColumn(f"_hat_{target}", total).drop(*added)

    def _grow(self, data: DataFrame, target: str, trees: int, lr: float) -> GBTRegressionModel:
        left = self._sum_of_stages(data.select("features", target), target).select(
            "features", (F.col(target) - F.col(f"_hat_{target}")).alias("label")
        )
        grower = GBTRegressor(
            featuresCol="features", labelCol="label", maxIter=trees, stepSize=lr, maxDepth=self.max_depth, seed=self.seed
        )
        return grower.fit(left)

    def _hourly_mae(self, rows: DataFrame) -> float:
        hours = [t for t in self.targets if t not in SUMMARY_TARGETS] or list(SUMMARY_TARGETS)
        for t in hours:
            rows = self._sum_of_stages(rows, t)
        error = sum((F.abs(F.col(f"_hat_{t}") - F.col(t)) for t in hours[1:]), F.abs(F.col(f"_hat_{hours[0]}") - F.col(hours[0])))
        return float(rows.agg(F.avg(error) / len(hours)).first()[0] or 0.0)

    def predict(self, rows: DataFrame) -> DataFrame:
        wide = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(rows)
        for t in self.targets:
            wide = self._sum_of_stages(wide, t)
        hat = lambda h: F.col(f"_hat_target_h{h}")
        hours = []
        for h in range(1, HORIZON + 1):
            lower = max((k for k in self.horizons if k <= h), default=None)
            upper = min((k for k in self.horizons if k >= h), default=None)
            if lower is None or upper is None or lower == upper:
                edge = lower if upper is None else upper
                hours.append(F.col("_hat_target_tavg") if edge is None else hat(edge))
            else:
                hours.append(hat(lower) + (hat(upper) - hat(lower)) * ((h - lower) / (upper - lower)))
        summaries = [F.col(f"_hat_{t}") for t in SUMMARY_TARGETS]
        scored = with_prediction(wide, self.name, prediction(F.array(*hours), *summaries))
        return scored.select(*rows.columns, f"pred_{self.name}")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for target, models in self.stages.items():
            for i, model in enumerate(models):
                model.write().overwrite().save(f"{path}/{target}/{i}")
        config = {"horizons": list(self.horizons), "features": self.features, "rates": self.rates}
        spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.active()
        config = json.loads(spark.read.schema("config string").json(f"{path}/config").first()[0])
        model = cls(horizons=tuple(config["horizons"]), features=config["features"])
        for target in model.targets:
            model.stages[target] = [GBTRegressionModel.load(f"{path}/{target}/{i}") for i in range(len(config["rates"]))]
        model.rates = config["rates"]
        return model
