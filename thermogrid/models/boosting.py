"""Boosted trees that continue one ensemble: a table of residuals, updated stage by stage, and split histograms added up over tasks.

All targets grow their trees side by side, a level a job. Features are binned once; a row is then its bins and, for each target, what the
ensemble so far leaves over, and the table holds rows in blocks. A task adds up residuals and counts by (target, node, feature, bin); the sums of a node meet in one task, which
chooses the split, so only splits reach the driver. Trees start at the target's mean and count at the rate that the policy
allowed in their stage. After a stage its trees are taken off the residuals in a new table: no tree is ever scored on training rows again, and
the validation error is the mean of a like table's absolute values.

A missing feature goes right at every split, in training and in prediction; rows without a target are left out of training.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rate_policy import RatePolicy, advance, start
from ..schema import HORIZON, SUMMARY_TARGETS, feature_names
from ..session import drop_table, materialise
from .base import prediction, with_prediction
from .trees import stage_sizes

BLOCK_BYTES = 4096
SLICE_ROWS = 1 << 15
ROW = pa.schema([("bins", pa.binary()), ("residuals", pa.binary())])
NODE_SUMS = pa.schema([("target", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])
SPLIT = pa.schema([("target", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("left", pa.float64()), ("right", pa.float64())])
TREE_FIELDS = "tree int, target int, node int, feature int, bin int, edge double, value double, rate double"


@dataclass
class Tree:
    """One tree for each target, nodes in heap order: the feature to look at (-1: a leaf), the last bin that goes left, and the node's mean."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def roots(cls, targets: int, depth: int) -> Tree:
        shape = (targets, (1 << depth + 1) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape))

    def reach(self, bins: np.ndarray, target: int, depth: int) -> np.ndarray:
        """The node that each row of ``bins`` comes to within ``depth`` splits."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            feature = self.feature[target][node]
            inner = feature >= 0
            right = bins[rows, np.maximum(feature, 0)] > self.bin[target][node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def score(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.stack([self.value[t][self.reach(bins, t, depth)] for t in range(len(self.feature))], axis=1)


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column by column the number of the bin: the first edge that is not below the value; missing values come behind all edges."""
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), len(e), np.searchsorted(e, values[:, i], "left"))
    return out


def _matrix(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(first, last)]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def _bytes(column: pa.Array) -> np.ndarray:
    """What the rows of a binary array hold, in one piece."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind, len(column) + 1 + column.offset)[column.offset:]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)


def _rows(batch: pa.RecordBatch, features: int, targets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bins and residuals of a batch of the residual table, some thousands of training rows at a time."""
    left = _bytes(batch.column(1)).view(np.float64).reshape(-1, targets)
    bins = _bytes(batch.column(0)).reshape(len(left), features)
    for first in range(0, len(left), SLICE_ROWS):
        yield bins[first:first + SLICE_ROWS], left[first:first + SLICE_ROWS]


def _packed(bins: np.ndarray, residuals: np.ndarray) -> pa.RecordBatch:
    """Training rows as rows of the residual table, each a block of about ``BLOCK_BYTES``: rows one by one cost more to hand over than to add up."""
    sizes = [m.shape[1] * m.itemsize for m in (bins, residuals)]
    each = max(BLOCK_BYTES // sum(sizes), 1)
    ends = np.minimum(np.arange(-(-len(bins) // each) + 1) * each, len(bins))
    raw = lambda m, size: pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))])
    return pa.RecordBatch.from_arrays([raw(m, size) for m, size in zip((bins, residuals), sizes)], schema=ROW)


def best_split(sums: np.ndarray, least_rows: int) -> tuple[int, int, float, float] | None:
    """Feature and last left bin of the greatest gain, and both sides' means, from ``sums`` (residuals and counts by feature and bin)."""
    total, rows = sums[0, 0].sum(), sums[1, 0].sum()
    left, count = np.cumsum(sums[0], axis=1)[:, :-1], np.cumsum(sums[1], axis=1)[:, :-1]
    right, others = total - left, rows - count
    allowed = (count >= least_rows) & (others >= least_rows)
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, left * left / count + right * right / others, -np.inf)
    feature, at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if gain[feature, at] - total * total / rows <= 1e-12 * max(1.0, abs(gain[feature, at])):
        return None
    return int(feature), int(at), float(left[feature, at] / count[feature, at]), float(right[feature, at] / others[feature, at])


class HistogramBoosting:
    """The job's tree model; ``horizons`` are the hours fitted, hours between them are read off the straight line."""

    name = "trees"

    def __init__(
        self, horizons: tuple[int, ...] = tuple(range(1, HORIZON + 1)), max_iter: int = 40, learning_rate: float = 0.1, max_depth: int = 5,
        max_bins: int = 32, least_rows: int = 20, policy: RatePolicy | None = None, features: list[str] | None = None, stage_trees: int | None = None,
    ):
        if not 2 <= max_bins <= 256:
            raise ValueError("max_bins: 2 to 256")
        self.horizons, self.max_iter, self.max_depth, self.max_bins, self.least_rows = horizons, max_iter, max_depth, max_bins, least_rows
        base = policy or RatePolicy(monitor="val_mae", min_lr=1e-5)
        self.policy = RatePolicy(**{**base.__dict__, "initial_lr": learning_rate})
        self.features = list(features or feature_names())
        self.targets = [f"target_h{h}" for h in horizons] + list(SUMMARY_TARGETS)
        self.stage_trees = stage_trees
        self.edges: list[np.ndarray] = []
        self.means = np.zeros(len(self.targets))
        self.trees: list[tuple[Tree, float]] = []
        self.history: list[dict] = []
        self.rate_events: list[dict] = []

    def _sizes(self, staged: bool) -> list[int]:
        if not staged:
            return [self.max_iter]
        if self.stage_trees is None:
            return stage_sizes(self.max_iter)
        full, rest = divmod(self.max_iter, self.stage_trees)
        return [self.stage_trees] * full + [rest] * bool(rest)

    def _inputs(self, rows: DataFrame) -> DataFrame:
        double = lambda c: F.col(c).cast("double").alias(c)
        return rows.dropna(subset=self.targets).select(*map(double, self.features), *map(double, self.targets))

    def _prepare(self, rows: DataFrame) -> None:
        """Bin edges, which are values of the column, and the targets' means: one pass."""
        shares = [k / self.max_bins for k in range(1, self.max_bins)]
        asked = [F.percentile_approx(c, shares, 10_000) for c in self.features] + [F.avg(c) for c in self.targets]
        found = rows.agg(*[a.alias(f"c{i}") for i, a in enumerate(asked)]).first()
        self.edges = [np.unique(np.array(e or [], float)) for e in found[:len(self.features)]]
        self.means = np.array([m or 0.0 for m in found[len(self.features):]])

    def _residuals(self, rows: DataFrame) -> DataFrame:
        edges, means, p, t = self.edges, self.means, len(self.features), len(self.targets)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield _packed(binned(_matrix(batch, 0, p), edges), _matrix(batch, p, p + t) - means)

        return materialise(rows.mapInArrow(run, "bins binary, residuals binary"))

    def _less(self, table: DataFrame, grown: list[tuple[Tree, float]]) -> DataFrame:
        """The residual table after a stage's trees."""
        p, depth, targets = len(self.features), self.max_depth, len(self.targets)

        def run(batches):
            for bins, left in (part for batch in batches for part in _rows(batch, p, targets)):
                yield _packed(bins, left - sum(rate * tree.score(bins, depth) for tree, rate in grown))

        out = materialise(table.mapInArrow(run, "bins binary, residuals binary"))
        drop_table(table)
        return out

    def _splits(self, table: DataFrame, grown: list[tuple[Tree, float]], tree: Tree, level: int) -> list:
        """The best split of every open node of a level."""
        p, bins_of, targets, depth, least_rows = len(self.features), self.max_bins + 1, len(self.targets), self.max_depth, self.least_rows
        first, width = (1 << level) - 1, 1 << level
        open_ = np.ones((targets, width), bool)
        if level:
            above = (np.arange(first, first + width) - 1) // 2
            open_ = tree.feature[:, above] >= 0

        def add(batches):
            sums = np.zeros((targets, 2, width, p, bins_of))
            for bins, left in (part for batch in batches for part in _rows(batch, p, targets)):
                if grown:
                    left = left - sum(rate * t.score(bins, depth) for t, rate in grown)
                cells = np.ascontiguousarray(bins.T).astype(np.int64)
                whole = [np.bincount(c, minlength=bins_of) for c in cells] if not level else []  # one node: the same counts for all targets
                for t in range(targets):
                    mine, at = np.ascontiguousarray(left[:, t]), cells
                    if level:
                        node = tree.reach(bins, t, level) - first
                        here = np.flatnonzero(node >= 0)
                        if len(here) < len(node):
                            node, mine, at = node[here], mine[here], cells[:, here]
                        node *= bins_of
                    for j in range(p):
                        cell = node + at[j] if level else at[j]
                        sums[t, 0, :, j] += np.bincount(cell, mine, width * bins_of).reshape(width, bins_of)
                        sums[t, 1, :, j] += whole[j] if not level else np.bincount(cell, minlength=width * bins_of).reshape(width, bins_of)
            for t in range(targets):
                by_node = sums[t].reshape(2, width, p * bins_of)
                nodes = [n for n in range(width) if open_[t, n] and by_node[1, n].any()]
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()),
                                                      pa.array([by_node[:, n].tobytes() for n in nodes], pa.binary())], schema=NODE_SUMS)

        def choose(batches):
            key, total = None, None

            def done():
                found = best_split(total.reshape(2, p, bins_of), least_rows)
                mean = total[0, :bins_of].sum() / total[1, :bins_of].sum()
                row = (*key, -1, 0, mean, mean) if found is None else (*key, *found)
                return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SPLIT)], schema=SPLIT)

            for batch in batches:
                for t, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    own = np.frombuffer(raw, float).reshape(2, -1)
                    if (t, n) != key:
                        if key is not None:
                            yield done()
                        key, total = (t, n), own.copy()
                    else:
                        total += own
            if key is not None:
                yield done()

        added = table.mapInArrow(add, "target int, node int, sums binary")
        met = added.repartition("target", "node").sortWithinPartitions("target", "node")
        return met.mapInArrow(choose, "target int, node int, feature int, bin int, left double, right double").collect()

    def _grow(self, table: DataFrame, grown: list[tuple[Tree, float]]) -> Tree:
        tree = Tree.roots(len(self.targets), self.max_depth)
        for level in range(self.max_depth):
            first, some = (1 << level) - 1, False
            for s in self._splits(table, grown, tree, level):
                t, node = s["target"], first + s["node"]
                if s["feature"] < 0:
                    tree.value[t, node] = s["left"]
                    continue
                some = True
                tree.feature[t, node], tree.bin[t, node] = s["feature"], s["bin"]
                tree.value[t, 2 * node + 1], tree.value[t, 2 * node + 2] = s["left"], s["right"]
            if not some:
                break
        return tree

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> HistogramBoosting:
        rows = self._inputs(train)
        self._prepare(rows)
        left = self._residuals(rows)
        staged = val is not None and self.policy.enabled
        held_out = self._residuals(self._inputs(val)) if staged else None
        state = start(self.policy)
        for number, trees in enumerate(self._sizes(staged), 1):
            grown: list[tuple[Tree, float]] = []
            for _ in range(trees):
                grown.append((self._grow(left, grown), state.lr))
            self.trees += grown
            if not staged:
                break
            left, held_out = self._less(left, grown), self._less(held_out, grown)
            error, used = self._error(held_out), state.lr
            state = advance(self.policy, state, error, number)
            self.history.append({"stage": number, "trees_fitted": len(self.trees), "val_mae": error, "learning_rate": used})
            if state.event:
                self.rate_events.append({"step": number, "old_lr": used, "new_lr": state.lr, "policy": state.event})
        drop_table(left)
        if staged:
            drop_table(held_out)
        return self

    def _error(self, table: DataFrame) -> float:
        """Mean absolute residual over the fitted hours, or over the daily values if no hour is fitted."""
        p, targets, hours = len(self.features), len(self.targets), len(self.horizons) or len(self.targets)

        def run(batches):
            for _, left in (part for batch in batches for part in _rows(batch, p, targets)):
                part = np.abs(left[:, :hours])
                yield pa.RecordBatch.from_arrays([pa.array([float(part.sum())]), pa.array([part.size], pa.int64())], names=["total", "n"])

        found = table.mapInArrow(run, "total double, n bigint").agg((F.sum("total") / F.sum("n")).alias("mae")).first()
        return float(found["mae"] or 0.0)

    def predict(self, rows: DataFrame) -> DataFrame:
        edges, means, trees, depth = self.edges, self.means, self.trees, self.max_depth

        @F.pandas_udf("array<double>")
        def ensemble(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=object)
            table = np.array([[np.nan if v is None else v for v in row] for row in values], float).reshape(len(values), len(edges))
            bins = binned(table, edges)
            total = means + sum((rate * tree.score(bins, depth) for tree, rate in trees), np.zeros((len(bins), len(means))))
            return pd.Series(list(total))

        hat = dict(zip(self.targets, (F.col("_ensemble")[i] for i in range(len(self.targets)))))
        hours = []
        for h in range(1, HORIZON + 1):
            lower, upper = max((k for k in self.horizons if k <= h), default=None), min((k for k in self.horizons if k >= h), default=None)
            at = lambda k: hat[f"target_h{k}"]
            if lower is None or upper is None or lower == upper:
                edge = lower if upper is None else upper
                hours.append(hat["target_tavg"] if edge is None else at(edge))
            else:
                hours.append(at(lower) + (at(upper) - at(lower)) * ((h - lower) / (upper - lower)))
        wide = rows.withColumn("_ensemble", ensemble(F.array(*[F.col(c).cast("double") for c in self.features])))
        return with_prediction(wide, self.name, prediction(F.array(*hours), *[hat[t] for t in SUMMARY_TARGETS])).drop("_ensemble")

    def tree_table(self, spark: SparkSession) -> DataFrame:
        """Every node of every tree as a row."""
        out = []
        for k, (tree, rate) in enumerate(self.trees):
            for t in range(len(self.targets)):
                nodes = [0]
                for n in nodes:
                    f = int(tree.feature[t, n])
                    if f >= 0:
                        nodes += [2 * n + 1, 2 * n + 2]
                    out.append((k, t, n, f, int(tree.bin[t, n]), float(self.edges[f][tree.bin[t, n]]) if f >= 0 else None, float(tree.value[t, n]), rate))
        return spark.createDataFrame(out, TREE_FIELDS)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.tree_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        config = {"horizons": list(self.horizons), "features": self.features, "max_depth": self.max_depth, "max_bins": self.max_bins,
                  "edges": [e.tolist() for e in self.edges], "means": self.means.tolist()}
        spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")

    @classmethod
    def load(cls, path: str) -> HistogramBoosting:
        spark = SparkSession.active()
        config = json.loads(spark.read.schema("config string").json(f"{path}/config").first()[0])
        model = cls(horizons=tuple(config["horizons"]), features=config["features"], max_depth=config["max_depth"], max_bins=config["max_bins"])
        model.edges, model.means = [np.array(e, float) for e in config["edges"]], np.array(config["means"])
        grown: dict[int, tuple[Tree, float]] = {}
        for r in spark.read.parquet(f"{path}/trees").collect():  # a model: bounded by its trees and depth
            tree, _ = grown.setdefault(r["tree"], (Tree.roots(len(model.targets), model.max_depth), r["rate"]))
            tree.feature[r["target"], r["node"]], tree.bin[r["target"], r["node"]], tree.value[r["target"], r["node"]] = r["feature"], r["bin"], r["value"]
        model.trees = [grown[k] for k in sorted(grown)]
        return model


# Workers get this module's code with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
