"""Boosting against a plain one on arrays: residuals, splits, rates, missing values, saving."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermogrid.models import boosting
from thermogrid.models.boosting import HistogramBoosting, best_split
from thermogrid.operators.rate_policy import RatePolicy
from thermogrid.schema import SUMMARY_TARGETS

TARGETS = ["target_h1", "target_h24", *SUMMARY_TARGETS]
FIELDS = "a double, b double, c double, " + ", ".join(f"{t} double" for t in TARGETS)


def table(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.randint(0, 9), rng.choice([1.0, 2.0, 5.0]), rng.randint(0, 6)
        y = 3 * (a > 4) + b * (c < 3) + rng.gauss(0, 0.2)
        rows.append((None if rng.random() < 0.1 else float(a), b, float("nan") if rng.random() < 0.05 else float(c),
                     *[None if rng.random() < 0.01 else y * (k + 1) + rng.gauss(0, 0.1) for k in range(len(TARGETS))]))
    return rows, spark.createDataFrame(rows, FIELDS).repartition(5)


def grow(x, r, rows, depth, least):
    """Nested dict: best split by squared error over all distinct values; missing goes right."""
    total, best = r[rows].sum(), None
    for f in range(x.shape[1]):
        for v in sorted({e for e in x[rows, f] if not math.isnan(e)}):
            left = rows[x[rows, f] <= v]
            right = np.setdiff1d(rows, left)
            if depth and min(len(left), len(right)) >= least:
                gain = r[left].sum() ** 2 / len(left) + r[right].sum() ** 2 / len(right)
                if gain > total ** 2 / len(rows) + 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, f, v, left, right)
    if best is None:
        return r[rows].mean()
    _, f, v, left, right = best
    return f, v, grow(x, r, left, depth - 1, least), grow(x, r, right, depth - 1, least)


def value(tree, row):
    while isinstance(tree, tuple):
        f, v, left, right = tree
        tree = left if row[f] <= v else right
    return tree


def plain(train, test, rates, depth, least):
    full = np.array([[np.nan if v is None else v for v in r] for r in train if None not in r[3:]], float)
    x, y = full[:, :3], full[:, 3:]
    rows = np.array([[np.nan if v is None else v for v in r[:3]] for r in test], float)
    out = np.tile(y.mean(axis=0), (len(rows), 1))
    for t in range(y.shape[1]):
        left = y[:, t] - y[:, t].mean()
        for rate in rates:
            tree = grow(x, left, np.arange(len(x)), depth, least)
            left = left - rate * np.array([value(tree, r) for r in x])
            out[:, t] += rate * np.array([value(tree, r) for r in rows])
    return out


def test_stages_of_one_ensemble_match_a_plain_one(spark, tmp_path):
    train, train_df = table(spark, 1, 400)
    test, test_df = table(spark, 2, 150)
    policy = RatePolicy(monitor="val_mae", patience=1, min_delta=1e9, factor=0.5, min_lr=1e-5)
    model = HistogramBoosting(horizons=(1, 24), max_iter=5, stage_trees=2, max_depth=2, max_bins=64, learning_rate=0.4, least_rows=15, policy=policy, features=["a", "b", "c"])
    model.fit(train_df, test_df)
    assert [(h["trees_fitted"], h["learning_rate"]) for h in model.history] == [(2, 0.4), (4, 0.4), (5, 0.2)]
    assert model.rate_events[0]["step"] == 2
    want = plain(train, test, [0.4] * 4 + [0.2], 2, 15)
    keyed = spark.createDataFrame([(i, *r) for i, r in enumerate(test)], "i int, " + FIELDS)
    got = {r["i"]: r for r in model.predict(keyed).select("i", "pred_trees.*").collect()}
    for i in range(len(test)):
        assert [got[i]["yhat"][0], got[i]["yhat"][23], *[got[i][s] for s in ("tmax", "tmin", "tavg")]] == pytest.approx(want[i].tolist(), rel=1e-9)
        assert got[i]["yhat"][11] == pytest.approx(want[i][0] + (want[i][1] - want[i][0]) * 11 / 23)
    # the error of the residual table is that of the forecasts
    known = [(i, r) for i, r in enumerate(test) if None not in r[3:]]
    assert model.history[-1]["val_mae"] == pytest.approx(np.mean([abs(want[i][t] - r[3 + t]) for i, r in known for t in (0, 1)]), rel=1e-9)
    model.save(str(tmp_path / "m"))
    again = HistogramBoosting.load(str(tmp_path / "m"))
    assert {r["i"]: tuple(r["yhat"]) for r in again.predict(keyed).select("i", "pred_trees.yhat").collect()} == {i: tuple(r["yhat"]) for i, r in got.items()}


def test_without_validation_rows_all_trees_count_at_the_first_rate(spark):
    train, df = table(spark, 3, 200)
    model = HistogramBoosting(horizons=(), max_iter=3, max_depth=1, max_bins=64, learning_rate=0.3, least_rows=10, features=["a", "b", "c"]).fit(df)
    assert model.history == [] and [rate for _, rate in model.trees] == [0.3] * 3 and len(model.targets) == 3
    assert df.count() == 200 and model.predict(df.limit(0)).collect() == []


def test_no_split_where_nothing_is_gained_or_too_few_rows_are_left():
    assert best_split(np.array([[[2.0, 2.0, 0.0]], [[4.0, 4.0, 0.0]]]), 1) is None  # equal means
    assert best_split(np.array([[[9.0, 0.0, 0.0]], [[3.0, 30.0, 0.0]]]), 5) is None
    assert best_split(np.array([[[9.0, 0.0, 0.0]], [[3.0, 30.0, 0.0]]]), 3) == (0, 0, 3.0, 0.0)


def test_constant_targets_and_empty_features(spark):
    df = spark.createDataFrame([(float(i % 3), None, 1.0, *[7.0] * len(TARGETS)) for i in range(60)], FIELDS)
    model = HistogramBoosting(horizons=(1, 24), max_iter=2, max_depth=2, features=["a", "b", "c"]).fit(df, df)
    assert model.history[-1]["val_mae"] == 0.0
    assert {round(r[0], 9) for r in model.predict(df).select(F.col("pred_trees.tavg")).collect()} == {7.0}


def test_residual_rows_travel_in_blocks():
    rng = np.random.default_rng(2)
    bins, left = rng.integers(0, 33, (1000, 2)).astype(np.uint8), rng.standard_normal((1000, 3))
    batch = boosting._packed(bins, left)
    assert batch.num_rows < 20
    each = len(batch.column(0)[0].as_py()) // 2
    for first in (0, 3):
        parts = list(boosting._rows(batch.slice(first), 2, 3))
        assert (np.concatenate([p[0] for p in parts]) == bins[first * each:]).all() and (np.concatenate([p[1] for p in parts]) == left[first * each:]).all()
    assert list(boosting._rows(boosting._packed(bins[:0], left[:0]), 2, 3)) == []
    (back,) = boosting._rows(boosting._packed(bins[:, :0], left), 0, 3)
    assert back[0].shape == (1000, 0) and (back[1] == left).all()
