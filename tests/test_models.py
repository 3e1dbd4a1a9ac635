import numpy as np
import pandas as pd
import pytest
from datetime import datetime
from pyspark.sql import functions as F

from conftest import START, SERIES, hours
from thermogrid.models.base import score
from thermogrid.models.baselines import Climatology, Persistence
from thermogrid.models.linear import GradientRidge, Ridge
from thermogrid.models.moments import absolute_errors, cross_products, triangle
from thermogrid.models.restartable import LastStepLinear, RestartableLinear, last_step_rows
from thermogrid.operators import evaluate, features, sliding, split
from thermogrid.models.trees import BoostedTrees, stage_sizes
from thermogrid.operators.rate_policy import RatePolicy
from thermogrid.schema import SUMMARY_TARGETS, SplitDates, feature_names, target_names
from thermogrid.session import materialise

X, Y = feature_names(), target_names()


def wavy(n, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    temp = 12 + 6 * np.sin(2 * np.pi * t / 24) + 3 * np.sin(2 * np.pi * t / 300) + rng.normal(0, 1, n)
    return temp.tolist(), (temp - 2 - rng.uniform(0, 3, n)).tolist()


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for seed, key in enumerate("ab"):
        temp, dew = wavy(800, seed)
        data += [(key, ts, t, d) for ts, t, d in zip(hours(800), temp, dew)]
    series = spark.createDataFrame(data, SERIES)
    split_rows = split.time_split(features.feature_matrix(series), SplitDates("2024-01-25", "2024-01-29"))
    return materialise(split_rows)


def part(rows, name):
    return rows.where(F.col("split") == name)


def test_persistence_repeats_now(rows):
    out = Persistence().predict(rows).select("temp_lag0", "pred_persistence.*").limit(20).collect()
    assert all(r.yhat == [r.temp_lag0] * 24 and r.tmax == r.tmin == r.tavg == r.temp_lag0 for r in out)


def test_climatology_equals_lookup(spark):
    stamps = pd.date_range("2023-06-01", "2025-03-05 23:00", freq="h")
    temp = np.random.default_rng(1).normal(10, 5, len(stamps))
    temp[:50] = np.nan
    table = pd.DataFrame({"series_id": "a", "ts": stamps, "temp": temp})
    table = table[(table.ts.dt.month != 5) & ~((table.ts.dt.month == 2) & (table.ts.dt.day == 29))]
    df = spark.createDataFrame(table).withColumn("temp", F.when(~F.isnan("temp"), F.col("temp"))).withColumn("dew", F.col("temp"))
    model = Climatology().fit(df)
    known = table.groupby([table.ts.dt.dayofyear.rename("d"), table.ts.dt.hour.rename("h")]).temp.mean().dropna().to_dict()
    overall = table.temp.mean()
    asked = ["2024-02-28 12:00", "2024-12-31 05:00", "2023-12-31 05:00", "2024-12-30 23:00", "2024-05-10 00:00", "2026-03-01 00:00"]
    ask = spark.createDataFrame([("a", datetime.fromisoformat(s)) for s in asked], "series_id string, ts timestamp")
    got = {r.ts: r for r in model.predict(ask).select("ts", "pred_climatology.*").collect()}
    for s in asked:
        ahead = pd.date_range(pd.Timestamp(s) + pd.Timedelta(hours=1), periods=24, freq="h")
        want = [known.get((t.dayofyear, t.hour), overall) for t in ahead]
        r = got[datetime.fromisoformat(s)]
        np.testing.assert_allclose(r.yhat, want)
        assert (r.tmax, r.tmin, r.tavg) == pytest.approx((max(want), min(want), sum(want) / 24))


def test_cross_products_and_errors(rows):
    table = rows.toPandas()
    sums, shift = cross_products(rows, ["temp_lag0", "dew_lag0", "target_h1"], "split")
    for name, group in table.groupby("split"):
        z = np.column_stack([np.ones(len(group)), *(group[["temp_lag0", "dew_lag0", "target_h1"]].to_numpy() - shift).T])
        np.testing.assert_allclose(sums[name], z.T @ z, rtol=1e-9)
    w = [np.array([[1.0], [0.5]]), np.array([[0.0], [1.0]])]
    errors = absolute_errors(rows, ["temp_lag0"], ["target_h1"], w, "split")
    val = table[table.split == "val"]
    want = [np.abs(1 + 0.5 * val.temp_lag0 - val.target_h1).mean(), np.abs(val.temp_lag0 - val.target_h1).mean()]
    np.testing.assert_allclose(errors["val"], want)


def test_ridge_equals_closed_form(spark, rows, tmp_path):
    train, test = part(rows, "train"), part(rows, "test")
    model = Ridge(alpha=2.0).fit(train)
    frame, held = train.toPandas(), test.toPandas().sort_values(["series_id", "ts"])
    mean, std = frame[X].mean(), frame[X].std().replace(0, 1.0)
    xs = ((frame[X] - mean) / std).to_numpy()
    got = model.predict(test).select("series_id", "ts", "pred_ridge.*").toPandas().sort_values(["series_id", "ts"])
    for names, pick in ((Y, lambda g: np.array(g.yhat.tolist())), (list(SUMMARY_TARGETS), lambda g: g[["tmax", "tmin", "tavg"]].to_numpy())):
        y = frame[names].to_numpy()
        centre, scale = (y.mean(), y.std()) if names is Y else (y.mean(axis=0), y.std(axis=0))
        ys = (y - centre) / scale
        xc = xs - xs.mean(axis=0)
        w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(len(X)), xc.T @ (ys - ys.mean(axis=0)))
        want = (((held[X] - mean) / std).to_numpy() @ w + ys.mean(axis=0)) * scale + centre
        np.testing.assert_allclose(pick(got), want, rtol=1e-5, atol=1e-5)
    model.save(spark, str(tmp_path / "ridge"))
    again = Ridge().load(spark, str(tmp_path / "ridge"))
    np.testing.assert_array_equal(again.weights, model.weights)


def test_gradient_training_in_blocks_equals_epoch_by_epoch(rows):
    policy = RatePolicy(monitor="val_mae", patience=1, min_delta=0.5, initial_lr=0.05, min_lr=1e-4)
    runs = [GradientRidge(alpha=0.01, policy=policy, max_epochs=7, block=b).fit(part(rows, "train"), part(rows, "val")) for b in (1, 4)]
    assert [h["learning_rate"] for h in runs[0].history] == [h["learning_rate"] for h in runs[1].history]
    np.testing.assert_allclose([h["val_mae"] for h in runs[0].history], [h["val_mae"] for h in runs[1].history])
    np.testing.assert_allclose(runs[0].weights, runs[1].weights)
    assert runs[0].rate_events and runs[0].history[-1]["val_mae"] < runs[0].history[0]["val_mae"]


def trained(rows, path, reset, **kw):
    settings = dict(epochs_per_iter=2, max_iters=2, target_mae=0.01, learning_rate=0.01, steps_per_epoch=5) | kw
    return RestartableLinear(**settings).fit(part(rows, "train"), part(rows, "val"), run_path=path, reset=reset)


def test_restart_grows_and_reset_starts_again(spark, rows, tmp_path):
    path = str(tmp_path / "run")
    first = trained(rows, path, True)
    assert [e[1] for e in first.epochs] == [1, 2, 3, 4] and first.status == "underfit"
    second = trained(rows, path, False)
    assert [e[1] for e in second.epochs] == list(range(1, 9)) and [e[0] for e in second.epochs][-1] == 4
    assert second.epochs[:4] == first.epochs and second.best_val_mae <= first.best_val_mae
    # epoch rows of a block that was never published are ignored
    spark.createDataFrame([(99, 99, 0.0, 0.0, 0.0, 0.0, 0.0)], first.history_table(spark).schema).write.mode("append").parquet(f"{path}/epochs")
    third = trained(rows, path, False, max_iters=1)
    assert len(third.epochs) == 10 and third.epochs[-1][0] == 5
    assert len(trained(rows, path, True, max_iters=1).epochs) == 2


def test_resumed_run_equals_one_long_run(rows, tmp_path):
    path = str(tmp_path / "run")
    trained(rows, path, True)
    halves, whole = trained(rows, path, False), trained(rows, None, True, max_iters=4)
    np.testing.assert_allclose([e[2:] for e in halves.epochs], [e[2:] for e in whole.epochs])
    np.testing.assert_allclose(halves.weights, whole.weights)


def test_large_means_and_small_units_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    x, tiny = rng.normal(0, 1, 400), rng.normal(0, 1, 400)
    y = 3 * x - 2 * tiny
    data = [(1e9 + float(a), float(b) * 1e-12, 7.0, float(c), *[float(c)] * 3) for a, b, c in zip(x, tiny, y)]
    frame = spark.createDataFrame(data, ["far", "tiny", "constant", "y", *SUMMARY_TARGETS])
    weights = Ridge(1e-9, ["far", "tiny", "constant"], ["y"]).fit(frame).weights[1:, 0]
    np.testing.assert_allclose(weights, [3.0, -2e12, 0.0], rtol=1e-5, atol=1e-9)


def test_stop_rules(rows):
    assert trained(rows, None, False, target_mae=100.0).status == "adequate"
    model = RestartableLinear(target_mae=0.0)
    falling = [(1, e, 1.0 / e, 1.0, 0.0, 0.0, 0.1) for e in range(1, 6)]
    assert model._verdict(falling + [(1, 6, 0.1, 1.3, 0.0, 0.0, 0.1)], 1.0) == "overfit"
    assert model._verdict(falling + [(1, 6, 0.1, 1.25, 0.0, 0.0, 0.1)], 1.0) == "continue"
    assert model._verdict(falling[:4] + [(1, 5, 0.1, 9.0, 0.0, 0.0, 0.1)], 1.0) == "continue"


def test_last_step_model_learns_and_stops(series):
    temp, dew = wavy(400)
    shape = sliding.WindowShape(6, 3, 3)
    scaled = split.split_and_standardize(series(temp, dew), ["temp", "dew"], ["temp"])
    flat = {}
    for name in ("train", "val"):
        windows = sliding.sliding_windows(part(scaled, name), shape, ["temp", "dew"], ["temp"], ["temp"])
        flat[name], x, y = last_step_rows(windows, ["temp", "dew"], "temp", shape.label_width)
    assert (x, y) == (["x_temp", "x_dew"], ["y_1", "y_2", "y_3"])
    model = LastStepLinear(x, y, epochs=30, learning_rate=0.01).fit(flat["train"], flat["val"])
    losses = [h["val_loss"] for h in model.history]
    assert losses[-1] < losses[0]
    if len(losses) < 30:
        assert min(losses[-2:]) >= min(losses[:-2])
    assert len(model.predict(flat["val"]).select("pred_last_step.yhat").first()[0]) == 3


def test_trees_learn_save_and_load(rows, tmp_path):
    policy = RatePolicy(monitor="val_mae", patience=1, min_delta=10.0, min_lr=1e-5)
    model = BoostedTrees(horizons=(1, 24), max_iter=10, max_depth=3, policy=policy).fit(part(rows, "train"), part(rows, "val"))
    assert [h["trees_fitted"] for h in model.history] == [5, 10]
    # nothing counts as an improvement: the rate is halved after the second stage
    assert model.rate_events[0]["new_lr"] == pytest.approx(0.05)
    test = part(rows, "test")
    scores = evaluate.evaluate(evaluate.long_predictions(score([model, Persistence()], test), ["trees", "persistence"]))
    got = {r.model: r for r in scores.collect()}
    assert got["trees"].tavg_mae < got["persistence"].tavg_mae
    model.save(str(tmp_path / "trees"))
    again = BoostedTrees.load(str(tmp_path / "trees"))
    pick = lambda m: m.predict(test).orderBy("series_id", "ts").select("pred_trees.yhat").first()[0]
    assert pick(again) == pick(model) and len(pick(model)) == 24


def test_stages_hold_exactly_the_trees_asked_for():
    for trees in (1, 4, 5, 9, 13, 25, 40, 43):
        sizes = stage_sizes(trees)
        assert sum(sizes) == trees and len(sizes) <= 5


def test_rate_counts_for_the_first_tree_of_later_stages(series):
    temp, dew = wavy(500)
    rows = split.time_split(features.feature_matrix(series(temp, dew)), SplitDates("2024-01-12", "2024-01-16"))
    train, val = (rows.where(F.col("split") == s) for s in ("train", "val"))
    mae = {}
    for rate in (0.1, 1.0):
        policy = RatePolicy(initial_lr=rate, patience=99, min_lr=1e-6)
        model = BoostedTrees(horizons=(1,), max_iter=10, max_depth=2, learning_rate=rate, policy=policy, features=["temp_lag1", "temp_lag24"]).fit(train, val)
        assert [h["trees_fitted"] for h in model.history] == [5, 10] and model.rates == [rate, rate]
        mae[rate] = [h["val_mae"] for h in model.history]
    assert mae[0.1][1] != pytest.approx(mae[1.0][1], rel=1e-6)


def test_columns_that_differ_by_a_ten_millionth_are_told_apart(spark):
    rng = np.random.default_rng(3)
    a, c = rng.uniform(0, 50, 4000), rng.uniform(0, 1, 4000)
    b = a + 1e-7 * c
    apart = (b - a) / 1e-7
    y = 2 * a + 3 * apart + 1000
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y, "target_tmax": y, "target_tmin": -y, "target_tavg": y / 2})).repartition(7)
    model = Ridge(0.0, ["a", "b"], ["y"]).fit(df)
    for k, scale in enumerate((1, 1, -1, 0.5)):
        w = model.weights[:, k]
        assert w[1] + w[2] == pytest.approx(2 * scale, rel=1e-6) and w[2] * 1e-7 == pytest.approx(3 * scale, rel=1e-6)


def test_triangle_is_that_of_all_rows_in_whatever_parts(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(5, 2, (300, 4))
    z[:, 3] = 7.0
    for parts, rows in ((1, 300), (9, 300), (4, 2)):
        df = spark.createDataFrame(pd.DataFrame(z[:rows], columns=list("abcd"))).repartition(parts)
        r, shift = triangle(df, list("abcd"))
        block = np.column_stack([np.ones(rows), z[:rows] - shift])
        assert r.shape == (5, 5) and np.allclose(r.T @ r, block.T @ block, atol=1e-9) and np.allclose(shift, z[:rows].mean(axis=0))
    with pytest.raises(ValueError):
        triangle(df.limit(0), list("abcd"))
