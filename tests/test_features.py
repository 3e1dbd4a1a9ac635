import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from conftest import SERIES, column, hours
from thermogrid.operators import features, sliding, split
from thermogrid.operators.chunks import with_halo
from thermogrid.schema import LAGS, ROLLING_WIDTHS, SplitDates, feature_names, target_names

N = None


def sine(n, drop=4.0):
    temp = (15 + 5 * np.sin(np.linspace(0, 10 * np.pi, n))).tolist()
    return temp, [t - drop for t in temp]


def test_complete_rows_of_short_series(series):
    for n, rows in ((300, 108), (200, 8)):
        assert features.feature_matrix(series(*sine(n))).count() == rows


def test_column_set():
    assert len(feature_names()) == 73 and len(target_names()) == 24


def by_hand(temp, dew, i):
    """The features and targets of hour ``i``, from slices of the raw lists."""
    at = lambda values, k: values[k] if 0 <= k < len(values) else None
    present = lambda values, width: [v for v in values[max(0, i - width):i] if v is not None]
    spread = [None if t is None or d is None else t - d for t, d in zip(temp, dew)]
    out = {f"{name}_lag{k}": at(values, i - k) for name, values in (("temp", temp), ("dew", dew), ("dew_depression", spread)) for k in LAGS}
    for width in ROLLING_WIDTHS:
        t, d = present(temp, width), present(dew, width)
        enough = len(t) >= max(1, width // 2)
        mean = sum(t) / len(t) if enough else None
        out[f"temp_roll_mean_{width}h"] = mean
        out[f"temp_roll_min_{width}h"], out[f"temp_roll_max_{width}h"] = (min(t), max(t)) if enough else (None, None)
        out[f"temp_roll_range_{width}h"] = max(t) - min(t) if enough else None
        out[f"temp_roll_std_{width}h"] = math.sqrt(sum((v - mean) ** 2 for v in t) / (len(t) - 1)) if enough and len(t) > 1 else None
        out[f"dew_roll_mean_{width}h"] = sum(d) / len(d) if len(d) >= max(1, width // 2) else None
    return out | {f"target_h{h}": at(temp, i + h) for h in range(1, 25)}


@pytest.mark.parametrize("chunk_hours", [168, 200, 2048])
def test_features_equal_pandas_with_gaps(spark, chunk_hours):
    rng, rows, want = random.Random(3), [], []
    for key in ("a", "b"):
        temp = [rng.uniform(-5, 30) if rng.random() < 0.85 else N for _ in range(700)]
        temp[300:420] = [N] * 120
        temp[500:560] = [7.0] * 60
        dew = [None if rng.random() < 0.2 else rng.uniform(-9, 5) for _ in temp]
        rows += [(key, ts, t, d) for ts, t, d in zip(hours(700), temp, dew)]
        want.append(pd.DataFrame([by_hand(temp, dew, i) for i in range(700)], dtype=float))
    got = features.feature_matrix(spark.createDataFrame(rows, SERIES), chunk_hours=chunk_hours, complete_only=False)
    got = got.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    want = pd.concat(want).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, rtol=1e-9, atol=1e-6)


def test_constant_stretch_has_zero_deviation(series):
    out = features.rolling_features(series([21.37] * 400), chunk_hours=200).where("temp_roll_std_168h is not null")
    assert {r[0] for r in out.select("temp_roll_std_168h").collect()} == {0.0}


def test_partial_calls_agree_with_matrix(series):
    df = series(*sine(400))
    matrix = features.feature_matrix(df, chunk_hours=200, complete_only=False).toPandas().sort_values("ts")
    for part in (features.lag_features(df, chunk_hours=200), features.lead_targets(df, chunk_hours=200),
                 features.rolling_features(df, chunk_hours=200), features.calendar_features(df)):
        table = part.toPandas().sort_values("ts")
        pd.testing.assert_frame_equal(
            table.reset_index(drop=True), matrix[table.columns].reset_index(drop=True), rtol=1e-9, atol=1e-9)


def test_odd_widths_use_direct_frames(series):
    temp = [float(i % 7) for i in range(60)]
    out = features.rolling_features(series(temp), widths=(5, 7), chunk_hours=48).toPandas().sort_values("ts")
    past = pd.Series(temp).shift(1)
    np.testing.assert_allclose(out.temp_roll_mean_7h, past.rolling(7, min_periods=3).mean())
    np.testing.assert_allclose(out.temp_roll_std_5h, past.rolling(5, min_periods=2).std())


@pytest.mark.parametrize("widths", [(1, 97), (3, 200), (150,), (2, 100, 101, 190)])
def test_wide_windows_are_put_together_whatever_the_widths(series, widths):
    rng = np.random.default_rng(len(widths))
    temp = [None if rng.random() < 0.2 else float(v) for v in rng.normal(10, 5, 420)]
    df = features.rolling_features(series(temp), widths=widths, chunk_hours=210)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    frames = {int(w) for w in re.findall(r"RowFrame, -(\d+), -1\)", plan) if int(w) > 1}
    assert all(w <= features.READ_WIDTH for w in frames)
    out, past = df.toPandas().sort_values("ts"), pd.Series(temp, dtype=float).shift(1)
    for w in widths:
        rolled = past.rolling(w, min_periods=max(1, w // 2))
        np.testing.assert_allclose(out[f"temp_roll_mean_{w}h"], rolled.mean())
        np.testing.assert_allclose(out[f"temp_roll_max_{w}h"], rolled.max())
        if w > 1:
            np.testing.assert_allclose(out[f"temp_roll_std_{w}h"], past.rolling(w, min_periods=max(2, w // 2)).std(), atol=1e-9)


def test_halo_must_fit_in_a_chunk(series):
    with pytest.raises(ValueError):
        with_halo(series([1.0]), 168, 24, 100)


def test_target_summary_ignores_missing(series):
    targets = features.lead_targets(series([1.0, 2.0, N, 6.0]))
    out = features.summarise_targets(targets).orderBy("ts").collect()
    assert [(r.target_tmax, r.target_tmin, r.target_tavg) for r in out[:1]] == [(6.0, 2.0, 4.0)]
    assert out[3].target_tmax is None and out[3].target_tavg is None


def test_time_split_boundaries(spark, series):
    df = split.time_split(series([1.0] * 5), SplitDates("2024-01-01 02:00:00", "2024-01-01 04:00:00"))
    assert column(df, "split") == ["train", "train", "val", "val", "test"]
    summary = {r.split: r.rows for r in split.split_summary(df).collect()}
    assert summary == {"train": 2, "val": 2, "test": 1}


def test_positional_split_and_scaling(series):
    values = [float(v) for v in range(13)]
    df = series(values, [3.0] * 13)
    parts = split.positional_split(df, ["temp"])
    assert column(parts, "split") == ["train"] * 9 + ["val"] * 2 + ["test"] * 2
    scaled = split.split_and_standardize(df, ["temp", "dew"], ["temp"])
    train = np.array(values[:9])
    np.testing.assert_allclose(column(scaled, "temp"), (np.array(values) - train.mean()) / train.std(ddof=1))
    assert column(scaled, "dew") == [0.0] * 13
    scaler = split.fit_scaler(df, ["temp"])
    back = split.invert_scaling(split.standardize(df, scaler, ["temp"]), scaler, ["temp"])
    np.testing.assert_allclose(column(back, "temp"), values)


def test_target_scaler_pools_all_hours(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 7.0)], "a double, b double")
    row = split.fit_target_scaler(df, ["a", "b"]).first()
    assert row.y_mean == 4.0 and row.y_std == pytest.approx(math.sqrt(5.0))


@pytest.mark.parametrize("chunk_rows", [7, 4096])
def test_sliding_windows_follow_position(series, chunk_rows):
    values = [float(v) for v in range(20)]
    df = series(values, [N] * 20, skip=(4, 5))
    kept = [v for v in values if v not in (4.0, 5.0)]
    shape = sliding.WindowShape(input_width=3, label_width=2, shift=4)
    out = sliding.sliding_windows(df, shape, ["temp", "dew"], ["temp"], ["temp"], chunk_rows).orderBy("start_pos").collect()
    assert len(out) == len(kept) - shape.total + 1
    for i, row in enumerate(out):
        assert [r.temp for r in row.inputs] == kept[i:i + 3] and [r.dew for r in row.inputs] == [N] * 3
        assert [r.temp for r in row.labels] == kept[i + 5:i + 7]
