import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SERIES, START, column, hours
from thermogrid.operators import clean, grid
from thermogrid.operators.chunks import with_position
from thermogrid.schema import Bounds

N = None


def test_hourly_mean_skips_missing_and_merges_sources(spark):
    rows = [
        ("a", START, 1.0, N), ("a", START + timedelta(minutes=59), 3.0, 2.0), ("a", START + timedelta(hours=1), N, N),
    ]
    means = grid.bucket_mean(spark.createDataFrame(rows, SERIES))
    assert column(means, "temp") == [2.0, N] and column(means, "dew") == [2.0, N]
    other = spark.createDataFrame([("a", START, 8.0, 4.0)], SERIES)
    merged = grid.merge_sources([means, other])
    assert column(merged, "temp") == [5.0, N] and column(merged, "dew") == [3.0, N]
    with pytest.raises(ValueError):
        grid.merge_sources([])


def test_grid_has_no_holes_and_keeps_spans_apart(spark, series):
    long_gap = series([1.0, 2.0], key="b", first=START).unionByName(series([9.0], key="b", first=START + timedelta(hours=900)))
    both = series([5.0], key="a").unionByName(long_gap)
    out = grid.reindex_hourly(both, chunk_hours=48).toPandas()
    assert len(out[out.series_id == "a"]) == 1
    b = out[out.series_id == "b"].sort_values("ts")
    assert len(b) == 901 and b.temp.notna().sum() == 3
    assert (b.ts.diff().dropna() == pd.Timedelta(hours=1)).all()


def test_rows_off_the_grid_vanish(spark):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("a", at(30), 1.0, 1.0), ("a", at(90), 2.0, 2.0), ("a", at(100), 7.0, 7.0), ("a", at(210), 4.0, 4.0)]
    out = grid.reindex_hourly(spark.createDataFrame(rows, SERIES), chunk_hours=2)
    assert column(out, "ts") == [at(30), at(90), at(150), at(210)]
    assert column(out, "temp") == [1.0, 2.0, N, 4.0]


@pytest.mark.parametrize("chunk_hours", [3, 2048])
def test_gap_rules(series, chunk_hours):
    # leading gap, gap of nine, trailing gap of eight, all with limit six
    values = [N, N, 10.0] + [N] * 9 + [30.0] + [N] * 8
    # the dew column keeps the first and last hour on the grid
    dew = [0.0] * len(values)
    out = grid.reindex_and_fill(series(values, dew), 6, chunk_hours=chunk_hours)
    expected = [N, N, 10.0] + [10.0 + 2 * i for i in range(1, 7)] + [N] * 3 + [30.0] * 7 + [N] * 2
    assert column(out, "temp") == [e if e is N else pytest.approx(e) for e in expected]
    again = column(grid.reindex_and_fill(out, 6, chunk_hours=chunk_hours), "temp")
    assert again == [N, N] + [pytest.approx(10 + 2 * i) for i in range(10)] + [pytest.approx(30.0)] * 9


@pytest.mark.parametrize("limit, chunk_hours", [(6, 17), (3, 100), (24, 5)])
def test_filling_equals_pandas_on_random_gaps(spark, limit, chunk_hours):
    rng, rows, frames = random.Random(limit), [], []
    for key in ("a", "b", "c"):
        temp, dew = [], []
        while len(temp) < 400:
            keep, drop = rng.randint(1, 6), rng.randint(0, 60 if rng.random() < 0.1 else 8)
            temp += [rng.uniform(-10, 30) for _ in range(keep)] + [N] * drop
            dew += [rng.uniform(-10, 10) if rng.random() < 0.8 else N for _ in range(keep + drop)]
        stamps = hours(400)
        rows += [(key, ts, t, d) for ts, t, d in zip(stamps, temp, dew)]
        frame = pd.DataFrame({"temp": temp[:400], "dew": dew[:400]}, index=pd.DatetimeIndex(stamps), dtype=float)
        frames.append(frame.interpolate(method="time", limit=limit).assign(key=key))
    got = grid.reindex_and_fill(spark.createDataFrame(rows, SERIES), limit, chunk_hours=chunk_hours).toPandas()
    got = got.sort_values(["series_id", "ts"]).reset_index(drop=True)
    want = pd.concat(frames).reset_index(drop=True)
    pd.testing.assert_series_equal(got.temp, want.temp, check_names=False, rtol=1e-9)
    pd.testing.assert_series_equal(got.dew, want.dew, check_names=False, rtol=1e-9)


def test_cleaning_order_and_audit(spark):
    b = Bounds()
    rows = [
        ("a", START, 10.0, 12.0), ("a", START + timedelta(hours=1), 50.0, 5.0), ("a", START + timedelta(hours=2), 14.0, 30.0),
        ("a", START + timedelta(hours=3), N, N), ("a", None, 3.0, 1.0),
    ]
    df = spark.createDataFrame(rows, SERIES)
    out = clean.clean_source(df, b)
    # the last hour has no reading and is not on the grid
    assert column(out, "temp") == [10.0, 12.0, 14.0]
    assert column(out, "dew") == [10.0, 5.0, 5.0]
    audit = clean.cleaning_audit(df, b).first()
    assert (audit["rows"], audit["temp_out_of_range"], audit["dew_out_of_range"], audit["dew_above_temp"]) == (5, 1, 1, 1)
    assert out.where(F.col("dew") > F.col("temp")).count() == 0


def test_nothing_usable_gives_empty_series(spark):
    df = spark.createDataFrame([("a", START, 99.0, 99.0)], SERIES)
    assert clean.clean_source(df).count() == 0


def test_daily_means_keep_empty_days(spark):
    rows = [("a", datetime(2024, 1, 1, 5), 1.0, N), ("a", datetime(2024, 1, 1, 6), 3.0, N), ("a", datetime(2024, 1, 4), 7.0, 1.0)]
    out = grid.daily_means(spark.createDataFrame(rows, SERIES))
    assert column(out, "temp") == [2.0, N, N, 7.0]


@pytest.mark.parametrize("unit", [1, 60, 3600])
def test_position_equals_row_number_with_a_hot_hour(spark, unit):
    rng = random.Random(1)
    rows = [("hot", START + timedelta(minutes=rng.randint(0, 40)), i) for i in range(300)]
    rows += [(k, START + timedelta(minutes=rng.randint(0, 5000)), i) for i, k in enumerate("ab" * 100)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, id int")
    got = with_position(df, ["id"], unit, "pos", "n").toPandas()
    want = got.sort_values(["series_id", "ts", "id"])
    assert (want.groupby("series_id").cumcount() == want.pos).all()
    assert (want.groupby("series_id").id.transform("size") == want.n).all()


@pytest.mark.parametrize("bound", [50, 7])
def test_position_where_a_third_of_all_rows_lies_at_one_instant(spark, bound):
    rng = random.Random(2)
    rows = [("hot", START, i % 40, i) for i in range(400)]  # ties in the tie-break too
    rows += [("hot", START + timedelta(seconds=rng.randint(-50, 50)), i, i) for i in range(200)]
    rows += [(k, START + timedelta(minutes=rng.randint(0, 90)), i, i) for i, k in enumerate("abc" * 150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, id int, own int").repartition(6)
    placed = with_position(df, ["id"], 60, "pos", "n", unit_rows=bound)
    got = placed.toPandas()
    assert sorted(got.columns) == sorted([*df.columns, "pos", "n"]) and len(got) == len(rows) and sorted(got.own) == sorted(r[3] for r in rows)
    want = got.sort_values(["series_id", "pos"])
    assert (want.groupby("series_id").cumcount() == want.pos).all()
    ordered = want[["series_id", "ts", "id"]].apply(tuple, axis=1).tolist()
    assert ordered == sorted(ordered)
    assert (want.groupby("series_id").id.transform("size") == want.n).all()


def test_cut_units_spread_one_instant_over_tasks(spark):
    from thermogrid.operators.chunks import _cut_units

    df = spark.range(40_000).selectExpr("'a' as series_id", "timestamp'2024-01-01' as ts", "cast(0 as bigint) as _unit", "id % 3 as id").repartition(8)
    cut = _cut_units(df, ["id"])
    assert sorted(r["_nth"] for r in cut.select("_nth").collect()) == list(range(40_000))
    sizes = [r["n"] for r in cut.groupBy(F.floor(F.col("_nth") / 10_000).alias("quarter")).agg(F.count("*").alias("n")).collect()]
    assert sizes == [10_000] * 4
    parts = [f for f in cut.inputFiles() if f.endswith(".parquet")]
    assert len(parts) >= 4  # the sampled ranges cut the instant


def test_rows_are_exchanged_once_without_a_join(series):
    out = grid.reindex_and_fill(grid.bucket_mean(series([float(i) for i in range(60)], skip=range(10, 20))), chunk_hours=24)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Join" not in plan and "ReusedExchange" in plan and plan.count("REPARTITION_BY_COL") == 1
