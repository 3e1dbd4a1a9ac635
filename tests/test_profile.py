import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.queries import REGISTRY
from conftest import column
from thermogrid import session
from thermogrid.operators import features, hist2d, profile, quantiles, split
from thermogrid.schema import Bounds, SplitDates

N = None


def long(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "variable string, value double")


def groups():
    rng = random.Random(5)
    return {
        "uniform": [rng.uniform(0, 100) for _ in range(999)],
        "ties": [float(rng.randint(0, 3)) for _ in range(500)],
        "hot": [7.0] * 900 + [rng.gauss(0, 1) for _ in range(100)],
        "one": [4.25], "two": [1.0, 2.0], "heavy_tail": [rng.paretovariate(0.5) for _ in range(700)],
        "signs": [-3.0, -0.0, 0.0, 5.0, -8.0],
    }


@pytest.mark.parametrize("parts,direct", [(2, 0), (8, 0), (64, 0), (64, 1 << 24)])
def test_quantiles_are_exact(spark, parts, direct):
    data = groups()
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75, "low": 0.0, "high": 1.0, "p99": 0.99}
    out = quantiles.exact_quantiles(long(spark, data | {"none": [N]}), ["variable"], "value", shares, parts, direct=direct).collect()
    assert {r.variable for r in out} == set(data)
    for r in out:
        for name, p in shares.items():
            assert r[name] == pytest.approx(np.percentile(data[r.variable], p * 100), rel=1e-12, abs=1e-12), (r.variable, name)


def test_quantiles_without_groups(spark):
    values = [3.0, 1.0, 2.0, N]
    for direct in (0, 100):
        row = quantiles.exact_quantiles(long(spark, {"x": values}), [], "value", {"median": 0.5}, direct=direct).first()
        assert (row.n, row["median"]) == (3, 2.0)


def test_column_stats_equal_numpy(spark):
    data = groups()
    out = {r.variable: r for r in profile.column_stats(long(spark, data | {"none": [N, N]})).collect()}
    for name, values in data.items():
        r, a = out[name], np.array(values)
        q25, q75 = np.percentile(a, [25, 75])
        outside = ((a < q25 - 1.5 * (q75 - q25)) | (a > q75 + 1.5 * (q75 - q25))).sum()
        assert r["count"] == len(a) and r.nan_count == 0 and r.outlier_count == outside
        assert (r["mean"], r["min"], r["max"]) == pytest.approx((a.mean(), a.min(), a.max()))
        assert r["std"] == (N if len(a) == 1 else pytest.approx(a.std(ddof=1)))
        assert r.outlier_pct == pytest.approx(100 * outside / len(a))
    empty = out["none"]
    assert (empty["count"], empty["mean"], empty["std"], empty.nan_count, empty.nan_pct, empty.outlier_count) == (0, 0, 0, 2, 100, 0)


def test_no_part_over_the_bound(spark):
    n, bound = 1_000_000, 2_000
    rows = spark.range(n).select(F.lit("x").alias("variable"), ((F.col("id") * 7919) % n).cast("double").alias("value"))
    rows = rows.unionByName(spark.range(n // 2).select(F.lit("y").alias("variable"), F.lit(3.0).alias("value")))
    shares = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    heads = session.materialise(rows.groupBy("variable").agg(F.count("value").alias("n"), quantiles.cut_points("value").alias("_cuts")))
    live, cells = quantiles.sorted_cells(rows, heads, ["variable"], "value", shares, 64, bound, 0)
    sizes = [r["count"] for r in live.groupBy("variable", "_cell").count().collect()]
    assert max(sizes) <= bound and cells.count() == len(sizes)
    got = {r.variable: tuple(r)[1:] for r in quantiles.quantiles_of_groups(rows, heads, ["variable"], "value", shares, bound=bound).collect()}
    assert got == {"x": (n, *np.quantile(np.arange(n), [0.25, 0.5, 0.75])), "y": (n // 2, 3.0, 3.0, 3.0)}


def test_box_plot(spark):
    row = profile.box_plot(long(spark, {"x": [1.0, 2.0, 3.0, 4.0, 100.0]})).first()
    assert (row.whisker_low, row.q25, row["median"], row.q75, row.whisker_high, row.outlier_count) == (1, 2, 3, 4, 4, 1)


def test_histogram_edges(spark):
    values = [0.0, 0.1, 5.0, 9.99, 10.0, N]
    out = profile.histogram(long(spark, {"x": values}), bins=10).orderBy("bin").collect()
    want, edges = np.histogram(values[:-1], bins=10)
    assert [r["count"] for r in out] == want.tolist()
    assert [r.center for r in out] == pytest.approx(((edges[1:] + edges[:-1]) / 2).tolist())
    assert sum(r.density for r in out) == pytest.approx(1.0)


def test_histogram_agrees_with_numpy_on_edge_values(spark):
    data = {f"k{k}": [round(i * 0.1, 1) for i in range(k)] for k in (7, 31, 61, 100)}
    data["lines"] = [float(1 + i % 7) for i in range(70)]
    got = {}
    for r in profile.histogram(long(spark, data)).collect():
        got.setdefault(r.variable, {})[r.bin] = r["count"]
    for name, values in data.items():
        assert [got[name][b] for b in range(30)] == np.histogram(values, bins=30)[0].tolist(), name


def test_histogram_of_constant_and_empty(spark):
    out = profile.histogram(long(spark, {"x": [3.0, 3.0], "none": [N]}), bins=4).orderBy("bin").collect()
    want, _ = np.histogram([3.0, 3.0], bins=4)
    assert {r.variable for r in out} == {"x"} and [r["count"] for r in out] == want.tolist()


def test_histograms_share_a_range(spark):
    rows = [("p", "x", 0.0), ("p", "x", 1.0), ("q", "x", 9.0), ("q", "x", 10.0)]
    df = spark.createDataFrame(rows, "split string, variable string, value double")
    out = profile.histogram(df, ["split", "variable"], 10, ["variable"]).orderBy("split", "bin").collect()
    assert [r["count"] for r in out] == [1, 1] + [0] * 8 + [0] * 9 + [2]


def test_bad_values(spark):
    df = spark.createDataFrame([(10.0, 12.0), (60.0, 0.0), (50.0, -41.0), (N, 1.0)], "temp double, dew double")
    row = profile.bad_values(df).first()
    assert (row.total_records, row.nan_rows, row.nan_row_pct) == (4, 1, 25.0)
    assert (row.bad_temp_count, row.bad_dew_count, row.dew_above_temp_count) == (1, 1, 1)
    assert profile.bad_values(df.limit(0)).first().nan_row_pct == 0.0


def test_split_report_is_nested_and_skips_empty_splits(series):
    temp = (15 + 5 * np.sin(np.linspace(0, 10 * np.pi, 400))).tolist()
    rows = split.time_split(features.feature_matrix(series(temp)), SplitDates("2024-01-13", "2030-01-01"))
    report = {r.split: r for r in profile.split_report(profile.split_profile(rows)).collect()}
    assert set(report) == {"train", "val"}
    train = report["train"]
    assert set(train.statistics) == {"temp", "dew", "dew_depression", "temp_roll_mean_24h"}
    assert train.statistics["temp"]["count"] == train.records_count
    assert train.bad_values.bad_temp_count == 0 and train.start_date == "2024-01-08 00:00"
    assert sum(train.histograms["temp"].counts) == train.records_count and len(train.histograms["dew"].bin_centers) == 30
    # equal bin edges over the splits
    assert train.histograms["temp"].bin_centers == report["val"].histograms["temp"].bin_centers


def test_documentation_and_missing(spark):
    rows = [(1, "x", datetime(2024, 1, 5), 2.5, N), (2, N, datetime(2024, 1, 1), N, N)]
    rows += [(i, f"n{i}", datetime(2024, 1, 2), 1.0, N) for i in range(3, 14)]
    df = spark.createDataFrame(rows, "k int, name string, day timestamp, v double, empty string")
    docs = {r.variable: r for r in profile.document_columns(df).collect()}
    assert (docs["k"].low, docs["k"].high) == ("1.0", "13.0") and (docs["day"].low, docs["day"].high) == ("2024-01-01", "2024-01-05")
    assert (docs["name"].distinct, docs["name"].listed) == (12, N) and docs["empty"].distinct == 0
    small = profile.document_columns(df.where("k <= 3").select("name")).first()
    assert (small.distinct, small.listed) == (2, "n3, x")
    missing = profile.missing_share(df).collect()
    assert [(r.variable, round(r.missing_pct, 3)) for r in missing] == [("empty", 100.0), ("name", 7.692), ("v", 7.692)]
    assert {r.variable for r in profile.document_columns(df.limit(0)).collect()} == set(df.columns)


def test_tables_are_described_together(spark):
    """Long values are listed whole, the rest of their list beside them; tables may share column names and have no rows."""
    tail = "x" * 70
    some = spark.createDataFrame([(1, f"b{tail}", "k"), (2, f"a{tail}", N), (3, "c", "j"), (4, "c", "k")], "k int, name string, tag string")
    many = spark.createDataFrame([(f"{i}{tail}",) for i in range(12)], "name string")
    found = profile.document_tables({"some": some, "many": many, "none": some.limit(0), "numbers": some.select("k")}).collect()
    docs = {(r.source, r.variable): (r.kind, r.low, r.high, r.distinct, r.listed) for r in found}
    text = lambda distinct, listed: ("text", N, N, distinct, listed)
    assert len(found) == 8 and docs == {
        ("some", "k"): ("numeric", "1.0", "4.0", N, N), ("some", "name"): text(3, f"a{tail}, b{tail}, c"), ("some", "tag"): text(2, "j, k"),
        ("many", "name"): text(12, N), ("none", "k"): ("numeric", N, N, N, N), ("none", "name"): text(0, N), ("none", "tag"): text(0, N),
        ("numbers", "k"): ("numeric", "1.0", "4.0", N, N),
    }


def test_descriptions_have_no_join_for_each_table(spark):
    """The joins of all tables would lie in one task, each with its own buffers."""
    plan = REGISTRY["column_docs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_sanity(spark):
    rows = [(date(2024, 1, d), hi, lo, m) for d, hi, lo, m in ((1, 5.0, 9.0, 7.0), (2, 50.0, -30.0, 60.0), (3, 5.0, 1.0, N))]
    df = spark.createDataFrame(rows, "DATE date, TMAX double, TMIN double, TAVG double")
    row = profile.daily_sanity(df).first()
    assert tuple(row) == (1, 2, 1, 1)
    assert [r.DATE.day for r in profile.sanity_examples(df, ["DATE"]).collect()] == [1]


def test_two_dimensional_histogram(spark):
    rows = [
        (datetime(2023, 1, 1, 0), 0.2, 0.0), (datetime(2024, 1, 1, 0), 0.2, 0.0), (datetime(2024, 2, 29, 5), 99.0, 99.0),
        (datetime(2024, 12, 31, 23), 9.7, 4.0), (datetime(2024, 1, 1, 1), 0.2, 0.0), (datetime(2024, 1, 1, 1), N, 3.0),
    ]
    df = spark.createDataFrame(rows, "ts timestamp, t double, d double")
    cells = hist2d.hourly_cells(df, "ts", "t", "d")
    assert {tuple(r) for r in cells.collect()} == {(0, 1, 0, 2), (1, 1, 0, 1), (8759, 48, 49, 1)}
    assert tuple(hist2d.axis_bounds(hist2d.usable_pairs(df, "ts", "t", "d")).first()) == (0.0, 10.0, 0.0, 4.0)
    assert {(r.hour, r.total) for r in hist2d.cumulative_cells(cells).where("x = 1").collect()} == {(0, 2), (1, 3)}
    assert {(r.x, r.total, r.norm) for r in hist2d.cells_up_to(cells, 1).collect()} == {(1, 3, 1.0)}
    assert {(r.hour, r.norm) for r in hist2d.normalised_cells(cells).collect()} == {(0, 1.0), (1, 0.5), (8759, 0.5)}
    frames = hist2d.frames(cells)
    assert frames.count() == 8760
    assert column(frames.where("hour in (0, 2, 8759)"), "cells", "hour")[1] == []
    assert hist2d.highest_cell(cells.limit(0)).first()[0] == 1
