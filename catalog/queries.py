"""One Spark query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermogrid.functions import (
    cyclic_calendar, diurnal_profile, future_hours, hour_of_year, label_of_hour_of_year, parse_encoded, wind_components,
)
from thermogrid.models.base import score
from thermogrid.models.baselines import Climatology, Persistence
from thermogrid.models.linear import GradientRidge, Ridge
from thermogrid.models.restartable import LastStepLinear, RestartableLinear, last_step_rows
from thermogrid.models.boosting import HistogramBoosting
from thermogrid.operators import chunks, clean, evaluate, features, grid, hist2d, history, profile, rate_policy, sliding, split
from thermogrid.plans.prepare import station_subset as station_subset_of
from thermogrid.schema import HORIZON, KEY, SUMMARY_TARGETS, TS, feature_names, target_names
from thermogrid.session import materialise, scratch_path
from thermogrid.sources import readers, writers
from thermogrid.sources.paths import matching, rename

from .inputs import (
    BOUNDS, CHUNK_HOURS, DATES, clean_grid, decoded, encoded, feature_rows, observations, table, tidy,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

WINDOW = sliding.WindowShape(input_width=24, label_width=6, shift=8)
PLATEAU = rate_policy.RatePolicy(
    factor=0.5, patience=2, min_lr=0.01, min_delta=1e-4, cooldown=1, restart_patience=3, initial_lr=0.1
)
PROFILE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def query(make: Query) -> Query:
    """Register under the function's name, with comparable output."""
    REGISTRY[make.__name__] = lambda spark, sf_dir: tidy(make(spark, sf_dir))
    return make


# --- readings -------------------------------------------------------------------------------------------


@query
def parse_encoded_forms(spark, sf):
    """Every accepted and rejected form of the encoded text, lenient and strict."""
    forms = """case event_id % 7
        when 0 then TMP
        when 1 then split(TMP, ',')[0]
        when 2 then concat(TMP, ',extra')
        when 3 then concat('  ', TMP, ' ')
        when 4 then concat(cast(event_id % 50 as string), '.5,1')
        when 5 then concat('-', lpad(cast(event_id % 1000 as string), 4, '0'), ',', cast(event_id % 10 as string))
        else case event_id % 4 when 0 then '9999,1' when 1 then '-9999,1' when 2 then '999,1' else '' end end"""
    raw = encoded(spark, sf).selectExpr("event_id", f"{forms} as raw")
    return raw.select(
        "event_id", "raw", parse_encoded(F.col("raw")).alias("lenient"), parse_encoded(F.col("raw"), strict=True).alias("strict")
    )


@query
def range_null(spark, sf):
    return clean.null_out_of_range(observations(spark, sf), BOUNDS)


@query
def clamp(spark, sf):
    return clean.clamp_dew(observations(spark, sf))


@query
def cleaning_audit(spark, sf):
    return clean.cleaning_audit(observations(spark, sf), BOUNDS)


@query
def wind_parts(spark, sf):
    x, y = wind_components((F.col("event_id") % 360).cast("double"))
    return table(spark, sf, "events").select("event_id", x.alias("wind_x"), y.alias("wind_y"))


@query
def diurnal(spark, sf):
    day = diurnal_profile(F.col("temp"), F.col("dew"))
    profiles = observations(spark, sf).select("event_id", day.alias("day"))
    # figures of the day first: beside the generator they would be worked out for each of its hours
    days = profiles.select(
        "event_id", F.array_max("day").alias("tmax"), F.array_min("day").alias("tmin"),
        (F.aggregate("day", F.lit(0.0), lambda a, v: a + v) / HORIZON).alias("tavg"), "day",
    )
    return days.select("event_id", "tmax", "tmin", "tavg", F.posexplode("day").alias("step", "temp"))


@query
def year_hours(spark, sf):
    """Hour of the 365-day year and its label, for every ship date shifted by its line number."""
    shifted = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_shipdate as timestamp) + make_interval(0,0,0,0,l_linenumber) as ts"
    )
    hour = hour_of_year(F.col(TS))
    return shifted.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "label", label_of_hour_of_year(F.col("hour"))
    )


@query
def future_stamps(spark, sf):
    hours = observations(spark, sf).select(KEY, F.explode(future_hours(F.date_trunc("hour", TS))).alias("target_ts"))
    return hours.groupBy(KEY, "target_ts").agg(F.count(F.lit(1)).alias("n"))


# --- series ---------------------------------------------------------------------------------------------


@query
def hourly_mean(spark, sf):
    return grid.bucket_mean(observations(spark, sf))


@query
def hourly_grid(spark, sf):
    return grid.reindex_hourly(grid.bucket_mean(decoded(spark, sf)), chunk_hours=CHUNK_HOURS)


@query
def interpolate_limited(spark, sf):
    return grid.reindex_and_fill(grid.bucket_mean(_rare(spark, sf)), 3, chunk_hours=CHUNK_HOURS)


def _rare(spark, sf):
    """Only high readings, which leaves gaps of many hours, at both ends as well."""
    rare = observations(spark, sf)
    return rare.withColumns({"temp": F.when(F.col("temp") > 60, F.col("temp")), "dew": F.when(F.col("dew") > 70, F.col("dew"))})


@query
def source_clean(spark, sf):
    return clean.clean_source(decoded(spark, sf), BOUNDS, chunk_hours=CHUNK_HOURS)


@query
def series_clean(spark, sf):
    """The series cleaner a second time on a cleaned series: long gaps are filled further."""
    return clean.clean_series(
        clean.clean_source(_rare(spark, sf), BOUNDS, 2, CHUNK_HOURS), BOUNDS, 2, CHUNK_HOURS
    )


def _two_sources(spark, sf):
    """Encoded readings until day 20 and plain ones from day 10 on; ten days are in both."""
    early = decoded(spark, sf).where(F.col(TS) < F.lit("2024-01-20").cast("timestamp"))
    late = observations(spark, sf).where(F.col(TS) >= F.lit("2024-01-10").cast("timestamp"))
    return [early.select(KEY, TS, "temp", "dew"), late.select(KEY, TS, "temp", "dew")]


@query
def source_merge_mean(spark, sf):
    return grid.merge_sources([grid.bucket_mean(s) for s in _two_sources(spark, sf)])


@query
def combined_dataset(spark, sf):
    return clean.combine_sources(_two_sources(spark, sf), BOUNDS, chunk_hours=CHUNK_HOURS)


@query
def daily_resample(spark, sf):
    days = table(spark, sf, "events").selectExpr(
        "cast(user_id as string) as series_id", "cast(ts as timestamp) as ts", "value as temp", "if(value > 80, value, null) as dew"
    )
    return grid.daily_means(days)


@query
def daily_profile(spark, sf):
    """Flagship: decode, clean and grid the readings, then hours with data and means per day."""
    series = clean.clean_source(decoded(spark, sf), BOUNDS, chunk_hours=CHUNK_HOURS)
    return series.groupBy(KEY, F.date_trunc("day", TS).alias("day")).agg(
        F.count(F.lit(1)).alias("hours"), F.count("temp").alias("temp_hours"),
        F.avg("temp").alias("temp"), F.avg("dew").alias("dew"),
    )


@query
def dataset_summary(spark, sf):
    return split.split_summary(clean_grid(spark, sf), KEY)


# --- files ----------------------------------------------------------------------------------------------


@query
def csv_encoded(spark, sf):
    """Comma-separated file with encoded readings, written from the events and read back."""
    path = scratch_path(spark)
    stamped = encoded(spark, sf).withColumn("DATE", F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    stamped.select("event_id", "DATE", "TMP", "DEW").write.option("header", True).csv(path)
    return readers.read_observations(spark, readers.RawSource(path, encoding="tenths"))


STATION_ORDERS = (1, -1, 0)  # header as fixed, reversed, and without one column


def _station_files(spark, sf):
    """Three station files of the events, with columns in different orders, one file without humidity."""
    folder, names = scratch_path(spark), list(readers.STATION_COLUMNS)
    cells = [F.date_format(TS, "yyyy-MM-dd HH:mm:ss"), F.lit("0.5"), F.col("temp"), F.col("event_id") % 100, F.lit("1000"), F.lit("90"), F.lit("3")]
    rows = observations(spark, sf).select("event_id", *[c.cast("string").alias(n) for n, c in zip(names, cells)])
    for k, order in enumerate(STATION_ORDERS):
        kept = names[::order] if order else [n for n in names if n != "Humedad (%)"]
        part = f"{folder}/part{k}"
        rows.where(F.col("event_id") % 3 == k).select(*[F.col(f"`{n}`") for n in kept]).coalesce(1).write.option("header", True).option(
            "encoding", readers.STATION_CHARSET).csv(part)
        rename(spark, matching(spark, f"{part}/part-*")[0], f"{folder}/weather_{k + 1}.csv")
    return readers.clean_stations(readers.read_station_files(spark, f"{folder}/*.csv"))


@query
def station_files(spark, sf):
    return _station_files(spark, sf).select("series_id", TS, "precipitation_mm", "temperature_celsius", "humidity_percent", "pressure_hpa")


@query
def station_subset(spark, sf):
    return station_subset_of(_station_files(spark, sf), ("station_1", "station_3")).select("series_id", TS, "temperature_celsius", "wind_speed_ms")


@query
def folder_load(spark, sf):
    """A folder with an encoded and a semicolon file of plain degrees that overlap, cleaned and merged."""
    folder = scratch_path(spark)
    early = F.col(TS) < F.lit("2024-01-20").cast("timestamp")
    late = F.col(TS) >= F.lit("2024-01-10").cast("timestamp")
    stamp = F.date_format(TS, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("DATE")
    encoded(spark, sf).where(early).select(stamp, "TMP", "DEW").write.option("header", True).csv(f"{folder}/old")
    plain = observations(spark, sf).where(late)
    plain.select(stamp, F.col("temp").alias("temperature"), F.col("dew").alias("dew_point_temperature")).write.option(
        "header", True).option("sep", ";").csv(f"{folder}/new")
    sources = [readers.RawSource("old", encoding="tenths"), readers.RawSource("new", sep=";", encoding="celsius"), readers.RawSource("absent", encoding="auto")]
    return readers.load_observations(spark, folder, sources, bounds=BOUNDS, chunk_hours=CHUNK_HOURS)


@query
def cleaned_table(spark, sf):
    """Cleaned series written by year and read back."""
    path = scratch_path(spark)
    writers.write_series(clean_grid(spark, sf), path)
    return readers.read_cleaned(spark, path)


@query
def split_files(spark, sf):
    path = scratch_path(spark)
    rows = split.split_and_standardize(observations(spark, sf), ["temp", "dew"], ["event_id"])
    writers.write_splits(rows.select(KEY, "event_id", "temp", "split"), path)
    parts = readers.read_splits(spark, path)
    out = [parts[s].withColumn("split", F.lit(s)) for s in split.SPLITS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def frame_files(spark, sf):
    path = scratch_path(spark)
    ship = _shipments(spark, sf)
    writers.write_frames(_cells(spark, sf), hist2d.axis_bounds(hist2d.usable_pairs(ship, "ts", "l_quantity", "l_extendedprice")), path)
    frames = spark.read.schema("hour int, frame array<array<bigint>>").json(f"{path}/frames")
    one = lambda c: F.array_join(c.cast("array<string>"), ":")
    return frames.select("hour", F.array_join(F.transform("frame", one), " ").alias("cells"))


# --- features -------------------------------------------------------------------------------------------


@query
def lag_features(spark, sf):
    return features.lag_features(clean_grid(spark, sf), chunk_hours=CHUNK_HOURS)


@query
def rolling_features(spark, sf):
    series = grid.reindex_hourly(grid.bucket_mean(decoded(spark, sf)), chunk_hours=CHUNK_HOURS)
    return features.rolling_features(series, chunk_hours=CHUNK_HOURS)


@query
def calendar_features(spark, sf):
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(o_orderdate as timestamp) + make_interval(0,0,0,0,cast(o_orderkey % 24 as int)) as ts"
    )
    return orders.withColumns(cyclic_calendar(F.col(TS))).drop(TS)


@query
def lead_targets(spark, sf):
    return features.lead_targets(clean_grid(spark, sf), chunk_hours=CHUNK_HOURS)


@query
def target_summary(spark, sf):
    series = grid.reindex_hourly(grid.bucket_mean(decoded(spark, sf)), chunk_hours=CHUNK_HOURS)
    targets = features.lead_targets(series, chunk_hours=CHUNK_HOURS)
    return features.summarise_targets(targets).select(KEY, TS, *SUMMARY_TARGETS)


@query
def feature_matrix(spark, sf):
    return features.feature_matrix(clean_grid(spark, sf), chunk_hours=CHUNK_HOURS)


# --- splits ---------------------------------------------------------------------------------------------


@query
def time_split(spark, sf):
    return split.split_summary(split.time_split(clean_grid(spark, sf), DATES))


@query
def positional_split(spark, sf):
    return split.positional_split(observations(spark, sf), ["event_id"]).select("event_id", KEY, "pos", "split")


@query
def scaler(spark, sf):
    parts = split.positional_split(observations(spark, sf), ["event_id"])
    return split.fit_scaler(parts.where(F.col("split") == "train"), ["temp", "dew"], [KEY])


@query
def target_scaler(spark, sf):
    return split.fit_target_scaler(feature_rows(spark, sf), target_names())


@query
def standardize(spark, sf):
    return split.split_and_standardize(observations(spark, sf), ["temp", "dew"], ["event_id"]).drop("pos")


@query
def sliding_windows(spark, sf):
    windows = sliding.sliding_windows(
        observations(spark, sf), WINDOW, ["temp", "dew"], ["temp"], ["event_id"], chunk_rows=512
    )
    text = lambda array, field: F.array_join(F.transform(array, lambda r: F.round(r[field] * 100).cast("bigint").cast("string")), ",")
    return windows.select(
        KEY, "start_pos", "start_ts", text("inputs", "temp").alias("temps"), text("labels", "temp").alias("labels"),
        F.aggregate("inputs", F.lit(0.0), lambda a, r: a + r["dew"]).alias("dew_sum"),
    )


# --- profile --------------------------------------------------------------------------------------------


def _daily(spark, sf):
    """Order prices by day as daily maxima, minima and means."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.max("o_totalprice").alias("TMAX"), F.min("o_totalprice").alias("TMIN"), F.avg("o_totalprice").alias("TAVG")
    )


@query
def unpivot(spark, sf):
    return profile.to_long(_daily(spark, sf), ["TMAX", "TMIN", "TAVG"], ["day"])


@query
def column_stats(spark, sf):
    items = table(spark, sf, "lineitem").withColumns({
        "l_tax": F.when(F.col("l_linenumber") > 2, F.col("l_tax")), "nothing": F.lit(None).cast("double"),
    })
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "nothing"]
    return profile.column_stats(profile.to_long(items, columns, ["l_returnflag"]), ["l_returnflag", "variable"])


@query
def iqr_outliers(spark, sf):
    long = profile.to_long(materialise(observations(spark, sf).select(KEY, "temp", "dew")), ["temp", "dew"], [KEY])
    return profile.outlier_counts(long, [KEY, "variable"])


@query
def box_plots(spark, sf):
    return profile.box_plot(profile.to_long(materialise(_daily(spark, sf)), ["TMAX", "TMIN", "TAVG"]))


@query
def bad_values(spark, sf):
    rows = split.time_split(decoded(spark, sf), DATES).drop("event_id", KEY)
    return profile.bad_values(rows, BOUNDS, ["split"])


@query
def bad_values_total(spark, sf):
    rows = split.time_split(observations(spark, sf), DATES).drop("event_id", KEY)
    return profile.bad_values_total(profile.bad_values(rows, BOUNDS, ["split"]))


@query
def histogram(spark, sf):
    long = profile.to_long(observations(spark, sf), ["temp", "dew"], [KEY])
    return profile.histogram(long, [KEY, "variable"], range_by=["variable"])


@query
def numeric_histograms(spark, sf):
    return profile.numeric_histograms(table(spark, sf, "lineitem"))


@query
def split_statistics(spark, sf):
    return profile.column_stats(profile.profiled_values(feature_rows(spark, sf)), ["split", "variable"])


@query
def split_periods(spark, sf):
    return profile.split_periods(feature_rows(spark, sf), bounds=BOUNDS)


@query
def split_histograms(spark, sf):
    return profile.split_histograms(profile.profiled_values(feature_rows(spark, sf)))


@query
def missing_pct(spark, sf):
    gaps = decoded(spark, sf)
    return profile.missing_share(gaps)


@query
def column_docs(spark, sf):
    out = profile.document_tables({name: table(spark, sf, name) for name in PROFILE_TABLES})
    number = lambda c: F.when(F.col("kind") == "numeric", F.col(c).try_cast("double"))
    date = lambda c: F.when(F.col("kind") == "date", F.col(c))
    return out.select(
        "source", "variable", "kind", number("low").alias("low"), number("high").alias("high"),
        date("low").alias("first_day"), date("high").alias("last_day"), "distinct", "listed",
    )


def _day_rows(spark, sf):
    """Prices, discounted prices and taxed prices of line items as daily maxima, means and minima."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "l_extendedprice / 2000 as TMAX", "l_extendedprice * (1 + l_tax) / 2000 - l_discount * 20 as TMIN",
        "l_extendedprice * (1 - l_discount) / 2000 as TAVG",
    )


@query
def sanity_checks(spark, sf):
    return profile.daily_sanity(_day_rows(spark, sf))


@query
def sanity_examples(spark, sf):
    return profile.sanity_examples(_day_rows(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey"])


# --- two-dimensional histograms -------------------------------------------------------------------------


def _shipments(spark, sf):
    """Quantity against price, at an hour of the ship date."""
    return table(spark, sf, "lineitem").selectExpr(
        "cast(l_shipdate as timestamp) + make_interval(0,0,0,0,cast(l_orderkey % 24 as int)) as ts", "l_quantity", "l_extendedprice"
    )


def _cells(spark, sf):
    return hist2d.hourly_cells(_shipments(spark, sf), "ts", "l_quantity", "l_extendedprice")


@query
def hist2d_cells(spark, sf):
    return _cells(spark, sf)


@query
def hist2d_bounds(spark, sf):
    return hist2d.axis_bounds(hist2d.usable_pairs(_shipments(spark, sf), "ts", "l_quantity", "l_extendedprice"))


@query
def hist2d_cumulative(spark, sf):
    return hist2d.cumulative_cells(_cells(spark, sf))


@query
def hist2d_up_to(spark, sf):
    return hist2d.cells_up_to(_cells(spark, sf), 4000)


@query
def hist2d_normalised(spark, sf):
    return hist2d.normalised_cells(_cells(spark, sf))


@query
def hist2d_frames(spark, sf):
    one = lambda c: F.concat_ws(":", c["x"], c["y"], c["cnt"])
    return hist2d.frames(_cells(spark, sf)).select("hour", F.array_join(F.transform("cells", one), " ").alias("cells"))


# --- forecasts and scores -------------------------------------------------------------------------------


def _baselines(spark, sf):
    series = materialise(clean_grid(spark, sf))
    rows = split.time_split(features.feature_matrix(series, chunk_hours=CHUNK_HOURS), DATES)
    climatology = Climatology().fit(series.where(F.col(TS) < F.lit(DATES.test_start).cast("timestamp")))
    held_out = rows.where(F.col("split") != "train")
    return evaluate.long_predictions(score([Persistence(), climatology], held_out), ["persistence", "climatology"])


def _steps(predictions):
    return predictions.select(KEY, TS, "model", F.posexplode("yhat").alias("h", "yhat"), "tmax", "tmin", "tavg")


@query
def persistence(spark, sf):
    return _steps(_baselines(spark, sf).where(F.col("model") == "persistence"))


@query
def climatology_fit(spark, sf):
    fitted = Climatology().fit(clean_grid(spark, sf))
    return fitted.means.join(fitted.overall, KEY)


@query
def climatology(spark, sf):
    return _steps(_baselines(spark, sf).where(F.col("model") == "climatology"))


@query
def evaluate_models(spark, sf):
    return evaluate.evaluate(_baselines(spark, sf))


@query
def leaderboard(spark, sf):
    return evaluate.leaderboard(evaluate.evaluate(_baselines(spark, sf)))


@query
def kpi(spark, sf):
    return evaluate.kpi_summary(evaluate.evaluate(_baselines(spark, sf)))


@query
def validation_error(spark, sf):
    return evaluate.validation_mae(_baselines(spark, sf))


@query
def residual_summary(spark, sf):
    return evaluate.residual_summary(evaluate.residuals(_baselines(spark, sf)))


@query
def residual_histogram(spark, sf):
    return profile.histogram(materialise(evaluate.residuals(_baselines(spark, sf))), ["model"], evaluate.RESIDUAL_BINS)


@query
def error_boxplot(spark, sf):
    errors = evaluate.residuals(_baselines(spark, sf)).select("model", F.col("abs_error").alias("value"))
    return profile.box_plot(materialise(errors), ["model"])


@query
def tail_sample(spark, sf):
    return evaluate.tail_rows(materialise(_baselines(spark, sf)), 200, models=2).select(KEY, TS, "model", "now", "actual_tmax", "tmax")


@query
def last_profiles(spark, sf):
    last = evaluate.last_profiles(materialise(_baselines(spark, sf)))
    return last.select("model", "last_ts", F.posexplode("profile").alias("h", "yhat"))


@query
def evaluation_export(spark, sf):
    export = evaluate.evaluation_export(materialise(_baselines(spark, sf)), 100, models=2)
    zipped = F.arrays_zip("timestamps", "actual_current_temp", "actual_next24_tmin", "tmin")
    return export.select("model", "last_timestamp", F.posexplode(zipped).alias("place", "_e")).select("model", "last_timestamp", "place", "_e.*")


@query
def metrics_report(spark, sf):
    report = evaluate.metrics_report(evaluate.evaluate(_baselines(spark, sf)))
    return report.select(
        "model_name", F.col("hourly_24h.mae").alias("mae"), F.col("hourly_24h")["acc_2.0C"].alias("acc_2"),
        F.col("hourly_24h.directional_f1").alias("directional_f1"), F.col("tmax.rmse").alias("tmax_rmse"), F.col("tavg.r2").alias("tavg_r2"),
    )


@query
def report_files(spark, sf):
    """The metrics report, written as JSON and read back."""
    report, path = evaluate.metrics_report(evaluate.evaluate(_baselines(spark, sf))), scratch_path(spark)
    writers.write_json(report, path)
    return spark.read.schema(report.schema).json(path).select(
        "model_name", F.col("hourly_24h.mae").alias("mae"), F.col("hourly_24h")["acc_2.0C"].alias("acc_2"),
        F.col("hourly_24h.directional_f1").alias("directional_f1"), F.col("tmax.rmse").alias("tmax_rmse"), F.col("tavg.r2").alias("tavg_r2"),
    )


# --- fitted models: no SQL counterpart, checked in tests -------------------------------------------------


def _split_rows(spark, sf):
    rows = materialise(feature_rows(spark, sf))
    return [rows.where(F.col("split") == s) for s in split.SPLITS]


def _scored(model, test):
    return evaluate.evaluate(evaluate.long_predictions(score([model], test), [model.name]))


@query
def ridge(spark, sf):
    train, val, test = _split_rows(spark, sf)
    return _scored(Ridge(alpha=1.0).fit(train), test)


@query
def ridge_gradient(spark, sf):
    train, val, test = _split_rows(spark, sf)
    return _scored(GradientRidge(alpha=0.01).fit(train, val), test)


@query
def restartable_fit(spark, sf):
    train, val, test = _split_rows(spark, sf)
    return RestartableLinear(max_iters=2).fit(train, val).history_table(spark)


@query
def boosted_trees(spark, sf):
    train, val, test = _split_rows(spark, sf)
    return _scored(HistogramBoosting().fit(train, val), test)


@query
def last_step_linear(spark, sf):
    rows = split.split_and_standardize(observations(spark, sf), ["temp", "dew"], ["event_id"])
    flat = {}
    for part in ("train", "val"):
        windows = sliding.sliding_windows(
            rows.where(F.col("split") == part), WINDOW, ["temp", "dew"], ["temp"], ["event_id"]
        )
        flat[part], x, y = last_step_rows(windows, ["temp", "dew"], "temp", WINDOW.label_width)
    model = LastStepLinear(x, y).fit(flat["train"], flat["val"])
    return spark.createDataFrame(model.history).withColumn("model", F.lit(model.name))


# --- training histories ---------------------------------------------------------------------------------


def _history(spark, sf):
    """A run per user; steps in time order; the reading as validation error, a variant as training loss."""
    rows = table(spark, sf, "events").selectExpr(
        "cast(user_id as string) as series_id", "cast(ts as timestamp) as ts", "event_id", "value"
    )
    placed = chunks.with_position(rows, ["event_id"], unit_seconds=3600)
    return placed.selectExpr(
        "series_id as run_id", "pos + 1 as step", "value as val_mae", "value as val_loss",
        "value * 0.5D + event_id % 13 as train_loss",
    )


@query
def history_running_best(spark, sf):
    return history.running_best(_history(spark, sf), block_steps=16)


@query
def history_overfit(spark, sf):
    return history.overfit_flags(_history(spark, sf), block_steps=16)


@query
def history_status(spark, sf):
    return history.fit_status(history.running_best(_history(spark, sf)), target=0.5)


@query
def history_best_run(spark, sf):
    runs = _history(spark, sf).groupBy("run_id").agg(F.min("val_mae").alias("best_val_mae"))
    return history.best_over_runs(runs, name="run_id")


def _records(spark, sf):
    """A nested history record per customer: their orders as epochs, some as over- or underfitted runs."""
    orders = table(spark, sf, "orders")
    runs = orders.groupBy(F.col("o_custkey").cast("string").alias("model")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("_o"),
        F.min("o_totalprice").alias("best_val_mae"), F.max("o_orderstatus").alias("status"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).cast("int").alias("best_epoch"),
    )
    return runs.selectExpr(
        "model", "transform(_o, (o, i) -> named_struct('epoch', i + 1, 'val_mae', o.o_totalprice)) as epochs",
        "cast(null as array<struct<stage:int>>) as stages", "filter(_o, o -> o.o_totalprice > 250000) as lr_decay_events",
        "0 as total_epochs", "best_val_mae", "best_epoch", "cast(null as double) as target_mae", "cast(null as string) as final_status",
        "if(status = 'P', null, status) as status", "status = 'O' as overfitting_detected", "status = 'P' as underfitting_detected",
    )


@query
def history_summary(spark, sf):
    return history.history_summary(_records(spark, sf))


@query
def history_epochs(spark, sf):
    return history.epoch_rows(_records(spark, sf))


@query
def policy_replay(spark, sf):
    return rate_policy.replay(_history(spark, sf), PLATEAU)


@query
def policy_events(spark, sf):
    events = rate_policy.rate_events(rate_policy.replay(_history(spark, sf), PLATEAU))
    return events.groupBy("run_id", "event").agg(F.count(F.lit(1)).alias("n"), F.min("lr").alias("lowest_lr"))


def _cyclic(spark, sf, mode):
    policy = rate_policy.RatePolicy(
        policy="cyclic", cyclic_mode=mode, min_lr=0.001, initial_lr=0.1, cycle_step_size=5, gamma=0.99
    )
    return rate_policy.replay(_history(spark, sf), policy).select("run_id", "step", "lr")


for _mode in ("triangular", "triangular2", "exp_range"):
    _make = partial(_cyclic, mode=_mode)
    _make.__name__ = f"policy_{_mode}"
    query(_make)
