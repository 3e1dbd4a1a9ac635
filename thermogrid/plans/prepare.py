"""Smaller jobs: clean a data folder, describe a table, prepare station data for window models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.restartable import LastStepLinear, last_step_rows
from ..operators.clean import clean_series
from ..operators.features import feature_matrix
from ..operators.hist2d import axis_bounds, hourly_cells, usable_pairs
from ..operators.profile import document_columns, missing_share, numeric_histograms, split_profile, split_report
from ..operators.sliding import WindowShape, sliding_windows
from ..operators.split import split_and_standardize, time_split
from ..schema import CHUNK_HOURS, CLEANING_BOUNDS, FILL_LIMIT, KEY, TS, Bounds, SplitDates
from ..sources.readers import RawSource, clean_stations, load_observations, read_splits, read_station_files
from ..sources.writers import write_frames, write_json, write_series, write_splits

WINDOW_FEATURES = (
    "precipitation_mm", "temperature_celsius", "humidity_percent", "pressure_hpa", "wind_speed_ms", "wind_x", "wind_y",
)


def clean_folder(
    spark: SparkSession, folder: str, sources: Sequence[RawSource], output: str, report: str | None = None,
    bounds: Bounds = CLEANING_BOUNDS, limit: int = FILL_LIMIT, dates: SplitDates = SplitDates(), chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Load, clean once more within ``bounds``, write parquet by year, and optionally profile the result."""
    loaded = load_observations(spark, folder, sources, limit=limit, chunk_hours=chunk_hours)
    write_series(clean_series(loaded, bounds, limit, chunk_hours), output)
    series = spark.read.parquet(output).drop("year")
    if report:
        rows = time_split(feature_matrix(series, chunk_hours=chunk_hours), dates)
        write_json(split_report(split_profile(rows, bounds=bounds)), report)
    return series


def describe_table(df: DataFrame) -> dict[str, DataFrame]:
    """Documentation, missing shares and histograms of one table."""
    return {"columns": document_columns(df), "missing": missing_share(df), "histograms": numeric_histograms(df)}


def hour_of_year_histogram(df: DataFrame, ts: str, x: str, y: str, output: str | None = None) -> DataFrame:
    cells = hourly_cells(df, ts, x, y)
    if output:
        write_frames(cells, axis_bounds(usable_pairs(df, ts, x, y)), output)
    return cells


def station_subset(cleaned: DataFrame, stations: Sequence[str] | None) -> DataFrame:
    """Rows of the given stations, or of all."""
    return cleaned.where(F.col(KEY).isin(*stations)) if stations else cleaned


def prepare_stations(spark: SparkSession, pattern: str, output: str, stations: Sequence[str] | None = None) -> None:
    """Station files to standardised train / val / test rows, split by position within each station."""
    cleaned = station_subset(clean_stations(read_station_files(spark, pattern)), stations)
    usable = cleaned.dropna(subset=[TS])
    write_splits(split_and_standardize(usable, WINDOW_FEATURES, list(WINDOW_FEATURES)), output)


def train_last_step(
    spark: SparkSession, splits: str, shape: WindowShape, label: str, epochs: int = 20, patience: int = 2,
    features: Sequence[str] = WINDOW_FEATURES,
) -> LastStepLinear:
    """Window model on processed splits; windows do not cross split edges."""
    parts = read_splits(spark, splits)
    flat = {}
    for name in ("train", "val"):
        windows = sliding_windows(parts[name], shape, features, [label], list(features))
        flat[name], x_names, y_names = last_step_rows(windows, list(features), label, shape.label_width)
    return LastStepLinear(x_names, y_names, epochs, patience).fit(flat["train"], flat["val"])
