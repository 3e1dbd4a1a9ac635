"""Range check, dew-point clamp and the two fixed cleaning sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import above_other, clamp_to, in_range, out_of_range
from ..schema import CHUNK_HOURS, CLEANING_BOUNDS, FILL_LIMIT, KEY, MEASURES, TS, Bounds
from .grid import bucket_mean, merge_sources, reindex_and_fill


def present_measures(df: DataFrame) -> list[str]:
    return [m for m in MEASURES if m in df.columns]


def null_out_of_range(df: DataFrame, bounds: Bounds = CLEANING_BOUNDS) -> DataFrame:
    """Readings outside the bounds become missing; a value on a bound is kept."""
    return df.withColumns({m: in_range(F.col(m), *bounds.of(m)) for m in present_measures(df)})


def clamp_dew(df: DataFrame) -> DataFrame:
    """A dew point above the air temperature is set to the air temperature."""
    if present_measures(df) != list(MEASURES):
        return df
    return df.withColumn("dew", clamp_to(F.col("dew"), F.col("temp")))


def cleaning_audit(df: DataFrame, bounds: Bounds = CLEANING_BOUNDS) -> DataFrame:
    """How many readings of each series the range check and the clamp would change."""
    ranged = null_out_of_range(df.select(KEY, *MEASURES, *[F.col(m).alias(f"_raw_{m}") for m in MEASURES]), bounds)
    return ranged.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(out_of_range(F.col(f"_raw_{m}"), *bounds.of(m))).alias(f"{m}_out_of_range") for m in MEASURES],
        F.count_if(above_other(F.col("dew"), F.col("temp"))).alias("dew_above_temp"),
    )


def clean_source(
    df: DataFrame, bounds: Bounds = CLEANING_BOUNDS, limit: int = FILL_LIMIT, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    """One source to an hourly series: range, clamp, hourly mean, grid, fill, clamp."""
    readings = clamp_dew(null_out_of_range(df.dropna(subset=[TS]), bounds))
    # Readings without any measure leave no trace in a mean, so dropping hours without any is the same as
    # dropping such readings first. A filter below the aggregate would repeat the decoding in its predicate.
    hourly = bucket_mean(readings).dropna(how="all", subset=list(MEASURES))
    return clamp_dew(reindex_and_fill(hourly, limit, MEASURES, chunk_hours))


def clean_series(
    df: DataFrame, bounds: Bounds = CLEANING_BOUNDS, limit: int = FILL_LIMIT, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    """Clean an hourly series: range, clamp, grid, fill, clamp.

    Filling is not idempotent: a second pass fills up to ``limit`` further hours of a long gap.
    """
    hourly = clamp_dew(null_out_of_range(df, bounds))
    return clamp_dew(reindex_and_fill(hourly, limit, MEASURES, chunk_hours))


def combine_sources(
    frames: list[DataFrame], bounds: Bounds = CLEANING_BOUNDS, limit: int = FILL_LIMIT, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    """Clean each source, merge them by instant and clean the merged series."""
    cleaned = [clean_source(f, bounds, limit, chunk_hours) for f in frames]
    return clean_series(merge_sources(cleaned), bounds, limit, chunk_hours)
