"""Two-dimensional histograms for every hour of a 365-day year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hour_of_year, label_of_hour_of_year
from .scalars import attach_row

# Cells along each axis and hours of a common year.
GRID_SIZE = 50
HOURS_OF_YEAR = 8760


def usable_pairs(df: DataFrame, ts: str, x: str, y: str) -> DataFrame:
    """Rows with both measures, outside 29 February, with their hour of the year."""
    pairs = df.select(F.col(ts).alias("ts"), F.col(x).alias("x_value"), F.col(y).alias("y_value")).dropna(how="any")
    return pairs.withColumn("hour", hour_of_year(F.col("ts"))).where(F.col("hour").isNotNull())


def axis_bounds(pairs: DataFrame) -> DataFrame:
    """Whole numbers around the data: one row ``x_min, x_max, y_min, y_max``."""
    return pairs.agg(
        F.floor(F.min("x_value")).cast("double").alias("x_min"), F.ceil(F.max("x_value")).cast("double").alias("x_max"),
        F.floor(F.min("y_value")).cast("double").alias("y_min"), F.ceil(F.max("y_value")).cast("double").alias("y_max"),
    )


def cell(value: Column, low: Column, high: Column, size: int = GRID_SIZE) -> Column:
    """Cell index in ``0..size-1``; values on or past an end fall into the end cell."""
    place = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * size)
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.coalesce(place, F.lit(0)))).cast("int")


def hourly_cells(df: DataFrame, ts: str, x: str, y: str, size: int = GRID_SIZE) -> DataFrame:
    """Count of readings per ``(hour, x, y)``; at most ``8760 * size * size`` rows whatever the input."""
    pairs = usable_pairs(df, ts, x, y)
    placed = attach_row(pairs, axis_bounds(pairs)).select(
        F.col("hour").cast("int").alias("hour"),
        cell(F.col("x_value"), F.col("x_min"), F.col("x_max"), size).alias("x"),
        cell(F.col("y_value"), F.col("y_min"), F.col("y_max"), size).alias("y"),
    )
    return placed.groupBy("hour", "x", "y").agg(F.count(F.lit(1)).alias("cnt"))


def highest_cell(cells: DataFrame) -> DataFrame:
    """The largest count of any cell, at least 1."""
    return cells.agg(F.greatest(F.coalesce(F.max("cnt"), F.lit(0)), F.lit(1)).alias("max_cnt"))


def normalised_cells(cells: DataFrame) -> DataFrame:
    """Share of the largest cell, per hour."""
    return attach_row(cells, highest_cell(cells)).select(
        "hour", label_of_hour_of_year(F.col("hour")).alias("label"), "x", "y", "cnt",
        F.least(F.lit(1.0), F.col("cnt") / F.col("max_cnt")).alias("norm"),
    )


def cumulative_cells(cells: DataFrame) -> DataFrame:
    """Running count of each cell over the hours in which it changes (at most 8760 rows a cell)."""
    so_far = Window.partitionBy("x", "y").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select("hour", "x", "y", F.sum("cnt").over(so_far).alias("total"))


def cells_up_to(cells: DataFrame, hour: int) -> DataFrame:
    """All counts until and including ``hour``, with their share of the largest."""
    totals = cells.where(F.col("hour") <= hour).groupBy("x", "y").agg(F.sum("cnt").alias("total"))
    peak = totals.agg(F.max("total").alias("max_total"))
    return attach_row(totals, peak).select(
        "x", "y", "total", F.least(F.lit(1.0), F.col("total") / F.col("max_total")).alias("norm")
    )


def frames(cells: DataFrame) -> DataFrame:
    """One row for each of the 8760 hours with its cells as ``[{x, y, cnt}]``; empty hours are kept."""
    filled = cells.groupBy("hour").agg(F.array_sort(F.collect_list(F.struct("x", "y", "cnt"))).alias("cells"))
    hours = cells.sparkSession.range(HOURS_OF_YEAR).select(F.col("id").cast("int").alias("hour"))
    empty = F.array().cast("array<struct<x:int,y:int,cnt:bigint>>")
    return hours.join(filled, "hour", "left").select("hour", F.coalesce("cells", empty).alias("cells"))
