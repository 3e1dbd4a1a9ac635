"""Train / validation / test splits and scaling fitted on the training part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY, TS, SplitDates
from ..session import materialise
from .chunks import with_position
from .scalars import attach

SPLITS = ("train", "val", "test")


def time_split(df: DataFrame, dates: SplitDates = SplitDates(), name: str = "split") -> DataFrame:
    """Label rows by period; the two boundary instants open their period."""
    at = lambda text: F.lit(text).cast("timestamp")
    return df.withColumn(
        name,
        F.when(F.col(TS) < at(dates.val_start), "train").when(F.col(TS) < at(dates.test_start), "val").otherwise("test"),
    )


def split_summary(df: DataFrame, split: str = "split", measures: Sequence[str] = ("temp", "dew")) -> DataFrame:
    """Rows, period, ranges and clamp violations of each split."""
    aggs = [F.count(F.lit(1)).alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")]
    for m in measures:
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    aggs.append(F.count_if(F.col("dew") > F.col("temp")).alias("dew_above_temp"))
    return df.groupBy(split).agg(*aggs)


def positional_split(
    df: DataFrame, tie_break: list[str], train: float = 0.7, train_val: float = 0.9, unit_seconds: int = 60
) -> DataFrame:
    """Label rows by their place in time order within the series: first 70 %, next 20 %, last 10 %."""
    placed = with_position(df, tie_break, unit_seconds, "pos", "_n")
    cut = lambda share: F.floor(F.col("_n") * F.lit(float(share)))
    label = F.when(F.col("pos") < cut(train), "train").when(F.col("pos") < cut(train_val), "val").otherwise("test")
    return placed.withColumn("split", label).drop("_n")


def fit_scaler(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of each column; a constant column gets deviation 1."""
    aggs = []
    for c in columns:
        std = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def fit_target_scaler(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One mean and one population deviation over all target columns taken together."""
    return df.select(F.explode(F.array(*targets)).alias("y")).agg(
        F.avg("y").alias("y_mean"), F.stddev_pop("y").alias("y_std")
    )


def standardize(df: DataFrame, scaler: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(x - mean) / std`` with a fitted scaler; the scaler has one row per key."""
    joined = attach(df, scaler, list(by), "left")
    scaled = joined.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns})
    return scaled.select(*df.columns)


def invert_scaling(df: DataFrame, scaler: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    joined = attach(df, scaler, list(by), "left")
    raw = joined.withColumns({c: F.col(c) * F.col(f"{c}_std") + F.col(f"{c}_mean") for c in columns})
    return raw.select(*df.columns)


def split_and_standardize(
    df: DataFrame, columns: Sequence[str], tie_break: list[str], unit_seconds: int = 60
) -> DataFrame:
    """Positional split, then scaling of all rows by the training rows of their series.

    The split rows have two readers and are written once.
    """
    split = materialise(positional_split(df, tie_break, unit_seconds=unit_seconds))
    return standardize(split, fit_scaler(split.where(F.col("split") == "train"), columns, [KEY]), columns, [KEY])
