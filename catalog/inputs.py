"""How station concepts are read from the supplied tables.

``events`` plays the observations: a series per event type, ``value`` as temperature, and a dew point that
is sometimes above it. Bounds, split dates and chunk length suit its 30 days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermogrid.functions import parse_encoded
from thermogrid.operators import clean, features
from thermogrid.operators.split import time_split
from thermogrid.schema import Bounds, SplitDates
from thermogrid.session import use_utc

BOUNDS = Bounds(temp_min=1.0, temp_max=200.0, dew_min=0.0, dew_max=150.0)
DATES = SplitDates(val_start="2024-01-21", test_start="2024-01-26")
CHUNK_HOURS = 240
NUDGE = 1.3e-9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type as series_id", "event_id", "cast(ts as timestamp) as ts", "value as temp",
        "value * 0.6D + event_id % 7 as dew",
    )


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as ``+0123,q`` text in tenths."""
    text = "concat('+', lpad(cast(cast(floor({v} * 10 + 0.5D) as bigint) as string), 4, '0'), ',', cast(event_id % 10 as string))"
    return observations(spark, sf_dir).selectExpr(
        "series_id", "event_id", "ts", f"{text.format(v='temp')} as TMP", f"{text.format(v='dew')} as DEW"
    )


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select(
        "series_id", "event_id", "ts", parse_encoded(F.col("TMP")).alias("temp"), parse_encoded(F.col("DEW")).alias("dew")
    )


def clean_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_source(observations(spark, sf_dir), BOUNDS, chunk_hours=CHUNK_HOURS)


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_split(features.feature_matrix(clean_grid(spark, sf_dir), chunk_hours=CHUNK_HOURS), DATES)


def tidy(df: DataFrame) -> DataFrame:
    """Six decimals for doubles and zone-free instants, for comparison across engines.

    Sums of hundredths often end in an exact 5 at the seventh decimal; the nudge keeps both engines on the
    same side of it.
    """
    exprs = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "double":
            exprs.append(f"round(`{f.name}` + {NUDGE}D, 6) as `{f.name}`")
        elif kind == "timestamp":
            exprs.append(f"cast(`{f.name}` as timestamp_ntz) as `{f.name}`")
        else:
            exprs.append(f"`{f.name}`")
    return df.selectExpr(*exprs)
