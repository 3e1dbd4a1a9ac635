"""Column expressions on timestamps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(col: Column, formats: Sequence[str] = ()) -> Column:
    """Text to timestamp; NULL where neither ISO nor any of ``formats`` fits."""
    tries = [F.try_to_timestamp(col)] + [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def cyclic_calendar(ts: Column) -> dict[str, Column]:
    """Hour of day and day of year on the unit circle."""
    hour = F.hour(ts) * F.lit(2.0 * math.pi) / F.lit(24.0)
    day = F.dayofyear(ts) * F.lit(2.0 * math.pi) / F.lit(365.25)
    return {"sin_hour": F.sin(hour), "cos_hour": F.cos(hour), "sin_doy": F.sin(day), "cos_doy": F.cos(day)}


def is_leap_day(ts: Column) -> Column:
    return (F.month(ts) == 2) & (F.dayofmonth(ts) == 29)


def day_of_common_year(ts: Column) -> Column:
    """0..364, the same for a date in every year; NULL on 29 February."""
    date = F.when(~is_leap_day(ts), F.make_date(F.lit(1999), F.month(ts), F.dayofmonth(ts)))
    return F.dayofyear(date) - 1


def hour_of_year(ts: Column) -> Column:
    """0..8759 in a year of 365 days."""
    return day_of_common_year(ts) * 24 + F.hour(ts)


def label_of_hour_of_year(hour: Column, fmt: str = "MMM dd HH:mm") -> Column:
    base = F.unix_seconds(F.lit("1999-01-01 00:00:00").cast("timestamp"))
    return F.date_format(F.timestamp_seconds(base + hour.cast("long") * 3600), fmt)


def future_hours(ts: Column, horizon: int = 24) -> Column:
    """The next ``horizon`` hourly instants."""
    hour = F.expr("interval 1 hour")
    return F.sequence(ts + hour, ts + F.expr(f"interval {int(horizon)} hours"), hour)
