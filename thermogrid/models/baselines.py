"""Persistence and climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HORIZON, KEY, TS
from .base import prediction, with_prediction

LEAP_DAYS = 366


class Persistence:
    """The next day stays at the current temperature."""

    name = "persistence"

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Persistence:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        now = F.col("temp_lag0")
        return with_prediction(rows, self.name, prediction(F.array_repeat(now, HORIZON), now, now, now))


class Climatology:
    """Mean temperature of each series by day of year and hour of day.

    ``fit`` takes an hourly series (not feature rows). A day and hour without a mean gets the mean of the
    whole series. Instead of 24 look-ups per row, the 24 hours that follow each hour of the year are laid
    out once per series (one ring of 366 days serves all years), so that scoring is one equi-join and rows are never multiplied.
    """

    name = "climatology"

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> Climatology:
        # Both tables read the same sums and counts and the same filters, so the data is aggregated once.
        known = F.col(KEY).isNotNull() & F.col("doy").isNotNull() & F.col("hour").isNotNull()
        slots = train.groupBy(KEY, F.dayofyear(TS).alias("doy"), F.hour(TS).alias("hour")).agg(
            F.sum("temp").alias("_sum"), F.count("temp").alias("_n")
        ).where(known)
        self.means = slots.select(KEY, "doy", "hour", (F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))).alias("mean"))
        self.overall = slots.groupBy(KEY).agg((F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("overall"))
        return self

    def day_ahead(self) -> DataFrame:
        """``(series_id, slot, yhat)``: the 24 hours that follow each hour of a leap year, a ring of 366 days; and, from slot 8784 on, those that follow
        the last day of a common year, the only ones that differ there.
        """
        year, last = LEAP_DAYS * 24, (LEAP_DAYS - 2) * 24
        leap = F.transform(F.sequence(F.lit(0), F.lit(year + HORIZON - 1)), lambda p: F.struct(F.lit(0).alias("part"), p.alias("place"), (p % year).alias("hour_of_year")))
        common = F.transform(F.sequence(F.lit(0), F.lit(24 + HORIZON - 1)), lambda p: F.struct(
            F.lit(1).alias("part"), p.alias("place"), F.when(p < 24, p + last).otherwise(p - 24).alias("hour_of_year")))
        ring = self.overall.select(KEY, "overall", F.inline(F.concat(leap, common)))
        ring = ring.withColumns({"doy": (F.floor(F.col("hour_of_year") / 24) + 1).cast("int"), "hour": F.col("hour_of_year") % 24})
        valued = ring.join(self.means, [KEY, "doy", "hour"], "left").withColumn("_v", F.coalesce("mean", "overall"))
        ahead = Window.partitionBy(KEY, "part").orderBy("place").rowsBetween(1, HORIZON)
        laid = valued.withColumn("yhat", F.collect_list("_v").over(ahead))
        own = F.when(F.col("part") == 0, F.lit(year)).otherwise(24)
        return laid.where(F.col("place") < own).select(KEY, (F.col("place") + F.col("part") * year).cast("int").alias("slot"), "yhat")

    def predict(self, rows: DataFrame) -> DataFrame:
        doy, hour = F.dayofyear(TS), F.hour(TS)
        common_end = (doy == LEAP_DAYS - 1) & (F.dayofyear(F.make_date(F.year(TS), F.lit(12), F.lit(31))) < LEAP_DAYS)
        placed = rows.withColumn("slot", F.when(common_end, LEAP_DAYS * 24 + hour).otherwise((doy - 1) * 24 + hour))
        joined = placed.join(self.day_ahead(), [KEY, "slot"], "left")
        return with_prediction(joined, self.name, prediction(F.col("yhat"))).select(*rows.columns, f"pred_{self.name}")
