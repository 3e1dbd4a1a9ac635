"""Time chunks: how one long series is spread over many tasks.

A window over a whole series would run in one task however long the series is. Every windowed operator
here works on ``(series_id, chunk)`` instead, where a chunk is a fixed stretch of hours. Rows that a
neighbouring chunk's frames reach are copied there first (the halo) and dropped afterwards, so results
equal those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TS
from ..session import materialise
from .scalars import attach

CHUNK = "_chunk"
CORE = "_core"
_UNITS_PER_BLOCK = 1440


def chunk_of(ts: Column, hours: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(3600 * hours))


def with_halo(df: DataFrame, back: int, ahead: int, chunk_hours: int) -> DataFrame:
    """Add ``CHUNK`` and ``CORE``, copying edge rows to the chunks that need them.

    ``df`` must be hourly. ``back`` and ``ahead`` are the hours that frames reach to either side.
    """
    if max(back, ahead) > chunk_hours:
        raise ValueError("a chunk must be at least as long as the frames that reach out of it")
    own = chunk_of(F.col(TS), chunk_hours)
    offset = F.floor(F.unix_seconds(TS) / F.lit(3600)) - F.col("_own") * chunk_hours
    homes = F.array_compact(F.array(
        F.col("_own"),
        F.when(offset >= chunk_hours - back, F.col("_own") + 1),
        F.when(offset < ahead, F.col("_own") - 1),
    ))
    return (
        df.withColumn("_own", own)
        .withColumn(CHUNK, F.explode(homes))
        .withColumn(CORE, F.col(CHUNK) == F.col("_own"))
        .drop("_own")
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(CORE, CHUNK)


def with_position(
    df: DataFrame, tie_break: list[str], unit_seconds: int = 60, position: str = "pos", total: str | None = None, unit_rows: int = 1_000_000
) -> DataFrame:
    """0-based row position of each row in its series by time, without one task per series.

    Rows are counted per short unit of time. The counts are summed up in two levels (units within a block,
    blocks within a series), so that no window is long, and a row then needs only its rank inside its own
    unit. Units of more than ``unit_rows`` rows, be it at one instant, are not ranked by a window: :func:`_cut_units` cuts them by time and
    then by the tie-break. Counts are written first, as they decide whether there is such a unit.
    """
    # The filters are those that the joins would infer; stated early, both readers of the counts share a plan.
    rows = df.where(F.col(KEY).isNotNull() & F.col(TS).isNotNull())
    rows = rows.withColumn("_unit", F.floor(F.unix_seconds(TS) / unit_seconds)).where(F.col("_unit").isNotNull())
    units = materialise(rows.groupBy(KEY, "_unit").agg(F.count(F.lit(1)).alias("_rows"))).withColumn(CHUNK, F.floor(F.col("_unit") / _UNITS_PER_BLOCK))
    series = Window.partitionBy(KEY)
    before = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = units.groupBy(KEY, CHUNK).agg(F.sum("_rows").alias("_rows")).select(
        KEY, CHUNK, F.sum("_rows").over(before(series, CHUNK)).alias("_block_start"), F.sum("_rows").over(series).alias("_total")
    )
    in_block = F.sum("_rows").over(before(Window.partitionBy(KEY, CHUNK), "_unit"))
    starts = units.select(KEY, CHUNK, "_unit", "_rows", in_block.alias("_in_block")).join(blocks, [KEY, CHUNK]).select(
        KEY, "_unit", (F.coalesce("_block_start", F.lit(0)) + F.coalesce("_in_block", F.lit(0))).alias("_start"), "_total", "_rows"
    )
    inside = Window.partitionBy(KEY, "_unit").orderBy(TS, *tie_break)
    ranked = lambda part, marks: part.join(marks.drop("_rows"), [KEY, "_unit"]).withColumn(position, F.col("_start") + F.row_number().over(inside) - 1)
    wide = units.where(F.col("_rows") > unit_rows)
    if wide.isEmpty():
        placed = ranked(rows, starts)
    else:
        wide = materialise(wide.select(KEY, "_unit"))
        few = ranked(rows.join(wide, [KEY, "_unit"], "left_anti"), starts.where(F.col("_rows") <= unit_rows))
        cut = _cut_units(rows.join(wide, [KEY, "_unit"], "left_semi"), tie_break)
        many = attach(cut, starts.where(F.col("_rows") > unit_rows).drop("_rows"), [KEY, "_unit"]).withColumn(position, F.col("_start") + F.col("_nth")).drop("_nth")
        placed = few.unionByName(many)
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_unit", "_start", "_total")


def _cut_units(rows: DataFrame, tie_break: list[str]) -> DataFrame:
    """``rows`` with ``_nth``, their place in their unit, for units that no task should hold whole.

    A range exchange cuts them, by sampled counts, wherever a part gets too long: by time, then by the tie-break, then between rows that are
    alike in all of it. Numbers of rows are given out part by part; the parts of a unit are few, and their counts are summed up.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [KEY, "_unit", TS, *tie_break, "_tie"]
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    numbered = materialise(sorted_.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    counts = numbered.groupBy(KEY, "_unit", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(KEY, "_unit").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(KEY, "_unit", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return attach(numbered, offsets, [KEY, "_unit", "_part"]).withColumn("_nth", F.col("_before") + F.col("_row") - F.col("_first")).drop("_before", "_row", "_first", "_part")
