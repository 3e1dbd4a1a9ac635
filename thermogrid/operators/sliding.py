"""Supervised sliding windows over consecutive rows of a series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEY, TS
from .chunks import with_position


@dataclass(frozen=True)
class WindowShape:
    """``input_width`` rows in, then labels: the last ``label_width`` of the ``shift`` rows that follow."""

    input_width: int
    label_width: int
    shift: int

    @property
    def total(self) -> int:
        return self.input_width + self.shift

    @property
    def label_start(self) -> int:
        return self.total - self.label_width


def sliding_windows(
    df: DataFrame,
    shape: WindowShape,
    features: Sequence[str],
    labels: Sequence[str],
    tie_break: list[str],
    chunk_rows: int = 4096,
    unit_seconds: int = 60,
) -> DataFrame:
    """One row per window start: ``inputs`` (array of structs) and ``labels`` (array of structs).

    Windows follow row position, whatever the gaps in time. Rows near the end of a block of positions
    are what the block before it looks ahead to, so they are copied there.
    """
    reach = shape.total - 1
    if reach > chunk_rows:
        raise ValueError("a block of rows must be at least as long as a window")
    placed = with_position(df, tie_break, unit_seconds, "pos")
    own = F.floor(F.col("pos") / chunk_rows)
    homes = F.array_compact(F.array(own, F.when((F.col("pos") % chunk_rows < reach) & (own > 0), own - 1)))
    columns = list(dict.fromkeys([*features, *labels]))
    spread = placed.select(
        KEY, "pos", TS, F.struct(*columns).alias("_row"), F.explode(homes).alias("_block"),
    )
    ahead = Window.partitionBy(KEY, "_block").orderBy("pos").rowsBetween(0, reach)
    windows = spread.select(KEY, "pos", TS, "_block", F.collect_list("_row").over(ahead).alias("_rows")).where(
        (F.floor(F.col("pos") / chunk_rows) == F.col("_block")) & (F.size("_rows") == shape.total)
    )
    pick = lambda names: (lambda r: F.struct(*[r[c].alias(c) for c in names]))
    return windows.select(
        KEY, F.col("pos").alias("start_pos"), F.col(TS).alias("start_ts"),
        F.transform(F.slice("_rows", 1, shape.input_width), pick(features)).alias("inputs"),
        F.transform(F.slice("_rows", shape.label_start + 1, shape.label_width), pick(labels)).alias("labels"),
    )
