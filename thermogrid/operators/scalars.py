"""Bringing aggregates back to rows: scalar subqueries, and joins whose small side has a known size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (always one row) to every row."""
    value = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_one", value).select("*", "_one.*").drop("_one")


def attach(df: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Add per-key aggregates, or a global aggregate where there is no key.

    The aggregates are written out first. Spark then knows their size before it plans the join: a small table
    is broadcast and ``df`` is not shuffled by what may be very few, very large keys; a table over the
    broadcast threshold is joined by shuffle, with runtime splitting of large keys.
    """
    return df.join(materialise(table), by, how) if by else attach_row(df, table)
