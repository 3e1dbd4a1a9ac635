"""Hourly means, the gap-free grid and limited interpolation in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHUNK_HOURS, FILL_LIMIT, KEY, MEASURES, TS
from .chunks import CHUNK, chunk_of

_HOUR_US = 3_600_000_000


def bucket_mean(df: DataFrame, unit: str = "hour", measures: Sequence[str] = MEASURES) -> DataFrame:
    """Mean of the readings of each series in each calendar hour (or day)."""
    return df.groupBy(KEY, F.date_trunc(unit, F.col(TS)).alias(TS)).agg(*[F.avg(m).alias(m) for m in measures])


def merge_sources(frames: Sequence[DataFrame], measures: Sequence[str] = MEASURES) -> DataFrame:
    """Union of per-source series; an instant in several sources gets the unweighted mean of them."""
    if not frames:
        raise ValueError("no source to merge")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged.groupBy(KEY, TS).agg(*[F.avg(m).alias(m) for m in measures])


def _reading(measure: str) -> str:
    return f"if({measure} is not null, struct(_us as at, {measure} as v), null)"


def _rows_by_chunk(df: DataFrame, measures: Sequence[str], chunk_hours: int) -> DataFrame:
    return (
        df.select(KEY, F.unix_micros(TS).alias("_us"), chunk_of(F.col(TS), chunk_hours).alias(CHUNK), *measures)
        .where(F.col(KEY).isNotNull() & F.col("_us").isNotNull())
    )


def _chunk_table(rows: DataFrame, measures: Sequence[str], chunk_hours: int) -> DataFrame:
    """One row per chunk in the span of each series, chunks without data included.

    Holds first and last grid instant of the chunk and, per measure, the nearest reading before and after it.
    The windows run over chunk summaries only: four rows a year for one series at the default length.
    """
    # Number and instant apart: aggregates of plain numbers are hashed, those of structs would need a sort.
    aggs = [F.min("_us").alias("_lo"), F.max("_us").alias("_hi")]
    for m in measures:
        at = f"if({m} is not null, _us, null)"
        for end, pick in (("first", "min"), ("last", "max")):
            aggs += [F.expr(f"{pick}({at}) as _{end}_at_{m}"), F.expr(f"{pick}_by({m}, {at}) as _{end}_v_{m}")]
    ends = [
        f"if(_{end}_at_{m} is not null, struct(_{end}_at_{m} as at, _{end}_v_{m} as v), null) as _{end}_{m}"
        for m in measures for end in ("first", "last")
    ]
    summary = rows.groupBy(KEY, CHUNK).agg(*aggs).selectExpr(KEY, CHUNK, "_lo", "_hi", *ends)
    series, order = f"partition by {KEY}", f"partition by {KEY} order by {CHUNK}"
    earlier = f"({order} rows between unbounded preceding and 1 preceding)"
    spread = summary.selectExpr(
        KEY, f"{CHUNK} as _own", f"lead({CHUNK}) over ({order}) as _next",
        f"min(_lo) over ({series}) as _start", f"max(_hi) over ({series}) as _end",
        *[f"_last_{m}" for m in measures],
        *[f"last_value(_last_{m}) ignore nulls over {earlier} as _before_{m}" for m in measures],
        *[f"lead(_first_{m}) ignore nulls over ({order}) as _after_{m}" for m in measures],
    ).selectExpr("*", f"explode(sequence(_own, coalesce(_next - 1, _own))) as {CHUNK}")
    step = chunk_hours * _HOUR_US
    nearest = [
        f"if({CHUNK} = _own, _before_{m}, coalesce(_last_{m}, _before_{m})) as before_{m}, _after_{m} as after_{m}"
        for m in measures
    ]
    edges = (
        f"greatest(_start, {CHUNK} * {step} + pmod(_start, {_HOUR_US})) as first",
        f"least(_end, ({CHUNK} + 1) * {step} - 1) as last",
    )
    table = spread.selectExpr(KEY, CHUNK, f"struct({', '.join([*edges, *nearest])}) as _info")
    return table.where("_info.first <= _info.last")


def _hours(df: DataFrame, measures: Sequence[str], chunk_hours: int, limit: int | None) -> DataFrame:
    """Every hour of every series. ``limit`` None leaves the hours without data empty.

    Each chunk gets a marker row ahead of its data rows, and one exchange and one sort bring both together.
    A row is then expanded to the hours from it until the next row. All hours of such a stretch have the
    same neighbours, so these are looked up per row, before expanding.
    """
    rows = _rows_by_chunk(df, measures, chunk_hours)
    markers = _chunk_table(rows, measures, chunk_hours).select(
        KEY, CHUNK, F.col("_info.first").alias("_us"), F.lit(0).alias("_kind"), "_info"
    )
    data = rows.withColumn("_kind", F.lit(1))
    together = markers.unionByName(data, allowMissingColumns=True).repartition(KEY, CHUNK)

    order = f"partition by {KEY}, {CHUNK} order by _us, _kind"
    so_far = f"({order} rows between unbounded preceding and current row)"
    known = together.selectExpr(
        KEY, CHUNK, "_us", "_kind", *measures, f"last_value(_info) ignore nulls over {so_far} as _info"
    ).where(f"pmod(_us - _info.first, {_HOUR_US}) = 0")
    neighbours = [] if limit is None else [
        e for m in measures for e in (
            f"last_value({_reading(m)}) ignore nulls over {so_far} as _prev_{m}",
            f"lead({_reading(m)}) ignore nulls over ({order}) as _next_{m}",
        )
    ]
    stretches = known.selectExpr(
        "*", f"coalesce(lead(_us) over ({order}), _info.last + {_HOUR_US}) - {_HOUR_US} as _until", *neighbours
    ).where("_until >= _us")
    hours = stretches.selectExpr("*", f"explode(sequence(_us, _until, {_HOUR_US})) as _hour")
    own = [f"if(_hour = _us, {m}, null) as {m}" for m in measures]
    if limit is not None:
        ends = [e for m in measures for e in (
            f"coalesce(_prev_{m}, _info.before_{m}) as _p_{m}", f"coalesce(_next_{m}, _info.after_{m}) as _n_{m}")]
        hours = hours.selectExpr(KEY, "_us", "_hour", *measures, *ends)
        own = [_line(m, limit) for m in measures]
    return hours.selectExpr(KEY, f"timestamp_micros(_hour) as {TS}", *own)


def _line(m: str, limit: int) -> str:
    past, rise, run = f"(_hour - _p_{m}.at)", f"(_n_{m}.v - _p_{m}.v)", f"(_n_{m}.at - _p_{m}.at)"
    return f"""case when _hour = _us and {m} is not null then {m}
        when _p_{m} is null or {past} > {limit * _HOUR_US} then null
        when _n_{m} is null then _p_{m}.v
        else _p_{m}.v + {rise} * ({past} / {run}) end as {m}"""


def reindex_hourly(
    df: DataFrame, measures: Sequence[str] = MEASURES, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    """Every hour from first to last instant of a series, with its data. Rows off the hourly grid vanish.

    Input is unique on ``(series_id, ts)``; run :func:`bucket_mean` first.
    """
    return _hours(df, measures, chunk_hours, None)


def reindex_and_fill(
    df: DataFrame, limit: int = FILL_LIMIT, measures: Sequence[str] = MEASURES, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    """Hourly grid whose gaps are filled on the straight line in time between their neighbours.

    At most ``limit`` hours after a valid reading are filled, so a long gap is filled in part. After the
    last reading its value is held for ``limit`` hours; hours before the first stay NULL.
    """
    return _hours(df, measures, chunk_hours, limit)


def daily_means(df: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Mean per calendar day; days without readings are kept as NULL rows."""
    means = bucket_mean(df, "day", measures).withColumn("_day", F.col(TS).cast("date")).drop(TS)
    days = (
        means.groupBy(KEY).agg(F.min("_day").alias("_a"), F.max("_day").alias("_b"))
        .select(KEY, F.explode(F.sequence("_a", "_b")).alias("_day"))
    )
    return days.join(means, [KEY, "_day"], "left").select(KEY, F.col("_day").cast("timestamp").alias(TS), *measures)
