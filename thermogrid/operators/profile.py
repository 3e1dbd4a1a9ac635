"""Column statistics, outliers, histograms, missing values and data documentation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import above_other, out_of_range
from ..schema import PROFILE_BOUNDS, TS, Bounds
from ..session import materialise
from .quantiles import cut_points, quantiles_of_groups
from .scalars import attach, attach_row

# Quartiles and the fence factor of the box-plot rule.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
FENCE = 1.5
# Profiled columns and the names they are reported under.
PROFILED = {
    "temp_lag0": "temp", "dew_lag0": "dew", "dew_depression_lag0": "dew_depression",
    "temp_roll_mean_24h": "temp_roll_mean_24h",
}
HISTOGRAM_BINS = 30
MAX_LISTED_VALUES = 10
DIGEST_LENGTH = 60


def to_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Wide to long: ``by``, ``variable``, ``value``."""
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "variable", "value"
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _fences(low: Column, high: Column) -> tuple[Column, Column]:
    reach = (high - low) * F.lit(FENCE)
    return low - reach, high + reach


def _outliers(long: DataFrame, quartiles: DataFrame, by: list[str]) -> DataFrame:
    """Values strictly outside the quartile fences, and the extremes inside them."""
    low, high = _fences(F.col("q25"), F.col("q75"))
    value = F.col("value")
    inside = value.between(low, high)
    return attach(long, quartiles, by).groupBy(*by).agg(
        F.count_if(~inside).alias("outlier_count"),
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
    )


def _summaries(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """All statistics of each group of a long table.

    Four passes of map-side aggregates: moments and cuts, ranks of parts, the few values to sort, fences. Rows aren't exchanged, so
    pass a table, or rows that were written out.
    """
    by = list(by)
    heads = materialise(long.groupBy(*by).agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nan_count"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        cut_points("value").alias("_cuts"),
    ))
    quartiles = materialise(quantiles_of_groups(long, heads, by, "value", QUARTILES).drop("n"))
    located = heads.drop("_cuts").join(quartiles, by, "left") if by else attach_row(heads.drop("_cuts"), quartiles)
    return attach(located, _outliers(long, quartiles, by), by, "left")


def column_stats(long: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """Count, moments, quartiles, range, missing share and outliers of each group of a long table.

    A group without values gets zeros and 100 % missing.
    """
    by = list(by)
    empty = F.col("n") == 0
    zero = lambda c: F.when(empty, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    share = F.col("nan_count") / F.nullif(F.col("nan_count") + F.col("n"), F.lit(0)) * 100.0
    return _summaries(long, by).select(
        *by, F.col("n").alias("count"),
        zero("mean"), zero("std"), zero("min"), zero("q25"), zero("median"), zero("q75"), zero("max"),
        "nan_count", F.when(empty, F.lit(100.0)).otherwise(share).alias("nan_pct"),
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"),
        F.when(empty, F.lit(0.0)).otherwise(F.col("outlier_count") / F.nullif(F.col("n"), F.lit(0)) * 100.0)
        .alias("outlier_pct"),
    )


def outlier_counts(long: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """Values outside the fences of 1.5 quartile ranges, and their share in percent."""
    summary = _summaries(long, by).where("n > 0")
    return summary.select(*by, "outlier_count", (F.col("outlier_count") / F.col("n") * 100.0).alias("outlier_pct"))


def box_plot(long: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """Five numbers of a box plot: whiskers inside the fences, quartiles, and the outliers beyond."""
    return _summaries(long, by).where("n > 0").select(
        *by, "n", "whisker_low", "q25", "median", "q75", "whisker_high", "outlier_count"
    )


def bad_values(
    df: DataFrame, bounds: Bounds = PROFILE_BOUNDS, by: Sequence[str] = (), also: Sequence[Column] = ()
) -> DataFrame:
    """Rows with any missing cell, readings out of bounds, and dew points above temperature.

    ``also`` are further aggregates to take in the same pass.
    """
    any_missing = F.expr(" or ".join(f"`{c}` is null" for c in df.columns if c not in by))
    outside = lambda m: F.count_if(out_of_range(F.col(m), *bounds.of(m))) if m in df.columns else F.lit(0)
    both = {"temp", "dew"} <= set(df.columns)
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(any_missing).alias("nan_rows"),
        outside("temp").alias("bad_temp_count"),
        outside("dew").alias("bad_dew_count"),
        (F.count_if(above_other(F.col("dew"), F.col("temp"))) if both else F.lit(0)).alias("dew_above_temp_count"),
        *also,
    )
    share = F.col("nan_rows") / F.nullif(F.col("total_records"), F.lit(0)) * 100.0
    return counted.withColumn("nan_row_pct", F.coalesce(share, F.lit(0.0)))


def bad_values_total(per_split: DataFrame) -> DataFrame:
    return per_split.agg(*[
        F.sum(c).alias(c) for c in ("bad_temp_count", "bad_dew_count", "dew_above_temp_count")
    ])


def histogram(
    long: DataFrame,
    by: Sequence[str] = ("variable",),
    bins: int = HISTOGRAM_BINS,
    range_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equal-width bins of ``value`` per group: ``bin``, ``center``, ``count``, ``density``.

    The range is that of the groups named by ``range_by`` (default: each group its own), so several groups
    can share bin edges. The last bin includes its upper edge; a constant group gets a range of width 1.
    Bins without values are kept with count 0.
    """
    by = list(by)
    range_by = by if range_by is None else list(range_by)
    values = long.where(F.col("value").isNotNull())
    ends = values.groupBy(*range_by).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(
        *range_by,
        F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_lo"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_hi"),
    )
    place = lambda left: attach(left, ends, range_by)
    # The scaled place can be off by one next to an edge; the edges themselves decide.
    edge = lambda i: F.col("_lo") + i * ((F.col("_hi") - F.col("_lo")) / bins)
    guess = F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    at, value = F.col("_at"), F.col("value")
    number = (
        F.when(value < edge(at), at - 1).when((value >= edge(at + 1)) & (at != bins - 1), at + 1).otherwise(at)
    )
    counted = (
        place(values).withColumn("_at", guess).groupBy(*by, number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    groups = counted.groupBy(*by).agg(F.sum("count").alias("_n"))
    frame = place(groups).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return frame.join(counted, [*by, "bin"], "left").select(
        *by, "bin",
        (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("center"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("_n")).alias("density"),
    )


def numeric_histograms(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Histogram of every numeric column of a table."""
    return histogram(to_long(df, numeric_columns(df)), ("variable",), bins)


def missing_share(df: DataFrame) -> DataFrame:
    """Percentage of missing cells of each column that has any, most first."""
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in df.columns])
    return (
        shares.unpivot([], df.columns, "variable", "missing_pct")
        .where(F.col("missing_pct") > 0).orderBy(F.desc("missing_pct"), "variable")
    )


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    return "date" if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "text"


def document_columns(df: DataFrame, max_listed: int = MAX_LISTED_VALUES) -> DataFrame:
    """Type and content of each column: ``variable, kind, low, high, distinct, listed``.

    Numbers and dates get their range. Other columns get their number of values, and the values
    themselves (sorted, joined) where there are at most ``max_listed``; those lists are only collected
    after counting. Long values are counted by their digest, so that whole texts aren't exchanged.
    """
    return document_tables({"": df}, max_listed).drop("source")


def document_tables(tables: Mapping[str, DataFrame], max_listed: int = MAX_LISTED_VALUES) -> DataFrame:
    """:func:`document_columns` of several tables, each row with its table's name as ``source``.

    The cells of all tables are counted and listed together: with a plan for each table Spark lays the last, smallest
    steps of all plans into one task, which then holds the buffers of every sort and map of every table.
    """
    by = ["source", "variable"]
    parts, cells, names = [], [], []
    for source, df in tables.items():
        kind = {f.name: _kind(f.dataType) for f in df.schema.fields}
        ranged = [c for c, k in kind.items() if k != "text"]
        texts = [c for c, k in kind.items() if k == "text"]
        if ranged:
            show = lambda c, e: F.date_format(e, "yyyy-MM-dd") if kind[c] == "date" else e.cast("double").cast("string")
            row = df.agg(*[
                F.struct(
                    F.lit(source).alias("source"), F.lit(c).alias("variable"), F.lit(kind[c]).alias("kind"),
                    show(c, F.min(c)).alias("low"), show(c, F.max(c)).alias("high"),
                ).alias(c) for c in ranged
            ])
            parts.append(row.select(F.inline(F.array(*ranged))).select(
                "*", F.lit(None).cast("long").alias("distinct"), F.lit(None).cast("string").alias("listed")
            ))
        if texts:
            cells.append(
                df.select(*[F.col(c).cast("string").alias(c) for c in texts]).unpivot([], texts, "variable", "value")
                .where(F.col("value").isNotNull()).select(F.lit(source).alias("source"), "variable", "value")
            )
            names += [F.struct(F.lit(source).alias("source"), F.lit(c).alias("variable")) for c in texts]
    if cells:
        cells = reduce(DataFrame.unionByName, cells)
        long = F.length("value") > DIGEST_LENGTH
        digest = F.when(long, F.sha2(F.col("value").cast("binary"), 256)).otherwise(F.col("value"))
        # a digest is longer than any value that stands for itself
        values = cells.select(*by, digest.alias("value")).distinct()
        sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct"), F.count_if(long).alias("_long"))
        # At most one row per column of the tables.
        short = sizes.where(F.col("distinct") <= max_listed)
        of_columns = lambda rows, columns: rows.join(F.broadcast(columns.select(*by)), by)
        # Only long values are read again; where no short list has any, Spark leaves that pass out. Digests become null
        # and aren't filtered, as a filter would move below the distinct values and make them differ from those counted.
        listed = of_columns(values, short).withColumn("value", F.when(~long, F.col("value"))).unionByName(
            of_columns(cells.where(long), short.where("_long > 0")).distinct()
        )
        # Columns without values have no rows to count: every column is described.
        every = cells.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*names)))
        zero, none = F.lit(0).cast("long").alias("distinct"), F.lit(None).cast("string").alias("value")
        counted = every.select(*by, zero).unionByName(sizes.select(*by, "distinct")).select("*", none)
        found = counted.unionByName(listed.select("*", zero)).groupBy(*by).agg(
            F.max("distinct").alias("distinct"), F.array_sort(F.collect_list("value")).alias("_values")
        )
        parts.append(found.select(
            *by, F.lit("text").alias("kind"), F.lit(None).cast("string").alias("low"),
            F.lit(None).cast("string").alias("high"), "distinct",
            F.when(F.size("_values") > 0, F.array_join("_values", ", ")).alias("listed"),
        ))
    return reduce(DataFrame.unionByName, parts)


def daily_sanity(df: DataFrame, high: str = "TMAX", low: str = "TMIN", mean: str = "TAVG") -> DataFrame:
    """Counts of days whose values contradict each other or are extreme."""
    return df.agg(
        F.count_if(F.col(high) < F.col(low)).alias("high_below_low"),
        F.count_if((F.col(mean) < F.col(low)) | (F.col(mean) > F.col(high))).alias("mean_out_of_range"),
        F.count_if(F.col(high) > 45).alias("extreme_high"),
        F.count_if(F.col(low) < -20).alias("extreme_low"),
    )


def sanity_examples(df: DataFrame, order: Sequence[str], high: str = "TMAX", low: str = "TMIN", n: int = 5) -> DataFrame:
    """The first few days whose maximum is below their minimum."""
    return df.where(F.col(high) < F.col(low)).select(*order, high, low).orderBy(*order).limit(n)


def split_periods(features: DataFrame, split: str = "split", bounds: Bounds = PROFILE_BOUNDS) -> DataFrame:
    """Rows, first and last instant, and bad values of each split, in one aggregate."""
    renamed = features.withColumnsRenamed({"temp_lag0": "temp", "dew_lag0": "dew"})
    period = (
        F.date_format(F.min(TS), "yyyy-MM-dd HH:mm").alias("start_date"),
        F.date_format(F.max(TS), "yyyy-MM-dd HH:mm").alias("end_date"),
    )
    return bad_values(renamed, bounds, [split], period).withColumn("records_count", F.col("total_records"))


def profiled_values(features: DataFrame, split: str = "split") -> DataFrame:
    """Long table of the key columns; written out, since statistics and histograms pass over it repeatedly."""
    columns = {c: PROFILED[c] for c in PROFILED if c in features.columns}
    narrow = materialise(features.select(split, *[F.col(c).alias(n) for c, n in columns.items()]))
    return to_long(narrow, list(columns.values()), [split])


def split_histograms(long: DataFrame, split: str = "split") -> DataFrame:
    """Temperature and dew point; bin edges of one column are shared by all splits."""
    return histogram(long.where(F.col("variable").isin("temp", "dew")), [split, "variable"], range_by=["variable"])


def split_profile(features: DataFrame, split: str = "split", bounds: Bounds = PROFILE_BOUNDS) -> dict[str, DataFrame]:
    """Periods, bad values, statistics and histograms of the key columns of each split, as long tables."""
    long = profiled_values(features, split)
    return {
        "periods": split_periods(features, split, bounds),
        "statistics": column_stats(long, [split, "variable"]),
        "histograms": split_histograms(long, split),
    }


def split_report(profile: dict[str, DataFrame], split: str = "split") -> DataFrame:
    """One nested row per split from the tables of :func:`split_profile`, for the JSON sink.

    Numbers are rounded as reports show them: two decimals, four for densities, ties to even.
    """
    two = lambda c: F.bround(c, 2).alias(c)
    stats = profile["statistics"].select(
        split, "variable", F.struct(
            "count", *[two(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")],
            "nan_count", two("nan_pct"), "outlier_count", two("outlier_pct"),
        ).alias("entry"),
    )
    bins = profile["histograms"].groupBy(split, "variable").agg(
        F.array_sort(F.collect_list(F.struct("bin", "center", "count", "density"))).alias("_bins")
    ).select(split, "variable", F.struct(
        F.transform("_bins", lambda b: F.bround(b["center"], 2)).alias("bin_centers"),
        F.transform("_bins", lambda b: b["count"]).alias("counts"),
        F.transform("_bins", lambda b: F.bround(b["density"], 4)).alias("density"),
    ).alias("entry"))
    as_map = lambda df, name: df.groupBy(split).agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "entry"))).alias(name)
    )
    bad = ["total_records", "nan_rows", "nan_row_pct", "bad_temp_count", "bad_dew_count", "dew_above_temp_count"]
    periods = profile["periods"].withColumn("nan_row_pct", F.bround("nan_row_pct", 2))
    return (
        periods.select(split, "records_count", "start_date", "end_date", F.struct(*bad).alias("bad_values"))
        .join(as_map(stats, "statistics"), split)
        .join(as_map(bins, "histograms"), split)
    )
