"""Exact quantiles of large groups.

Spark's ``percentile`` holds every distinct value of a group in one task. Here approximate quantiles cut each group into
parts, a map-side count of the parts tells which of them hold a wanted rank, and only the values of those are exchanged. A part
with more distinct values than one task should sort is cut again. Where the counts of the first pass show that there is little to exchange, all
values are, in one step. Cuts decide only how work is spread: ranks come from exact counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .scalars import attach_row

PARTS = 64
#: Distinct values that one task sorts at most.
BOUND = 1 << 20
#: Values of all groups together up to which they are exchanged at once, if no group has more than ``BOUND``.
DIRECT = 1 << 24


def cut_points(value: str, parts: int = PARTS) -> Column:
    """Aggregate: values that cut a group into about equal parts."""
    if parts < 2 or parts & (parts - 1):
        raise ValueError("the number of parts must be a power of two")
    return F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000)


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], parts: int = PARTS, bound: int = BOUND, direct: int = DIRECT
) -> DataFrame:
    """One row per group with ``n`` and each named quantile, linear between the two nearest ranks.

    ``shares`` maps output names to fractions, e.g. ``{"median": 0.5}``. NULL values are ignored; groups
    without values are absent. ``df`` is read three times: pass a table, or rows that were written out.
    """
    heads = materialise(df.groupBy(*by).agg(F.count(value).alias("n"), cut_points(value, parts).alias("_cuts")))
    return quantiles_of_groups(df, heads, by, value, shares, parts, bound, direct)


def quantiles_of_groups(
    df: DataFrame, heads: DataFrame, by: Sequence[str], value: str, shares: dict[str, float],
    parts: int = PARTS, bound: int = BOUND, direct: int = DIRECT,
) -> DataFrame:
    """Exact quantiles where a written table ``heads`` has ``n`` and ``_cuts`` (see :func:`cut_points`) of each group already."""
    by = list(by)
    live, cells = sorted_cells(df, heads, by, value, shares, parts, bound, direct)
    inside = Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        live.join(cells, [*by, "_cell"])
        .withColumn("_end", F.col("_from") + F.sum("_c").over(inside))
        .withColumn("_rank", F.explode(F.filter(
            "_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c"))
        )))
    )
    out = hits.groupBy(*by).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )
    quantile = []
    for name, p in shares.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col("_at")[F.floor(place)], F.col("_at")[F.ceil(place)]
        quantile.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return out.select(*by, "n", *quantile)


def sorted_cells(
    df: DataFrame, heads: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], parts: int, bound: int, direct: int = DIRECT
) -> tuple[DataFrame, DataFrame]:
    """``(*by, _cell, _v, _c)``: counted values of the cells that hold a wanted rank, at most ``bound`` of them in a cell;
    and ``(*by, _cell, n, _from, _ranks)``: how many values precede a cell, and the ranks in it."""
    by = list(by)
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("n") - 1) * F.lit(float(p))), F.ceil((F.col("n") - 1) * F.lit(float(p))))
        for p in shares.values()
    ])))
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.lit(1).cast("long").alias("_c"))
    cells = heads.where("n > 0").select(*by, "n", "_cuts", F.lit(0).cast("long").alias("_from"), ranks.alias("_ranks"))
    sizes = heads.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (sizes["most"] or 0) <= bound and (sizes["all"] or 0) <= direct:  # a group is one cell
        whole = rows.groupBy(*by, "_v").agg(F.sum("_c").alias("_c")).withColumn("_cell", F.lit(0).cast("long"))
        return whole, cells.withColumn("_cell", F.lit(0).cast("long")).drop("_cuts")
    live, cells = _narrow(rows, cells, by, [], parts)
    while _largest(live, by) > bound:
        # values are distinct within a group by now, so every round makes the largest cell smaller
        cuts = live.groupBy(*by, "_cell").agg(cut_points("_v", parts).alias("_cuts"))
        live, cells = _narrow(live, materialise(cells.join(cuts, [*by, "_cell"])), by, ["_cell"], parts)
    return live, cells


def _largest(live: DataFrame, by: list[str]) -> int:
    sizes = live.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_size"))
    return sizes.agg(F.max("_size")).first()[0] or 0


def _with(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Join a written table, whose size is known when the join is planned."""
    return df.join(table, keys) if keys else attach_row(df, table)


def _narrow(rows: DataFrame, cells: DataFrame, by: list[str], cell: list[str], parts: int) -> tuple[DataFrame, DataFrame]:
    """Cut cells into parts and keep those that hold a wanted rank; each becomes a cell."""
    keys = [*by, *cell]
    placed = _place(_with(rows, cells.select(*keys, "_cuts"), keys), parts)
    order = Window.partitionBy(*keys).orderBy("_part")
    counted = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_in"))
    within = F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_to")))
    name = F.col("_part").cast("long")
    needed = materialise(
        _with(counted, cells.select(*keys, "n", "_from", "_ranks"), keys)
        .withColumn("_to", F.col("_from") + F.sum("_in").over(order))
        .withColumn("_from", F.col("_to") - F.col("_in"))
        .withColumn("_ranks", within).where(F.size("_ranks") > 0)
        .select(*keys, "_part", "n", "_from", "_ranks", (F.col("_cell") * parts + name if cell else name).alias("_next"))
    )
    kept = placed.join(needed.select(*keys, "_part", "_next"), [*keys, "_part"])
    live = kept.groupBy(*by, F.col("_next").alias("_cell"), "_v").agg(F.sum("_c").alias("_c"))
    return materialise(live), needed.select(*by, F.col("_next").alias("_cell"), "n", "_from", "_ranks")


def _place(df: DataFrame, parts: int) -> DataFrame:
    """Replace the sorted ``parts - 1`` cuts by ``_part``, the number of cuts below ``_v``: a binary search."""
    df, step = df.withColumn("_part", F.lit(0)), parts // 2
    while step:
        df = df.withColumn("_part", F.expr(f"_part + if(get(_cuts, _part + {step - 1}) < _v, {step}, 0)"))
        step //= 2
    return df.drop("_cuts")
