"""Lag, rolling and calendar features and the targets of the day ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cyclic_calendar
from ..schema import CHUNK_HOURS, HORIZON, KEY, LAGS, ROLLING_WIDTHS, TS, feature_names, target_names
from .chunks import CHUNK, CORE, drop_halo, with_halo

# Expressions are SQL text here: a feature row has about 100 columns, and building each of them through
# Python column objects costs more than running the job on a small table.
_OVER = f"over (partition by {KEY}, {CHUNK} order by {TS})"
MOST_PIECES = 8
READ_WIDTH = 64  # hours that a window read row by row covers at most
_STATE = ("n", "mean", "m2", "lo", "hi", "dn", "dmean")


def _lag_exprs(lags: Sequence[int]) -> list[str]:
    back = lambda c, k: f"lag({c}, {k}) {_OVER}" if k else c
    out = [f"{back(c, k)} as {c}_lag{k}" for c in ("temp", "dew") for k in lags]
    return out + [f"{back('temp', k)} - {back('dew', k)} as dew_depression_lag{k}" for k in lags]


def _lead_exprs(horizon: int) -> list[str]:
    return [f"lead(temp, {h}) {_OVER} as target_h{h}" for h in range(1, horizon + 1)]


def _direct_state(width: int) -> list[str]:
    over = f"{_OVER[:-1]} rows between {width} preceding and 1 preceding)"
    return [
        f"count(temp) {over} as _n{width}",
        f"avg(temp) {over} as _mean{width}",
        f"var_pop(temp) {over} * count(temp) {over} as _m2{width}",
        f"min(temp) {over} as _lo{width}",
        f"max(temp) {over} as _hi{width}",
        f"count(dew) {over} as _dn{width}",
        f"avg(dew) {over} as _dmean{width}",
    ]


def _join_pieces(df: DataFrame, w: int, pieces: list[tuple[int, int]]) -> DataFrame:
    """State of a wide window from the states of narrower ones, by the parallel variance formula."""
    kept, each = df.columns, range(len(pieces))
    lagged = [
        f"lag(_{s}{size}, {back}) {_OVER} as _{s}_{i}" if back else f"_{s}{size} as _{s}_{i}"
        for i, (size, back) in enumerate(pieces) for s in _STATE
    ]
    total = lambda term: " + ".join(f"coalesce({term.format(i=i)}, 0)" for i in each)
    df = df.selectExpr("*", *lagged).selectExpr("*", f"{total('_n_{i}')} as _n{w}", f"{total('_dn_{i}')} as _dn{w}")
    df = df.selectExpr(
        "*",
        f"try_divide({total('_n_{i} * _mean_{i}')}, _n{w}) as _mean{w}",
        f"try_divide({total('_dn_{i} * _dmean_{i}')}, _dn{w}) as _dmean{w}",
    )
    apart = f"(_mean_{{i}} - _mean{w})"
    return df.selectExpr(
        *kept, f"_n{w}", f"_mean{w}", f"{total(f'_m2_{{i}} + _n_{{i}} * {apart} * {apart}')} as _m2{w}",
        f"least({', '.join(f'_lo_{i}' for i in each)}) as _lo{w}",
        f"greatest({', '.join(f'_hi_{i}' for i in each)}) as _hi{w}",
        f"_dn{w}", f"_dmean{w}",
    )


def _rolling_exprs(w: int) -> list[str]:
    enough = f"_n{w} >= {max(1, w // 2)}"
    std = f"case when _n{w} < 2 then null when _lo{w} = _hi{w} then 0D else sqrt(_m2{w} / (_n{w} - 1)) end"
    stats = {"mean": f"_mean{w}", "min": f"_lo{w}", "max": f"_hi{w}", "std": std, "range": f"_hi{w} - _lo{w}"}
    out = [f"if({enough}, {e}, null) as temp_roll_{s}_{w}h" for s, e in stats.items()]
    return out + [f"if(_dn{w} >= {max(1, w // 2)}, _dmean{w}, null) as dew_roll_mean_{w}h"]


def _with_width(df: DataFrame, width: int, ready: list[int]) -> DataFrame:
    """Add the state of one width, and to ``ready`` what was built on the way."""
    if width in ready:
        return df
    narrower = [r for r in ready if r < width]
    if not narrower and width <= READ_WIDTH:
        df = df.selectExpr("*", *_direct_state(width))
    else:
        if not narrower:
            df = _with_width(df, READ_WIDTH // 4, ready)
            narrower = [READ_WIDTH // 4]
        size = max(narrower)
        while width // size > MOST_PIECES:
            if 2 * size not in ready:
                df = _join_pieces(df, 2 * size, [(size, 0), (size, size)])
                ready.append(2 * size)
            size *= 2
        count, rest = divmod(width, size)
        if rest:
            df = _with_width(df, rest, ready)
        df = _join_pieces(df, width, [(size, i * size) for i in range(count)] + [(rest, count * size)] * bool(rest))
    ready.append(width)
    return df


def _with_rolling_state(df: DataFrame, widths: Sequence[int]) -> DataFrame:
    """Window states of every width.

    Only narrow windows are read row by row: the narrowest, and what others leave of a width. A wide window is put together from a
    few narrower ones, which are doubled where it would take too many, so its cost does not grow with its width.
    """
    ready: list[int] = []
    for width in sorted(widths):
        df = _with_width(df, width, ready)
    return df


def lag_features(grid: DataFrame, lags: Sequence[int] = LAGS, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """``{measure}_lag{k}`` for both measures and the dew depression. ``grid`` must be hourly."""
    spread = with_halo(grid, max(lags), 0, chunk_hours)
    return drop_halo(spread.selectExpr(KEY, TS, CHUNK, CORE, *_lag_exprs(lags)))


def lead_targets(grid: DataFrame, horizon: int = HORIZON, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    spread = with_halo(grid, 0, horizon, chunk_hours)
    return drop_halo(spread.selectExpr(KEY, TS, CHUNK, CORE, *_lead_exprs(horizon)))


def rolling_features(
    grid: DataFrame, widths: Sequence[int] = ROLLING_WIDTHS, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    """Statistics of the previous ``w`` hours; NULL with fewer than half of them present."""
    state = _with_rolling_state(with_halo(grid, max(widths), 0, chunk_hours), widths)
    exprs = [e for w in widths for e in _rolling_exprs(w)]
    return drop_halo(state.selectExpr(KEY, TS, CHUNK, CORE, *exprs))


def calendar_features(df: DataFrame) -> DataFrame:
    return df.select(KEY, TS, *[c.alias(n) for n, c in cyclic_calendar(F.col(TS)).items()])


def summarise_targets(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Highest, lowest and mean target of the day ahead, over the targets present."""
    names = target_names(horizon)
    total = " + ".join(f"coalesce({c}, 0D)" for c in names)
    present = " + ".join(f"int({c} is not null)" for c in names)
    # A name twice serves a horizon of one: both functions skip NULLs and want two arguments.
    every = ", ".join([*names, names[0]])
    return df.selectExpr(
        "*", f"greatest({every}) as target_tmax", f"least({every}) as target_tmin",
        f"try_divide({total}, {present}) as target_tavg",
    )


def feature_matrix(
    grid: DataFrame,
    lags: Sequence[int] = LAGS,
    widths: Sequence[int] = ROLLING_WIDTHS,
    horizon: int = HORIZON,
    chunk_hours: int = CHUNK_HOURS,
    complete_only: bool = True,
) -> DataFrame:
    """Features, hourly targets and summary targets of every reference hour, in one row.

    Everything is computed from one exchange and one sort on ``(series_id, chunk)``. With
    ``complete_only`` rows with a missing feature or hourly target are dropped.
    """
    spread = with_halo(grid.select(KEY, TS, "temp", "dew"), max(*lags, *widths), horizon, chunk_hours)
    # The many lag and lead columns come last, so that the rolling windows buffer narrow rows.
    rolled = _with_rolling_state(spread, widths).selectExpr(
        KEY, TS, CHUNK, CORE, "temp", "dew", *[e for w in widths for e in _rolling_exprs(w)]
    )
    wide = rolled.selectExpr("*", *_lag_exprs(lags), *_lead_exprs(horizon)).where(F.col(CORE))
    names, targets = feature_names(lags, widths), target_names(horizon)
    out = wide.withColumns(cyclic_calendar(F.col(TS)))
    if complete_only:
        out = out.dropna(how="any", subset=names + targets)
    return summarise_targets(out, horizon).select(
        KEY, TS, *names, *targets, "target_tmax", "target_tmin", "target_tavg"
    )
