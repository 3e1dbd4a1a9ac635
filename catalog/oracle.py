"""DuckDB SQL that states what each registered query must return.

Plain whole-series windows and joins: the SQL knows nothing of chunks, halos or carried values.
"""

from __future__ import annotations

from thermogrid.schema import HORIZON, LAGS, ROLLING_WIDTHS, feature_names, target_names

from .inputs import BOUNDS as B
from .inputs import DATES as D
from .inputs import NUDGE
from .queries import PLATEAU, PROFILE_TABLES, WINDOW

SQL: dict[str, str] = {}


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr} + {NUDGE}, 6) AS \"{name or expr}\""


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def chain(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- common table expressions ---------------------------------------------------------------------------

OBS = """obs AS (SELECT event_type AS series_id, event_id, ts, value AS temp,
  value * CAST(0.6 AS DOUBLE) + event_id % 7 AS dew FROM events)"""


def _text(v):
    return f"concat('+', lpad(CAST(CAST(floor({v} * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR), 4, '0'), ',', CAST(event_id % 10 AS VARCHAR))"


ENC = f"enc AS (SELECT series_id, event_id, ts, {_text('temp')} AS tmp_raw, {_text('dew')} AS dew_raw FROM obs)"


def parsed(raw, strict=False):
    """Value of encoded text as an expression."""
    if strict:
        whole, codes = raw, "9999, -9999"
        shape = f"length({raw}) - length(replace({raw}, ',', '')) = 1"
        flag = f"substr({whole}, strpos({whole}, ',') + 1)"
    else:
        whole, codes, shape = f"trim({raw})", "9999, -9999, 999, -999", "true"
        flag = f"CASE WHEN strpos({whole}, ',') > 0 THEN substr({whole}, strpos({whole}, ',') + 1) ELSE '1' END"
    value = f"trim(split_part({whole}, ',', 1))"
    return f"""CASE WHEN {shape} AND regexp_full_match({value}, '[+-]?[0-9]+') AND {flag} NOT IN ('3', '7', '9')
      AND TRY_CAST({value} AS BIGINT) NOT IN ({codes}) THEN CAST(TRY_CAST({value} AS BIGINT) AS DOUBLE) / 10 END"""


DEC = f"dec AS (SELECT series_id, event_id, ts, {parsed('tmp_raw')} AS temp, {parsed('dew_raw')} AS dew FROM enc)"
DECODED = (OBS, ENC, DEC)


def ranged(src, out):
    t = f"CASE WHEN temp >= {B.temp_min} AND temp <= {B.temp_max} THEN temp END"
    d = f"CASE WHEN dew >= {B.dew_min} AND dew <= {B.dew_max} THEN dew END"
    return f"{out} AS (SELECT * REPLACE ({t} AS temp, {d} AS dew) FROM {src})"


def clamped(src, out):
    return f"{out} AS (SELECT * REPLACE (CASE WHEN dew > temp THEN temp ELSE dew END AS dew) FROM {src})"


def hourly(src, out, where="true"):
    return f"""{out} AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(temp) AS temp, avg(dew) AS dew
      FROM {src} WHERE {where} GROUP BY 1, 2)"""


def gridded(src, out):
    return f"""{out} AS (SELECT g.series_id, g.ts, s.temp, s.dew FROM (
        SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM {src} GROUP BY series_id
      ) g LEFT JOIN {src} s ON s.series_id = g.series_id AND s.ts = g.ts)"""


def filled(src, out, limit):
    past = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rest = "OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    marks, lines = [], []
    for c in ("temp", "dew"):
        at = f"CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END"
        marks += [
            f"last_value({c} IGNORE NULLS) {past} AS {c}_p", f"last_value({at} IGNORE NULLS) {past} AS {c}_pt",
            f"first_value({c} IGNORE NULLS) {rest} AS {c}_n", f"first_value({at} IGNORE NULLS) {rest} AS {c}_nt",
        ]
        lines.append(f"""CASE WHEN {c} IS NOT NULL THEN {c}
          WHEN {c}_pt IS NULL OR epoch_us(ts) - {c}_pt > {limit} * CAST(3600000000 AS BIGINT) THEN NULL
          WHEN {c}_nt IS NULL THEN {c}_p
          ELSE {c}_p + ({c}_n - {c}_p) * (CAST(epoch_us(ts) - {c}_pt AS DOUBLE) / CAST({c}_nt - {c}_pt AS DOUBLE)) END AS {c}""")
    return f"{out} AS (SELECT series_id, ts, {', '.join(lines)} FROM (SELECT *, {', '.join(marks)} FROM {src}))"


def cleaned(src, out, limit=6):
    """CTEs of the per-source cleaning sequence."""
    p = out
    return (
        ranged(src, f"{p}_r"), clamped(f"{p}_r", f"{p}_c"),
        hourly(f"{p}_c", f"{p}_h", "temp IS NOT NULL OR dew IS NOT NULL"),
        gridded(f"{p}_h", f"{p}_g"), filled(f"{p}_g", f"{p}_f", limit), clamped(f"{p}_f", out),
    )


def recleaned(src, out, limit=6):
    p = out
    return (
        ranged(src, f"{p}_r"), clamped(f"{p}_r", f"{p}_c"), gridded(f"{p}_c", f"{p}_g"),
        filled(f"{p}_g", f"{p}_f", limit), clamped(f"{p}_f", out),
    )


CLEAN = (OBS, *cleaned("obs", "clean"))
HOURS = "(PARTITION BY series_id ORDER BY ts)"


def lag_cols():
    back = lambda c, k: f"lag({c}, {k}) OVER {HOURS}" if k else c
    out = {f"{c}_lag{k}": back(c, k) for c in ("temp", "dew") for k in LAGS}
    out |= {f"dew_depression_lag{k}": back("(temp - dew)", k) for k in LAGS}
    return out


def lead_cols():
    return {f"target_h{h}": f"lead(temp, {h}) OVER {HOURS}" for h in range(1, HORIZON + 1)}


def roll_cols():
    out = {}
    for w in ROLLING_WIDTHS:
        over = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        stats = {
            "mean": f"avg(temp) {over}", "min": f"min(temp) {over}", "max": f"max(temp) {over}",
            "std": f"stddev_samp(temp) {over}", "range": f"max(temp) {over} - min(temp) {over}",
        }
        for s, e in stats.items():
            out[f"temp_roll_{s}_{w}h"] = f"CASE WHEN count(temp) {over} >= {w // 2} THEN {e} END"
        out[f"dew_roll_mean_{w}h"] = f"CASE WHEN count(dew) {over} >= {w // 2} THEN avg(dew) {over} END"
    return out


def cal_cols(ts="ts"):
    hour = f"hour({ts}) * (2.0 * pi()) / CAST(24.0 AS DOUBLE)"
    day = f"dayofyear({ts}) * (2.0 * pi()) / CAST(365.25 AS DOUBLE)"
    return {"sin_hour": f"sin({hour})", "cos_hour": f"cos({hour})", "sin_doy": f"sin({day})", "cos_doy": f"cos({day})"}


def select(cols):
    return ", ".join(f"{e} AS {n}" for n, e in cols.items())


def summary_cols(names):
    day = f"[{', '.join(names)}]"
    return {"target_tmax": f"list_max({day})", "target_tmin": f"list_min({day})", "target_tavg": f"list_avg({day})"}


ALL_X = lag_cols() | roll_cols() | cal_cols()
MATRIX = (
    *CLEAN,
    f"wide AS (SELECT series_id, ts, {select(ALL_X | lead_cols())} FROM clean)",
    f"""matrix AS (SELECT *, {select(summary_cols(target_names()))} FROM wide
      WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*feature_names(), *target_names()])})""",
)


def split_case(ts="ts"):
    return f"CASE WHEN {ts} < TIMESTAMP '{D.val_start}' THEN 'train' WHEN {ts} < TIMESTAMP '{D.test_start}' THEN 'val' ELSE 'test' END"


# --- readings -------------------------------------------------------------------------------------------

FORMS = """CASE event_id % 7 WHEN 0 THEN tmp_raw WHEN 1 THEN split_part(tmp_raw, ',', 1) WHEN 2 THEN concat(tmp_raw, ',extra')
  WHEN 3 THEN concat('  ', tmp_raw, ' ') WHEN 4 THEN concat(CAST(event_id % 50 AS VARCHAR), '.5,1')
  WHEN 5 THEN concat('-', lpad(CAST(event_id % 1000 AS VARCHAR), 4, '0'), ',', CAST(event_id % 10 AS VARCHAR))
  ELSE CASE event_id % 4 WHEN 0 THEN '9999,1' WHEN 1 THEN '-9999,1' WHEN 2 THEN '999,1' ELSE '' END END"""
SQL["parse_encoded_forms"] = chain(OBS, ENC, f"forms AS (SELECT event_id, {FORMS} AS raw FROM enc)") + (
    f"SELECT event_id, raw, {r(parsed('raw'), 'lenient')}, {r(parsed('raw', True), 'strict')} FROM forms"
)
SQL["range_null"] = chain(OBS, ranged("obs", "x")) + f"SELECT series_id, event_id, ts, {rs('temp', 'dew')} FROM x"
SQL["clamp"] = chain(OBS, clamped("obs", "x")) + f"SELECT series_id, event_id, ts, {rs('temp', 'dew')} FROM x"
SQL["cleaning_audit"] = chain(OBS, ranged("obs", "x")) + f"""
SELECT o.series_id, count(*) AS rows,
  count(*) FILTER (o.temp < {B.temp_min} OR o.temp > {B.temp_max}) AS temp_out_of_range,
  count(*) FILTER (o.dew < {B.dew_min} OR o.dew > {B.dew_max}) AS dew_out_of_range,
  count(*) FILTER (x.dew > x.temp) AS dew_above_temp
FROM obs o JOIN x USING (event_id) GROUP BY o.series_id"""
SQL["wind_parts"] = f"""SELECT event_id, {r("cos(radians(event_id % 360))", "wind_x")}, {r("sin(radians(event_id % 360))", "wind_y")} FROM events"""
SQL["diurnal"] = chain(
    OBS, "hours AS (SELECT unnest(generate_series(1, 24)) AS h)",
    """steps AS (SELECT event_id, CAST(h - 1 AS INTEGER) AS step, round(temp + sin((h - 9) * CAST(2.0 AS DOUBLE) * pi() / CAST(24.0 AS DOUBLE)) * CAST(4.5 AS DOUBLE)
      - (temp - dew) * CAST(0.15 AS DOUBLE), 1) AS temp FROM obs CROSS JOIN hours)""",
) + f"""SELECT event_id, {r('max(temp) OVER e', 'tmax')}, {r('min(temp) OVER e', 'tmin')}, {r('avg(temp) OVER e', 'tavg')}, step, {r('temp')}
FROM steps WINDOW e AS (PARTITION BY event_id)"""
_SHIFT = "l_shipdate + to_hours(l_linenumber)"


def hour_of_year(ts):
    return f"""CASE WHEN NOT (month({ts}) = 2 AND day({ts}) = 29)
      THEN (dayofyear(make_date(1999, CAST(month({ts}) AS INTEGER), CAST(day({ts}) AS INTEGER))) - 1) * 24 + hour({ts}) END"""


SQL["year_hours"] = f"""SELECT CAST(h AS INTEGER) AS hour, count(*) AS n,
  strftime(TIMESTAMP '1999-01-01' + to_hours(CAST(h AS INTEGER)), '%b %d %H:%M') AS label
FROM (SELECT {hour_of_year('t')} AS h FROM (SELECT {_SHIFT} AS t FROM lineitem)) GROUP BY h"""
SQL["future_stamps"] = """SELECT event_type AS series_id, date_trunc('hour', ts) + to_hours(h) AS target_ts, count(*) AS n
FROM events CROSS JOIN (SELECT CAST(unnest(generate_series(1, 24)) AS INTEGER) AS h) GROUP BY 1, 2"""

# --- series ---------------------------------------------------------------------------------------------

SERIES = f"SELECT series_id, ts, {rs('temp', 'dew')} FROM "
SQL["hourly_mean"] = chain(OBS, hourly("obs", "x")) + SERIES + "x"
SQL["hourly_grid"] = chain(*DECODED, hourly("dec", "h"), gridded("h", "x")) + SERIES + "x"
RARE = """rare AS (SELECT series_id, ts, CASE WHEN temp > 60 THEN temp END AS temp, CASE WHEN dew > 70 THEN dew END AS dew FROM obs)"""
SQL["interpolate_limited"] = chain(OBS, RARE, hourly("rare", "h"), gridded("h", "g"), filled("g", "x", 3)) + SERIES + "x"
SQL["source_clean"] = chain(*DECODED, *cleaned("dec", "x")) + SERIES + "x"
SQL["series_clean"] = chain(OBS, RARE, *cleaned("rare", "x", 2), *recleaned("x", "y", 2)) + SERIES + "y"
TWO = (
    "early AS (SELECT series_id, ts, temp, dew FROM dec WHERE ts < TIMESTAMP '2024-01-20')",
    "late AS (SELECT series_id, ts, temp, dew FROM obs WHERE ts >= TIMESTAMP '2024-01-10')",
)
MERGE = "merged AS (SELECT series_id, ts, avg(temp) AS temp, avg(dew) AS dew FROM (FROM {a} UNION ALL FROM {b}) GROUP BY 1, 2)"
SQL["source_merge_mean"] = chain(
    *DECODED, *TWO, hourly("early", "e"), hourly("late", "l"), MERGE.format(a="e", b="l")
) + SERIES + "merged"
SQL["combined_dataset"] = chain(
    *DECODED, *TWO, *cleaned("early", "e"), *cleaned("late", "l"), MERGE.format(a="e", b="l"), *recleaned("merged", "x")
) + SERIES + "x"
SQL["daily_resample"] = f"""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('day', ts) AS ts, avg(value) AS temp,
  avg(CASE WHEN value > 80 THEN value END) AS dew FROM events GROUP BY 1, 2),
g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d GROUP BY 1)
SELECT g.series_id, CAST(g.ts AS TIMESTAMP) AS ts, {rs('temp', 'dew')} FROM g LEFT JOIN d ON d.series_id = g.series_id AND d.ts = g.ts"""
SQL["daily_profile"] = chain(*DECODED, *cleaned("dec", "x")) + f"""SELECT series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS hours,
  count(temp) AS temp_hours, {r('avg(temp)', 'temp')}, {r('avg(dew)', 'dew')} FROM x GROUP BY series_id, date_trunc('day', ts)"""


def summary_sql(label, source):
    return f"""SELECT {label}, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
      {r('min(temp)', 'temp_min')}, {r('max(temp)', 'temp_max')}, {r('min(dew)', 'dew_min')}, {r('max(dew)', 'dew_max')},
      count(*) FILTER (dew > temp) AS dew_above_temp FROM {source} GROUP BY 1"""


SQL["dataset_summary"] = chain(*CLEAN) + summary_sql("series_id", "clean")

# --- files ----------------------------------------------------------------------------------------------

SQL["csv_encoded"] = chain(*DECODED) + f"SELECT 'all' AS series_id, ts, {rs('temp', 'dew')} FROM dec"
POOL = tuple(f"{n}_all AS (SELECT 'all' AS series_id, ts, temp, dew FROM {n})" for n in ("early", "late"))
SQL["folder_load"] = chain(
    *DECODED, *TWO, *POOL, *cleaned("early_all", "e"), *cleaned("late_all", "l"), MERGE.format(a="e", b="l"), *recleaned("merged", "x")
) + SERIES + "x"
SQL["cleaned_table"] = chain(*CLEAN) + SERIES + "clean"

# --- features -------------------------------------------------------------------------------------------


def rounded(cols):
    return ", ".join(r(e, n) for n, e in cols.items())


SQL["lag_features"] = chain(*CLEAN) + f"SELECT series_id, ts, {rounded(lag_cols())} FROM clean"
SQL["rolling_features"] = chain(*DECODED, hourly("dec", "h"), gridded("h", "g")) + f"SELECT series_id, ts, {rounded(roll_cols())} FROM g"
SQL["calendar_features"] = f"""SELECT o_orderkey, {rounded(cal_cols('t'))}
FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t FROM orders)"""
SQL["lead_targets"] = chain(*CLEAN) + f"SELECT series_id, ts, {rounded(lead_cols())} FROM clean"
SQL["target_summary"] = chain(
    *DECODED, hourly("dec", "h"), gridded("h", "g"), f"w AS (SELECT series_id, ts, {select(lead_cols())} FROM g)"
) + f"SELECT series_id, ts, {rounded(summary_cols(target_names()))} FROM w"
SQL["feature_matrix"] = chain(*MATRIX) + (
    f"SELECT series_id, ts, {rs(*feature_names(), *target_names(), 'target_tmax', 'target_tmin', 'target_tavg')} FROM matrix"
)

# --- splits ---------------------------------------------------------------------------------------------

SQL["time_split"] = chain(*CLEAN) + summary_sql(f"{split_case()} AS split", "clean")
PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, event_id) - 1 AS pos,
  count(*) OVER (PARTITION BY series_id) AS n FROM obs)"""
PARTS = """parts AS (SELECT *, CASE WHEN pos < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN pos < floor(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed)"""
SQL["positional_split"] = chain(OBS, PLACED, PARTS) + "SELECT event_id, series_id, pos, split FROM parts"
SCALER = """scaler AS (SELECT series_id, avg(temp) AS temp_mean, stddev_samp(temp) AS temp_std, avg(dew) AS dew_mean,
  stddev_samp(dew) AS dew_std FROM parts WHERE split = 'train' GROUP BY 1)"""
SQL["scaler"] = chain(OBS, PLACED, PARTS, SCALER) + f"SELECT series_id, {rs('temp_mean', 'temp_std', 'dew_mean', 'dew_std')} FROM scaler"
SQL["target_scaler"] = chain(*MATRIX) + f"""SELECT {r('avg(y)', 'y_mean')}, {r('stddev_pop(y)', 'y_std')}
FROM (SELECT unnest([{', '.join(target_names())}]) AS y FROM matrix)"""
SQL["standardize"] = chain(OBS, PLACED, PARTS, SCALER) + f"""SELECT series_id, event_id, ts, {r('(temp - temp_mean) / temp_std', 'temp')},
  {r('(dew - dew_mean) / dew_std', 'dew')}, split FROM parts JOIN scaler USING (series_id)"""
SQL["split_files"] = chain(OBS, PLACED, PARTS, SCALER) + f"""SELECT series_id, event_id, {r('(temp - temp_mean) / temp_std', 'temp')}, split
FROM parts JOIN scaler USING (series_id)"""
_W = f"(PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW.total - 1} FOLLOWING)"
SQL["sliding_windows"] = chain(OBS, PLACED, f"""w AS (SELECT series_id, pos, ts,
  list(CAST(round(temp * 100) AS BIGINT)) OVER {_W} AS temps, list(dew) OVER {_W} AS dews FROM placed)""") + f"""
SELECT series_id, pos AS start_pos, ts AS start_ts, array_to_string(temps[1:{WINDOW.input_width}], ',') AS temps,
  array_to_string(temps[{WINDOW.label_start + 1}:{WINDOW.total}], ',') AS labels, {r(f'list_sum(dews[1:{WINDOW.input_width}])', 'dew_sum')}
FROM w WHERE len(temps) = {WINDOW.total}"""

# --- profile --------------------------------------------------------------------------------------------

DAILY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS "TMAX", min(o_totalprice) AS "TMIN",
  avg(o_totalprice) AS "TAVG" FROM orders GROUP BY 1)"""


def long_of(src, cols, by):
    return " UNION ALL ".join(
        f"SELECT {''.join(b + ', ' for b in by)}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols
    )


def stats_sql(src, by):
    """Column statistics of a long table ``src``."""
    k = ", ".join(by)
    zero = lambda e, n: r(f"CASE WHEN c = 0 THEN 0.0 ELSE {e} END", n)
    return f"""q AS (SELECT {k}, count(value) AS c, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo,
      quantile_cont(value, CAST(0.25 AS DOUBLE)) AS q25, quantile_cont(value, CAST(0.5 AS DOUBLE)) AS median, quantile_cont(value, CAST(0.75 AS DOUBLE)) AS q75,
      max(value) AS hi FROM {src} GROUP BY {k}),
    o AS (SELECT {', '.join('l.' + b for b in by)}, count(*) FILTER (value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outs
      FROM {src} l JOIN q USING ({k}) GROUP BY ALL)
    SELECT {k}, c AS count, {zero('mean', 'mean')}, {zero('std', 'std')}, {zero('lo', 'min')}, {zero('q25', 'q25')},
      {zero('median', 'median')}, {zero('q75', 'q75')}, {zero('hi', 'max')}, n - c AS nan_count,
      {r('CASE WHEN c = 0 THEN 100.0 ELSE CAST(n - c AS DOUBLE) / n * 100 END', 'nan_pct')}, outs AS outlier_count,
      {r('CASE WHEN c = 0 THEN 0.0 ELSE CAST(outs AS DOUBLE) / c * 100 END', 'outlier_pct')}
    FROM q JOIN o USING ({k})"""


def box_sql(src, by, outliers_only=False):
    k = ", ".join(by)
    low, high = "q25 - 1.5 * (q75 - q25)", "q75 + 1.5 * (q75 - q25)"
    outs = f"count(*) FILTER (value < {low} OR value > {high})"
    if outliers_only:
        shown = f"{outs} AS outlier_count, {r(f'CAST({outs} AS DOUBLE) / any_value(n) * 100', 'outlier_pct')}"
    else:
        inside = f"FILTER (value >= {low} AND value <= {high})"
        shown = f"""any_value(n) AS n, {r('any_value(q25)', 'q25')}, {r('any_value(median)', 'median')}, {r('any_value(q75)', 'q75')},
          {outs} AS outlier_count, {r(f'min(value) {inside}', 'whisker_low')}, {r(f'max(value) {inside}', 'whisker_high')}"""
    return f"""q AS (SELECT {k}, count(value) AS n, quantile_cont(value, CAST(0.25 AS DOUBLE)) AS q25, quantile_cont(value, CAST(0.5 AS DOUBLE)) AS median,
      quantile_cont(value, CAST(0.75 AS DOUBLE)) AS q75 FROM {src} GROUP BY {k})
    SELECT {k}, {shown} FROM {src} JOIN q USING ({k}) GROUP BY {k}"""


def hist_sql(src, by, range_by, bins=30):
    k, e = ", ".join(by), ", ".join(range_by)
    group = f"GROUP BY {e}" if range_by else ""
    return f"""ends AS (SELECT {e + ',' if e else ''} CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
      CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM {src} {group}),
    groups AS (SELECT {k}, count(value) AS n FROM {src} GROUP BY {k} HAVING count(value) > 0),
    guessed AS (SELECT {k}, value, lo, (hi - lo) / {bins} AS step, least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}) AS g
      FROM {src} JOIN ends USING ({e}) WHERE value IS NOT NULL),
    counted AS (SELECT {k}, CASE WHEN value < lo + g * step THEN g - 1 WHEN value >= lo + (g + 1) * step AND g < {bins - 1} THEN g + 1 ELSE g END AS bin,
      count(*) AS cnt FROM guessed GROUP BY ALL),
    bins AS (SELECT CAST(unnest(generate_series(0, {bins - 1})) AS INTEGER) AS bin)
    SELECT {', '.join('f.' + b for b in by)}, f.bin, {r('lo + (f.bin + CAST(0.5 AS DOUBLE)) * ((hi - lo) / ' + str(bins) + ')', 'center')},
      coalesce(cnt, 0) AS count, {r('CAST(coalesce(cnt, 0) AS DOUBLE) / n', 'density')}
    FROM (SELECT * FROM groups CROSS JOIN bins JOIN ends USING ({e})) f
    LEFT JOIN counted c ON {' AND '.join(f'c.{b} = f.{b}' for b in by)} AND c.bin = f.bin"""


SQL["unpivot"] = chain(DAILY) + f"SELECT day, variable, {r('value')} FROM ({long_of('daily', ['TMAX', 'TMIN', 'TAVG'], ['day'])})"
ITEMS = """items AS (SELECT * REPLACE (CASE WHEN l_linenumber > 2 THEN l_tax END AS l_tax), CAST(NULL AS DOUBLE) AS nothing FROM lineitem)"""
SQL["column_stats"] = chain(
    ITEMS, f"l AS ({long_of('items', ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'nothing'], ['l_returnflag'])})",
) .rstrip() + ",\n" + stats_sql("l", ["l_returnflag", "variable"])
OBS_LONG = f"l AS ({long_of('obs', ['temp', 'dew'], ['series_id'])})"
SQL["iqr_outliers"] = chain(OBS, OBS_LONG).rstrip() + ",\n" + box_sql("l", ["series_id", "variable"], outliers_only=True)
SQL["box_plots"] = chain(DAILY, f"l AS ({long_of('daily', ['TMAX', 'TMIN', 'TAVG'], [])})").rstrip() + ",\n" + box_sql("l", ["variable"])


def bad_sql(src, cells):
    missing = " OR ".join(f"{c} IS NULL" for c in cells)
    return f"""SELECT split, count(*) AS total_records, count(*) FILTER ({missing}) AS nan_rows,
      count(*) FILTER (temp < {B.temp_min} OR temp > {B.temp_max}) AS bad_temp_count,
      count(*) FILTER (dew < {B.dew_min} OR dew > {B.dew_max}) AS bad_dew_count,
      count(*) FILTER (dew > temp) AS dew_above_temp_count,
      {r(f'CAST(count(*) FILTER ({missing}) AS DOUBLE) / count(*) * 100', 'nan_row_pct')} FROM {src} GROUP BY split"""


SQL["bad_values"] = chain(*DECODED, f"s AS (SELECT *, {split_case()} AS split FROM dec)") + bad_sql("s", ["ts", "temp", "dew"])
SQL["bad_values_total"] = chain(OBS) + f"""SELECT CAST(count(*) FILTER (temp < {B.temp_min} OR temp > {B.temp_max}) AS BIGINT) AS bad_temp_count,
  CAST(count(*) FILTER (dew < {B.dew_min} OR dew > {B.dew_max}) AS BIGINT) AS bad_dew_count, CAST(count(*) FILTER (dew > temp) AS BIGINT) AS dew_above_temp_count FROM obs"""
SQL["histogram"] = chain(OBS, OBS_LONG).rstrip() + ",\n" + hist_sql("l", ["series_id", "variable"], ["variable"])
_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["numeric_histograms"] = chain(f"l AS ({long_of('lineitem', _NUMERIC, [])})").rstrip() + ",\n" + hist_sql("l", ["variable"], ["variable"])
SPLIT_ROWS = (*MATRIX, f"""s AS (SELECT *, {split_case()} AS split, temp_lag0 AS temp, dew_lag0 AS dew, dew_depression_lag0 AS dew_depression FROM matrix)""")
SQL["split_statistics"] = chain(
    *SPLIT_ROWS, f"l AS ({long_of('s', ['temp', 'dew', 'dew_depression', 'temp_roll_mean_24h'], ['split'])})"
).rstrip() + ",\n" + stats_sql("l", ["split", "variable"])
SQL["split_histograms"] = chain(*SPLIT_ROWS, f"l AS ({long_of('s', ['temp', 'dew'], ['split'])})").rstrip() + ",\n" + hist_sql(
    "l", ["split", "variable"], ["variable"])
SQL["split_periods"] = chain(*SPLIT_ROWS, f"b AS ({bad_sql('s', ['temp', 'dew'])})") + """
SELECT b.*, p.* EXCLUDE (split), total_records AS records_count FROM b JOIN (SELECT split, strftime(min(ts), '%Y-%m-%d %H:%M') AS start_date,
  strftime(max(ts), '%Y-%m-%d %H:%M') AS end_date FROM s GROUP BY split) p USING (split)"""
SQL["missing_pct"] = chain(*DECODED, "l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) / count(*) * 100 AS p FROM dec"
    for c in ("series_id", "event_id", "ts", "temp", "dew")) + ")") + f"SELECT variable, {r('p', 'missing_pct')} FROM l WHERE p > 0"

COLUMNS = {
    "region": {"r_regionkey": "n", "r_name": "t"},
    "nation": {"n_nationkey": "n", "n_name": "t", "n_regionkey": "n"},
    "customer": {"c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t"},
    "supplier": {"s_suppkey": "n", "s_name": "t", "s_nationkey": "n", "s_acctbal": "n"},
    "part": {"p_partkey": "n", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "n", "p_retailprice": "n"},
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "d", "o_orderpriority": "t"},
    "lineitem": {**{c: "n" for c in _NUMERIC}, "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "d"},
    "events": {"event_id": "n", "ts": "d", "user_id": "n", "event_type": "t", "value": "n", "props": "t"},
    "documents": {"doc_id": "n", "text": "t", "lang": "t", "source": "t", "n_chars": "n"},
    "embeddings": {"vec_id": "n", "embedding": "a", "label": "n"},
    "pages": {"page_id": "n", "url": "t", "html": "t"},
    "benchmark": {"item_id": "n", "text": "t"},
    "labels": {"doc_id": "n", "quality": "n", "toxic": "n"},
    "conversations": {"conv_id": "n", "turn": "n", "role": "t", "text": "t"},
}


def doc_sql(source, column, kind):
    none = lambda t: f"CAST(NULL AS {t})"
    number = [f"CAST({f}({column}) AS DOUBLE)" if kind == "n" else none("DOUBLE") for f in ("min", "max")]
    date = [f"strftime({f}({column}), '%Y-%m-%d')" if kind == "d" else none("VARCHAR") for f in ("min", "max")]
    distinct = f"count(DISTINCT {column})" if kind in "ta" else none("BIGINT")
    listed = (
        f"CASE WHEN count(DISTINCT {column}) <= 10 THEN array_to_string(list_sort(list(DISTINCT {column})), ', ') END"
        if kind == "t" else none("VARCHAR")
    )
    name = {"n": "numeric", "d": "date", "t": "text", "a": "text"}[kind]
    return f"""SELECT '{source}' AS source, '{column}' AS variable, '{name}' AS kind, {r(number[0], 'low')}, {r(number[1], 'high')},
      {date[0]} AS first_day, {date[1]} AS last_day, {distinct} AS "distinct", {listed} AS listed FROM {source}"""


SQL["column_docs"] = " UNION ALL ".join(doc_sql(t, c, k) for t in PROFILE_TABLES for c, k in COLUMNS[t].items())
DAYS = """days AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 2000 AS "TMAX",
  l_extendedprice * (1 + l_tax) / 2000 - l_discount * 20 AS "TMIN", l_extendedprice * (1 - l_discount) / 2000 AS "TAVG" FROM lineitem)"""
SQL["sanity_checks"] = chain(DAYS) + """SELECT count(*) FILTER ("TMAX" < "TMIN") AS high_below_low,
  count(*) FILTER ("TAVG" < "TMIN" OR "TAVG" > "TMAX") AS mean_out_of_range, count(*) FILTER ("TMAX" > 45) AS extreme_high,
  count(*) FILTER ("TMIN" < -20) AS extreme_low FROM days"""
SQL["sanity_examples"] = chain(DAYS) + f"""SELECT l_orderkey, l_linenumber, l_partkey, {r('"TMAX"', 'TMAX')}, {r('"TMIN"', 'TMIN')} FROM days
WHERE "TMAX" < "TMIN" ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5"""

# --- two-dimensional histograms -------------------------------------------------------------------------

SHIP = "ship AS (SELECT l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts, l_quantity AS xv, l_extendedprice AS yv FROM lineitem)"
PAIRS = f"pairs AS (SELECT * FROM (SELECT *, {hour_of_year('ts')} AS hour FROM ship) WHERE hour IS NOT NULL AND xv IS NOT NULL AND yv IS NOT NULL)"
AXES = "axes AS (SELECT floor(min(xv)) AS x_min, ceil(max(xv)) AS x_max, floor(min(yv)) AS y_min, ceil(max(yv)) AS y_max FROM pairs)"


def cell(v, a):
    return f"CAST(greatest(0, least(49, floor(({v} - {a}_min) / ({a}_max - {a}_min) * 50))) AS INTEGER)"


CELLS = f"""cells AS (SELECT CAST(hour AS INTEGER) AS hour, {cell('xv', 'x')} AS x, {cell('yv', 'y')} AS y, count(*) AS cnt
  FROM pairs CROSS JOIN axes GROUP BY ALL)"""
HIST = chain(SHIP, PAIRS, AXES, CELLS)
SQL["hist2d_cells"] = HIST + "SELECT * FROM cells"
SQL["hist2d_bounds"] = HIST + f"SELECT {rs('x_min', 'x_max', 'y_min', 'y_max')} FROM axes"
SQL["hist2d_cumulative"] = HIST + """SELECT hour, x, y, CAST(sum(cnt) OVER (PARTITION BY x, y ORDER BY hour) AS BIGINT) AS total FROM cells"""
SQL["hist2d_up_to"] = HIST + f"""SELECT x, y, CAST(total AS BIGINT) AS total, {r('least(1.0, CAST(total AS DOUBLE) / max(total) OVER ())', 'norm')}
FROM (SELECT x, y, sum(cnt) AS total FROM cells WHERE hour <= 4000 GROUP BY 1, 2)"""
SQL["hist2d_normalised"] = HIST + f"""SELECT hour, strftime(TIMESTAMP '1999-01-01' + to_hours(hour), '%b %d %H:%M') AS label, x, y, cnt,
  {r('least(1.0, CAST(cnt AS DOUBLE) / greatest(1, max(cnt) OVER ()))', 'norm')} FROM cells"""
SQL["hist2d_frames"] = HIST + """SELECT h.hour, coalesce(string_agg(concat_ws(':', x, y, cnt), ' ' ORDER BY x, y), '') AS cells
FROM (SELECT CAST(unnest(generate_series(0, 8759)) AS INTEGER) AS hour) h LEFT JOIN cells USING (hour) GROUP BY h.hour"""

SQL["frame_files"] = SQL["hist2d_frames"]

# --- forecasts and scores -------------------------------------------------------------------------------

CLIM = (
    f"""clim AS (SELECT series_id, dayofyear(ts) AS doy, hour(ts) AS hour, avg(temp) AS mean FROM clean WHERE ts < TIMESTAMP '{D.test_start}' GROUP BY ALL)""",
    f"overall AS (SELECT series_id, avg(temp) AS overall FROM clean WHERE ts < TIMESTAMP '{D.test_start}' GROUP BY 1)",
)
_TARGETS = ", ".join(target_names())
STEPS = (
    *MATRIX, *CLIM,
    f"held AS (SELECT * FROM matrix WHERE ts >= TIMESTAMP '{D.val_start}')",
    f"""ahead AS (SELECT m.series_id, m.ts, m.temp_lag0 AS now, h, m.ts + to_hours(h) AS target_ts, [{_TARGETS}][h] AS y,
      m.target_tmax, m.target_tmin, m.target_tavg FROM held m CROSS JOIN (SELECT CAST(unnest(generate_series(1, 24)) AS INTEGER) AS h))""",
    """hours AS (SELECT *, 'persistence' AS model, now AS yhat FROM ahead UNION ALL
      SELECT a.*, 'climatology', coalesce(c.mean, o.overall) FROM ahead a JOIN overall o USING (series_id)
      LEFT JOIN clim c ON c.series_id = a.series_id AND c.doy = dayofyear(a.target_ts) AND c.hour = hour(a.target_ts))""",
    """days AS (SELECT series_id, ts, model, any_value(now) AS now, any_value(target_tmax) AS actual_tmax, any_value(target_tmin) AS actual_tmin,
      any_value(target_tavg) AS actual_tavg, max(yhat) AS tmax, min(yhat) AS tmin, avg(yhat) AS tavg,
      max(y) FILTER (h = 24) AS y24, max(yhat) FILTER (h = 24) AS yhat24 FROM hours GROUP BY 1, 2, 3)""",
)


def steps_sql(model):
    return chain(*STEPS) + f"""SELECT series_id, ts, model, h - 1 AS h, {r('yhat')}, {r('tmax')}, {r('tmin')}, {r('tavg')}
FROM hours JOIN (SELECT series_id, ts, model, tmax, tmin, tavg FROM days) USING (series_id, ts, model) WHERE model = '{model}'"""


SQL["persistence"] = steps_sql("persistence")
SQL["climatology"] = steps_sql("climatology")
SQL["climatology_fit"] = chain(*CLEAN) + f"""SELECT series_id, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(hour(ts) AS INTEGER) AS hour, {r('avg(temp)', 'mean')}, {r('any_value(o)', 'overall')}
FROM clean JOIN (SELECT series_id, avg(temp) AS o FROM clean GROUP BY 1) USING (series_id) GROUP BY series_id, dayofyear(ts), hour(ts)"""


def regression(y, p, prefix=""):
    e = f"({p} - {y})"
    return {
        f"{prefix}mae": f"avg(abs{e})", f"{prefix}rmse": f"sqrt(avg({e} * {e}))",
        f"{prefix}mape": f"coalesce(avg(CASE WHEN abs({y}) > 0.5 THEN abs({e} / {y}) END) * 100, 0)",
        f"{prefix}r2": f"1 - sum({e} * {e}) / (var_pop({y}) * count(*))",
    }


def share(part, whole):
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / ({whole}) * 100 ELSE 0 END"


_TP, _SAID, _DID = "count(*) FILTER (yhat24 > now AND y24 > now)", "count(*) FILTER (yhat24 > now)", "count(*) FILTER (y24 > now)"
HOURLY = regression("y", "yhat") | {f"acc_{k}": f"avg(CASE WHEN abs(yhat - y) <= {k} THEN 1.0 ELSE 0.0 END) * 100" for k in (1, 2)}
DIRECTION = {
    "directional_precision": share(_TP, _SAID), "directional_recall": share(_TP, _DID),
    "directional_f1": share(f"2 * {_TP}", f"({_SAID} + {_DID})"),
}
SUMMARY = {k: v for s in ("tmax", "tmin", "tavg") for k, v in regression(f"actual_{s}", s, f"{s}_").items()}
SCORES = (
    *STEPS, f"hs AS (SELECT model, {select(HOURLY)} FROM hours GROUP BY model)",
    f"ds AS (SELECT model, count(*) AS rows, {select(DIRECTION | SUMMARY)} FROM days GROUP BY model)",
    "scores AS (SELECT * FROM hs JOIN ds USING (model))",
)
SQL["evaluate_models"] = chain(*SCORES) + f"SELECT model, rows, {rs(*HOURLY, *DIRECTION, *SUMMARY)} FROM scores"
SQL["leaderboard"] = chain(*SCORES) + f"""SELECT *, place = 1 AS is_best FROM (SELECT CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS place,
  model, {rs('mae', 'rmse', 'acc_1', 'acc_2', 'directional_f1', 'r2')} FROM scores)"""
SQL["kpi"] = chain(*SCORES) + f"""SELECT arg_min(model, mae) AS best_model, {r('min(mae)', 'best_mae')}, {r('max(acc_1)', 'best_acc_1')},
  {r('max(acc_2)', 'best_acc_2')}, {r('max(directional_f1)', 'best_directional_f1')} FROM scores"""
SQL["validation_error"] = chain(*STEPS) + f"SELECT model, {r('avg(abs(yhat - y))', 'val_mae')} FROM hours GROUP BY model"
RESID = "res AS (SELECT model, tmax - actual_tmax AS value FROM days)"
SQL["residual_summary"] = chain(*STEPS, RESID) + f"SELECT model, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')} FROM res GROUP BY model"
SQL["residual_histogram"] = chain(*STEPS, RESID).rstrip() + ",\n" + hist_sql("res", ["model"], ["model"], 25)
SQL["error_boxplot"] = chain(*STEPS, "l AS (SELECT model, abs(tmax - actual_tmax) AS value FROM days)").rstrip() + ",\n" + box_sql("l", ["model"])
SQL["tail_sample"] = chain(*STEPS) + f"""SELECT d.series_id, d.ts, model, {rs('now', 'actual_tmax', 'tmax')} FROM days d
JOIN (SELECT DISTINCT series_id, ts FROM days ORDER BY ts DESC, series_id LIMIT 200) USING (series_id, ts)"""
SQL["last_profiles"] = chain(*STEPS) + f"""SELECT model, ts AS last_ts, h - 1 AS h, {r('yhat')} FROM (
  SELECT *, rank() OVER (PARTITION BY model ORDER BY ts DESC, series_id DESC) AS k FROM hours) WHERE k = 1"""

SQL["evaluation_export"] = chain(*STEPS) + f"""SELECT model, strftime(max(ts) OVER (), '%Y-%m-%d %H:%M') AS last_timestamp,
  CAST(row_number() OVER (PARTITION BY model ORDER BY ts, series_id) - 1 AS INTEGER) AS place, strftime(ts, '%Y-%m-%d %H:%M') AS timestamps,
  {r('now', 'actual_current_temp')}, {r('actual_tmin', 'actual_next24_tmin')}, {r('tmin')} FROM days
JOIN (SELECT DISTINCT series_id, ts FROM days ORDER BY ts DESC, series_id LIMIT 100) USING (series_id, ts)"""
SQL["metrics_report"] = chain(*SCORES) + f"""SELECT model AS model_name, {r('round(mae, 4)', 'mae')}, {r('round(acc_2, 2)', 'acc_2')},
  {r('round(directional_f1, 2)', 'directional_f1')}, {r('round(tmax_rmse, 4)', 'tmax_rmse')}, {r('round(tavg_r2, 4)', 'tavg_r2')} FROM scores"""

SQL["report_files"] = SQL["metrics_report"]

# --- training histories ---------------------------------------------------------------------------------

RUNS = """runs AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
  value, value * CAST(0.5 AS DOUBLE) + event_id % 13 AS train_loss FROM events)"""
BEST = """best AS (SELECT *, first_value(step) OVER (PARTITION BY run_id, best_so_far ORDER BY step) AS best_step FROM (
  SELECT *, min(value) OVER (PARTITION BY run_id ORDER BY step) AS best_so_far FROM runs))"""
SQL["history_running_best"] = chain(RUNS, BEST) + f"""SELECT run_id, step, {r('value', 'val_mae')}, {r('best_so_far')}, best_step,
  best_step = step AS improved FROM best"""
SQL["history_overfit"] = chain(RUNS) + f"""SELECT run_id, step, {r('value', 'val_loss')}, {r('train_loss')}, {r('low', 'lowest_val_loss')}, {r('first', 'first_train_loss')},
  step AS steps_done, step >= 6 AND value > 1.25 * low AND train_loss < first AS overfit
FROM (SELECT *, min(value) OVER w AS low, first_value(train_loss) OVER w AS first FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY step))"""
SQL["history_status"] = chain(RUNS, BEST) + f"""SELECT run_id, {r('min(best_so_far)', 'best')}, max(best_step) AS best_step,
  min(step) FILTER (best_so_far <= 0.5) AS reached_at, count(*) AS steps,
  CASE WHEN min(step) FILTER (best_so_far <= 0.5) IS NOT NULL THEN 'adequate' ELSE 'underfit' END AS status FROM best GROUP BY run_id"""
SQL["history_best_run"] = chain(RUNS) + f"""SELECT count(*) AS models, {r('min(m)', 'best_val_mae')},
  arg_min(run_id, (m, run_id)) AS best_model FROM (SELECT run_id, min(value) AS m FROM runs GROUP BY 1)"""

SQL["history_summary"] = f"""SELECT CAST(o_custkey AS VARCHAR) AS model, CAST(count(*) AS INTEGER) AS steps,
  CAST(count(*) FILTER (o_totalprice > 250000) AS INTEGER) AS rate_events, CASE WHEN max(o_orderstatus) = 'P' THEN 'Completed' ELSE max(o_orderstatus) END AS final_status,
  CASE max(o_orderstatus) WHEN 'O' THEN 'overfit' WHEN 'P' THEN 'underfit' ELSE 'good' END AS fit, {r('CAST(1 AS DOUBLE)', 'target_mae')},
  {r('min(o_totalprice)', 'best_val_mae')}, CAST(arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS INTEGER) AS best_epoch FROM orders GROUP BY o_custkey"""
SQL["history_epochs"] = f"""SELECT CAST(o_custkey AS VARCHAR) AS model, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS epoch,
  {r('o_totalprice', 'val_mae')} FROM orders"""

P = PLATEAU
REPLAY = f"""WITH RECURSIVE {RUNS},
state AS (
  SELECT run_id, CAST(0 AS BIGINT) AS step, CAST(0 AS DOUBLE) AS metric, CAST({P.initial_lr} AS DOUBLE) AS lr, CAST('inf' AS DOUBLE) AS best,
    0 AS stale, 0 AS at_floor, 0 AS resting, 0 AS decays, CAST(NULL AS VARCHAR) AS event FROM runs WHERE step = 1
  UNION ALL
  SELECT run_id, step, value, CASE WHEN dropped THEN wanted WHEN bumped THEN greatest({P.initial_lr * P.restart_factor}, {2 * P.min_lr}) ELSE lr END,
    CASE WHEN kind = 'better' THEN value ELSE best END, CASE WHEN dropped OR bumped THEN 0 ELSE stale1 END,
    CASE WHEN dropped OR bumped OR kind = 'better' THEN 0 ELSE floor1 END,
    CASE WHEN kind = 'rest' THEN resting - 1 WHEN dropped THEN {P.cooldown} WHEN bumped THEN {max(2 * P.cooldown, 2)} ELSE 0 END,
    CASE WHEN bumped THEN 0 ELSE decays1 END,
    CASE WHEN dropped THEN 'plateau' WHEN bumped THEN 'warm_restart_bump' END
  FROM (SELECT *, fired AND NOT dropped AND floor1 >= {P.restart_patience} AS bumped
    FROM (SELECT *, fired AND lr - wanted > 1e-12 AS dropped, at_floor + CASE WHEN fired AND NOT lr - wanted > 1e-12 THEN 1 ELSE 0 END AS floor1,
        decays + CASE WHEN fired THEN 1 ELSE 0 END AS decays1
      FROM (SELECT *, kind = 'worse' AND stale1 >= {P.patience} AS fired, greatest(lr * {P.factor}, {P.min_lr}) AS wanted
        FROM (SELECT *, CASE WHEN kind = 'worse' THEN stale + 1 ELSE 0 END AS stale1
          FROM (SELECT s.run_id, r.step, r.value, s.lr, s.best, s.stale, s.at_floor, s.resting, s.decays,
              CASE WHEN s.resting > 0 THEN 'rest' WHEN r.value < s.best - {P.min_delta} THEN 'better' ELSE 'worse' END AS kind
            FROM state s JOIN runs r ON r.run_id = s.run_id AND r.step = s.step + 1)))))
)
"""
SQL["policy_replay"] = REPLAY + f"SELECT run_id, step, {rs('metric', 'lr', 'best')}, stale, resting, decays, event FROM state WHERE step > 0"
SQL["policy_events"] = REPLAY + f"SELECT run_id, event, count(*) AS n, {r('min(lr)', 'lowest_lr')} FROM state WHERE event IS NOT NULL GROUP BY 1, 2"


def cyclic_sql(scale):
    height = "greatest(0.0, 1.0 - abs(CAST(step AS DOUBLE) / 5 - 2 * cycle + 1))"
    return chain(RUNS) + f"""SELECT run_id, step, {r(f'0.001 + (0.1 - 0.001) * ({height} {scale})', 'lr')}
FROM (SELECT run_id, step, floor(1 + CAST(step AS DOUBLE) / 10) AS cycle FROM runs)"""


SQL["policy_triangular"] = cyclic_sql("")
SQL["policy_triangular2"] = cyclic_sql("/ pow(2, cycle - 1)")
SQL["policy_exp_range"] = cyclic_sql("* pow(CAST(0.99 AS DOUBLE), step)")

STATIONS = f"""SELECT 'station_' || (event_id % 3 + 1) AS series_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS ts,
  {r('0.5', 'precipitation_mm')}, {r('value', 'temperature_celsius')}, {r('CASE WHEN event_id % 3 <> 2 THEN event_id % 100 END', 'humidity_percent')},
  {r('1000', 'pressure_hpa')}, {r('3', 'wind_speed_ms')} FROM events"""
SQL["station_files"] = f"SELECT * EXCLUDE (wind_speed_ms) FROM ({STATIONS})"
SQL["station_subset"] = f"SELECT series_id, ts, temperature_celsius, wind_speed_ms FROM ({STATIONS}) WHERE series_id <> 'station_2'"
