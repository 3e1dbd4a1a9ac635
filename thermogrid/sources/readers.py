"""Readers of observation files, processed splits and training histories."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    is_plain_number, null_if_nan, parse_celsius, parse_encoded, parse_timestamp, wind_components,
)
from ..operators.clean import clean_series, combine_sources
from ..operators.scalars import attach
from ..schema import CHUNK_HOURS, CLEANING_BOUNDS, FILL_LIMIT, KEY, MEASURES, TS, Bounds
from ..session import materialise, use_utc
from .paths import exists, matching

# Column names in the three kinds of observation files, first match wins.
TIME_COLUMNS = ("DATE", "timestamp")
TEMP_COLUMNS = ("temperature", "TMP")
DEW_COLUMNS = ("dew_point_temperature", "DEW")

# Headers of the multi-station files and the names they get.
STATION_COLUMNS = {
    "Fecha/Hora": "timestamp",
    "Precipitacion (mm)": "precipitation_mm",
    "Temperatura (ºC)": "temperature_celsius",
    "Humedad (%)": "humidity_percent",
    "Presion (hPa)": "pressure_hpa",
    "Dir. Del Viento (º)": "wind_direction_deg",
    "Int. del Viento (m/s)": "wind_speed_ms",
}

CLEANED_NAME = "cleaned"
HISTORY_SCHEMA = T.StructType([
    T.StructField("epochs", T.ArrayType(T.StructType([
        T.StructField("epoch", T.IntegerType()), T.StructField("train_loss", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()), T.StructField("train_mae", T.DoubleType()),
        T.StructField("val_mae", T.DoubleType()), T.StructField("lr", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()), T.StructField("iteration", T.IntegerType()),
    ]))),
    T.StructField("iterations", T.ArrayType(T.StructType([
        T.StructField("iteration", T.IntegerType()), T.StructField("epochs_run", T.IntegerType()),
        T.StructField("val_mae_c", T.DoubleType()), T.StructField("status", T.StringType()),
    ]))),
    T.StructField("stages", T.ArrayType(T.StructType([
        T.StructField("stage", T.IntegerType()), T.StructField("trees_fitted", T.IntegerType()),
        T.StructField("val_mae", T.DoubleType()), T.StructField("learning_rate", T.DoubleType()),
    ]))),
    T.StructField("lr_decay_events", T.ArrayType(T.StructType([
        T.StructField("step", T.IntegerType()), T.StructField("old_lr", T.DoubleType()),
        T.StructField("new_lr", T.DoubleType()), T.StructField("policy", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]))),
    T.StructField("total_epochs", T.IntegerType()), T.StructField("best_epoch", T.IntegerType()),
    T.StructField("best_val_mae", T.DoubleType()), T.StructField("target_mae", T.DoubleType()),
    T.StructField("final_learning_rate", T.DoubleType()), T.StructField("final_status", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("is_adequate", T.BooleanType()),
    T.StructField("overfitting_detected", T.BooleanType()), T.StructField("underfitting_detected", T.BooleanType()),
])


@dataclass(frozen=True)
class RawSource:
    """One raw file or folder of files of one kind.

    ``encoding``, which has no default: ``tenths`` for ``value,flag`` text, ``celsius`` for plain degrees, ``auto`` to decide per
    column: text if any cell is more than a bare number. ``auto`` reads the file once more, for both columns together.
    """

    path: str
    sep: str = ","
    encoding: str = field(kw_only=True)
    series_id: str = "all"


def first_present(columns: Sequence[str], wanted: Sequence[str], what: str) -> str:
    for name in wanted:
        if name in columns:
            return name
    raise ValueError(f"no {what} column: expected one of {', '.join(wanted)}")


def read_text_csv(spark: SparkSession, path: str, sep: str = ",", charset: str = "UTF-8") -> DataFrame:
    """All columns as text under their header names: types are decided by our own parsers."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", charset).csv(path)


STATION_CHARSET = "ISO-8859-1"
ENCODINGS = ("tenths", "celsius", "auto")


def _encodings(df: DataFrame, columns: Sequence[str], encoding: str) -> list[str]:
    """The encoding of each column, by one aggregate over all of them where it isn't given."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {', '.join(ENCODINGS)}")
    if encoding != "auto":
        return [encoding] * len(columns)
    odd = df.agg(*[F.max(F.col(c).isNotNull() & ~is_plain_number(F.col(c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return ["tenths" if x else "celsius" for x in odd]


def _decode(column: str, encoding: str):
    return parse_encoded(F.col(column)) if encoding == "tenths" else parse_celsius(F.col(column))


def read_observations(spark: SparkSession, source: RawSource, formats: Sequence[str] = ()) -> DataFrame:
    """Raw file to ``(series_id, ts, temp, dew)``; rows without a usable instant are dropped."""
    use_utc(spark)
    raw = read_text_csv(spark, source.path, source.sep)
    time = first_present(raw.columns, TIME_COLUMNS, "time")
    temp = first_present(raw.columns, TEMP_COLUMNS, "temperature")
    dew = first_present(raw.columns, DEW_COLUMNS, "dew point")
    kept = raw.select(time, temp, dew)
    of_temp, of_dew = _encodings(kept, (temp, dew), source.encoding)
    return kept.select(
        F.lit(source.series_id).alias(KEY), parse_timestamp(F.col(time), formats).alias(TS),
        _decode(temp, of_temp).alias("temp"), _decode(dew, of_dew).alias("dew"),
    ).dropna(subset=[TS])


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """A cleaned hourly series: parquet folder, or CSV with ``timestamp,temp,dew``."""
    use_utc(spark)
    if path.endswith(".csv"):
        raw = read_text_csv(spark, path)
        key = F.col(KEY) if KEY in raw.columns else F.lit("all")
        measure = lambda m: null_if_nan(F.col(m).try_cast("double")).alias(m)
        time = first_present(raw.columns, ("timestamp", TS), "time")
        return raw.select(key.alias(KEY), parse_timestamp(F.col(time)).alias(TS), *[measure(m) for m in MEASURES])
    return spark.read.parquet(path).select(KEY, TS, *MEASURES)


def load_observations(
    spark: SparkSession,
    folder: str,
    sources: Sequence[RawSource],
    prefer_clean: bool = True,
    bounds: Bounds = CLEANING_BOUNDS,
    limit: int = FILL_LIMIT,
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """The cleaned hourly series of a data folder.

    A materialised ``cleaned`` table is read and cleaned once more; otherwise the raw sources that exist are
    cleaned, merged by instant and cleaned again. Paths of ``sources`` are relative to ``folder``.
    """
    if prefer_clean:
        for name in (f"{folder}/{CLEANED_NAME}", f"{folder}/{CLEANED_NAME}.csv"):
            if exists(spark, name):
                return clean_series(read_cleaned(spark, name), bounds, limit, chunk_hours)
    frames = [
        read_observations(spark, replace(s, path=f"{folder}/{s.path}"))
        for s in sources if exists(spark, f"{folder}/{s.path}")
    ]
    if not frames:
        raise FileNotFoundError(f"no observation files in {folder}")
    return combine_sources(frames, bounds, limit, chunk_hours)


_FIRST = pa.schema([("file", pa.string()), ("header", pa.string())])


def _first_lines(lines: DataFrame) -> DataFrame:
    """``(file, header)``: each file's first line that isn't blank. The part of a file that begins it is read by one task, in order."""
    def run(batches):
        last = None
        for batch in batches:
            out = []
            for file, line in zip(*(c.to_pylist() for c in batch.columns)):
                if file != last:
                    out.append((file, line))
                    last = file
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=_FIRST)

    return lines.where("start = 0").select("file", "line").mapInArrow(run, "file string, header string")


def _station_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """All lines of the station files, each by the header of its own file, with ``bad_line`` set where the cells don't fit it.

    One distributed read finds the first line of every file; only the different headers reach the driver, which looks up the places of the
    columns in them. A second read parses all lines, those of a file with its header's number of cells and places, in one
    plan: jobs and plan don't grow with the files. Columns that a header lacks are missing, as are those that it has twice; lines equal to their
    file's header are headers. Lines are parsed whole whatever columns are asked for, so every projection has the same rows.
    """
    use_utc(spark)
    text = T.StringType()
    wanted = [*STATION_COLUMNS, "station_id", "bad_line"]
    if not matching(spark, pattern):
        return spark.createDataFrame([], T.StructType([T.StructField(c, text) for c in wanted]))
    raw = spark.read.text(pattern).select(
        F.decode(F.col("value").cast("binary"), STATION_CHARSET).alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start")).where("trim(line) <> ''")
    firsts = materialise(_first_lines(raw))
    headers = [r["header"] for r in firsts.select("header").distinct().collect()]
    layouts = []
    for header in headers:
        names = next(csv.reader([header]))
        layouts.append((header, len(names), [names.index(c) + 1 if names.count(c) == 1 else 0 for c in STATION_COLUMNS]))
    layout = spark.createDataFrame(layouts, "header string, width int, places array<int>")
    lines = attach(raw, firsts.join(layout, "header"), ["file"]).where("line <> header")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    parsed = F.lit(None).cast("struct<cells:array<string>,bad_line:string>")
    for width in sorted({w for _, w, _ in layouts}):
        one = F.from_csv("line", ", ".join([*[f"c{i} string" for i in range(width)], "bad_line string"]), options)
        lines = lines.withColumn(f"_w{width}", F.when(F.col("width") == width, one))
        cells = F.struct(F.array(*[F.col(f"_w{width}.c{i}") for i in range(width)]).alias("cells"), F.col(f"_w{width}.bad_line").alias("bad_line"))
        parsed = F.when(F.col("width") == width, cells).otherwise(parsed)
    at = lambda i: F.when(F.col("places")[i] > 0, F.get(F.col("_p.cells"), F.col("places")[i] - 1))
    return lines.withColumn("_p", parsed).select(
        *[at(i).alias(c) for i, c in enumerate(STATION_COLUMNS)], station_of(F.col("name")).alias("station_id"), F.col("_p.bad_line").alias("bad_line"))


def read_station_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Many station CSVs, their columns by name; the station is named by its file (``weather_1`` is ``station_1``).

    Lines whose cells don't fit the header are left out, and counted by :func:`audit_station_files`; a file that
    can't be read is an error. With no file at all the result is empty.
    """
    return _station_lines(spark, pattern).where("bad_line is null").drop("bad_line")


def audit_station_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(station_id, n_lines, n_bad)`` of the files that have lines."""
    return _station_lines(spark, pattern).groupBy("station_id").agg(F.count("*").alias("n_lines"), F.count("bad_line").alias("n_bad"))


def station_of(file_name):
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    return F.replace(stem, F.lit("weather_"), F.lit("station_"))


def clean_stations(raw: DataFrame, formats: Sequence[str] = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy H:mm:ss")) -> DataFrame:
    """English names, numbers, instants, and wind direction as a unit vector (speed is not used)."""
    named = raw.withColumnsRenamed(STATION_COLUMNS)
    numbers = [c for c in STATION_COLUMNS.values() if c != "timestamp"]
    typed = named.withColumns({c: null_if_nan(F.col(c).try_cast("double")) for c in numbers})
    wind_x, wind_y = wind_components(F.col("wind_direction_deg"))
    return (
        typed.withColumns({TS: parse_timestamp(F.col("timestamp"), formats), "wind_x": wind_x, "wind_y": wind_y})
        .drop("timestamp", "wind_direction_deg").withColumnRenamed("station_id", KEY)
    )


def read_splits(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Processed train / val / test rows; each split prunes to its own partition folder."""
    table = spark.read.parquet(path)
    return {s: table.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}


def read_histories(spark: SparkSession, consolidated: str | None, single: dict[str, str]) -> DataFrame:
    """Training histories keyed by model name.

    The consolidated file (one object keyed by model) wins; models it lacks come from their single files.
    Files that do not exist are skipped.
    """
    frames = []
    if consolidated and exists(spark, consolidated):
        keyed = spark.read.text(consolidated, wholetext=True).select(
            F.inline(F.map_entries(F.from_json("value", T.MapType(T.StringType(), HISTORY_SCHEMA))))
        )
        frames.append(keyed.select(F.lit(0).alias("_place"), F.col("key").alias("model"), "value.*"))
    for model, path in single.items():
        if exists(spark, path):
            one = spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).json(path)
            frames.append(one.select(F.lit(1).alias("_place"), F.lit(model).alias("model"), "*"))
    fields = [f.name for f in HISTORY_SCHEMA.fields]
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField("model", T.StringType()), *HISTORY_SCHEMA.fields]))
    together = frames[0]
    for frame in frames[1:]:
        together = together.unionByName(frame)
    best = together.groupBy("model").agg(F.min_by(F.struct(*fields), "_place").alias("_h"))
    return best.select("model", "_h.*")
