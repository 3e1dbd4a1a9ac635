"""Sinks: partitioned tables, JSON reports, sparse frames, and reset / resume of a run folder."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hist2d import GRID_SIZE, frames
from ..schema import KEY, TS
from .paths import copy, delete, exists, files_below, rename, write_text

MANIFEST = "manifest.json"


def write_series(df: DataFrame, path: str, by_year: bool = True) -> None:
    """Cleaned series as parquet, one folder per year, so that period filters prune files.

    Rows are spread by series and year before writing, so a task adds one file to each year it holds and
    no task holds a whole long series.
    """
    if not by_year:
        df.write.mode("overwrite").parquet(path)
        return
    yearly = df.withColumn("year", F.year(TS))
    yearly.repartition(KEY, "year").sortWithinPartitions(KEY, TS).write.mode("overwrite").partitionBy("year").parquet(path)


def write_series_csv(df: DataFrame, path: str) -> None:
    df.select(KEY, F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "temp", "dew").write.mode(
        "overwrite").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_splits_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy("split").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small report table as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_histories(records: DataFrame, path: str) -> None:
    """Training records (a row per model, fields of ``readers.HISTORY_SCHEMA``) as one JSON object keyed by model.

    For the models of a job: the file holds all of them, so their number is bounded by the caller.
    """
    fields = [c for c in records.columns if c != "model"]
    entries = F.array_sort(F.collect_list(F.struct("model", F.struct(*fields).alias("record"))))
    records.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_frames(cells: DataFrame, bounds: DataFrame, path: str, size: int = GRID_SIZE, files: int = 16) -> None:
    """Sparse 2-D histogram: 8760 frames (empty ones included) in hour order, and the axis ends.

    Each file holds a range of hours; file names follow the hours.
    """
    packed = frames(cells).select(
        "hour", F.transform("cells", lambda c: F.array(c["x"], c["y"], c["cnt"])).alias("frame")
    )
    packed.repartitionByRange(files, "hour").sortWithinPartitions("hour").write.mode("overwrite").json(f"{path}/frames")
    write_json(bounds.select(F.lit(size).alias("grid_size"), "*"), f"{path}/meta")


def _next_to(outputs: str) -> tuple[str, str]:
    """Where a run is written, and where the one before is kept for the moment of the swap."""
    return f"{outputs.rstrip('/')}.next", f"{outputs.rstrip('/')}.before"


def recover_run(spark: SparkSession, outputs: str) -> None:
    """Bring a run folder back to its last finished run, wherever an earlier job died. Jobs call it before they look at the folder."""
    coming, before = _next_to(outputs)
    if not exists(spark, outputs):
        if exists(spark, f"{coming}/{MANIFEST}"):  # died between the two renames: the new run is whole
            rename(spark, coming, outputs)
        elif exists(spark, before):
            rename(spark, before, outputs)
    for left in (coming, before):
        if exists(spark, left):
            delete(spark, left)


def begin_run(spark: SparkSession, outputs: str, mode: str, state: Iterable[str] = ()) -> str:
    """The folder that a new run is written to. Of the finished run, a resumed one takes over ``state``; the old folder stays as it is."""
    if mode not in ("reset", "resume"):
        raise ValueError(f"unknown mode {mode!r}")
    coming, _ = _next_to(outputs)
    if exists(spark, coming):
        delete(spark, coming)
    for name in state if mode == "resume" else ():
        copy(spark, f"{outputs}/{name}", f"{coming}/{name}")
    return coming


def finish_run(spark: SparkSession, outputs: str) -> None:
    """Make the run that :func:`begin_run` opened the finished one: its manifest (all files and sizes) is written last, then the folders are swapped by renames."""
    coming, before = _next_to(outputs)
    files = [{"name": n, "bytes": size} for n, size in files_below(spark, coming) if not n.rsplit("/", 1)[-1].startswith(("_", "."))]
    write_text(spark, f"{coming}/{MANIFEST}", json.dumps({"files": files}))
    if exists(spark, outputs):
        rename(spark, outputs, before)
    rename(spark, coming, outputs)
    if exists(spark, before):
        delete(spark, before)


def read_manifest(spark: SparkSession, outputs: str) -> DataFrame:
    """``(name, bytes)`` of the files of a finished run."""
    return spark.read.schema("files array<struct<name:string,bytes:long>>").json(f"{outputs}/{MANIFEST}").selectExpr("inline(files)")


def choose_mode(spark: SparkSession, outputs: str, required: Iterable[str]) -> str:
    """``reset`` for a new folder, ``resume`` where all state of an earlier run is there.

    A folder with only part of the state is an error: the caller must reset it or restore the rest.
    """
    if not exists(spark, outputs):
        return "reset"
    missing = [name for name in required if not exists(spark, f"{outputs}/{name}")]
    if missing:
        raise ValueError(f"incomplete run state in {outputs}: missing {', '.join(missing)}")
    return "resume"


def prepare_outputs(spark: SparkSession, outputs: str, mode: str) -> str:
    """Reset wipes the run folder; resume leaves it and later writes append."""
    if mode not in ("reset", "resume"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "reset" and exists(spark, outputs):
        delete(spark, outputs)
    return outputs
