"""Helpers that several operators share: names, Arrow batches, tables in the shared folder, shipping of code."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermogrid.session import scratch_path
from thermogrid.sources.paths import delete

BATCH_ROWS = 512
PIECE_BYTES = 1 << 21
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module) -> None:
    """Send a module's functions to the workers by value, so that they need not have it installed."""
    cloudpickle.register_pickle_by_value(module)


def small_batches(spark: SparkSession) -> SparkSession:
    """Few rows an Arrow batch: a batch of long texts must fit in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, by an exchange of their own.

    Dealt by the keys themselves, the exchange is left out where every side of a union or join lies by these keys already. ``mapInArrow`` states
    no need of that order, so adaptive execution then merges each side's partitions in its own way, and rows of a key no longer meet.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.repartition(n, F.xxhash64(*keys))


class Store:
    """Tables in the shared folder between the steps of an operator; a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        """Write a table and read it; the shuffles behind it are deleted once it is whole, as nothing reads them again."""
        path, before = scratch_path(self.spark), self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table whose readers have all run."""
        path = self._paths.pop(id(df), None)
        if path:
            delete(self.spark, path)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the bounds of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(batches, column: int = 0, limit: int = PIECE_BYTES):
    """Cut batches into runs of whole rows of about ``limit`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        _, bounds = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)
    ], schema=schema)


ship(sys.modules[__name__])
