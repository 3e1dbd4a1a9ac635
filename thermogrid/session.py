"""Session helpers: UTC clock, shared checkpoint folder, local test session."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from .sources.paths import delete

_WRITTEN: list[str] = []


def use_utc(spark: SparkSession) -> SparkSession:
    """Station clocks carry no zone; a UTC session keeps every hour of the year."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("thermogrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"thermogrid-{application}-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder, to be deleted by :func:`release`."""
    path = f"{shared_dir(spark)}/thermogrid/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    For costly rows that several jobs or passes read. A lost executor then costs a re-read, not a
    recomputation from the source, and each reader takes only the columns it needs.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._thermogrid_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`materialise` whose readers have all run."""
    path = getattr(df, "_thermogrid_path", None)
    if path:
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete what this process wrote under :func:`scratch_path`; call it when its readers are done."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())
