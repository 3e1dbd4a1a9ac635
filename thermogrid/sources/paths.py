"""Existence checks on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    fs, where = _file_system(spark, pattern)
    return sorted(str(s.getPath()) for s in (fs.globStatus(where) or []))


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, where = _file_system(spark, path)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"can't rename {path} to {to}")


def copy(spark: SparkSession, path: str, to: str) -> None:
    """Copy a file or folder within its file system."""
    fs, where = _file_system(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, fs, target, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"can't copy {path} to {to}")


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Relative name and size of every file of a folder, sorted."""
    fs, where = _file_system(spark, path)
    root, found = fs.makeQualified(where).toString().rstrip("/"), []
    listed = fs.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString().removeprefix(root + "/"), status.getLen()))
    return sorted(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
