"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder, but only on a single machine: elsewhere executors wouldn't share it."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "oremill-tables")


_WRITTEN: dict[str, SparkSession] = {}
_NOTES = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clear() -> None:
    """Delete all tables of this process; at its end, or earlier when no result depends on them any more."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(spark, path)


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/oremill/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    if (notes := getattr(_NOTES, "paths", None)) is not None:
        notes.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._oremill_path = path
    return out


def drop(*stored: DataFrame | None) -> None:
    """Delete tables made by store() that nothing reads any more."""
    discard([path for df in stored if (path := getattr(df, "_oremill_path", None))])


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that this thread stores meanwhile, for discard()."""
    outer, _NOTES.paths = getattr(_NOTES, "paths", None), []
    try:
        yield _NOTES.paths
    finally:
        if outer is not None:
            outer += _NOTES.paths
        _NOTES.paths = outer


def discard(paths: list[str], *readers: DataFrame) -> list[str]:
    """Delete the tables at these paths but for those that one of the readers reads; the paths of those."""
    read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in readers for f in df.inputFiles()} if any(p in _WRITTEN for p in paths) else set()
    kept = [p for p in paths if p in _WRITTEN and p.rsplit("/", 1)[-1] in read]
    for path in paths:
        if path not in kept and (spark := _WRITTEN.pop(path, None)):
            _delete(spark, path)
    return kept
