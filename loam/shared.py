"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and Spark runs within this machine, as in tests, a temporary folder
    is made and set; on a cluster an unset folder is an error, as others would not see what one machine writes."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loam-shared-"))
        where = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Lists the paths in the shared folder that are taken within, so that what only led to a result can be removed."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    path = os.path.join(shared_dir(spark), f"{kind}-{uuid.uuid4().hex}")
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: cuts the lineage, survives lost executors, and
    what is read of a wide table is what is asked for."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever Spark's clients reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def lean_workers(spark: SparkSession) -> None:
    """Python workers that are started from now on give memory back when it is freed: the allocator maps large arrays by
    themselves and keeps little at its ends. A worker serves one stage after another, and would otherwise hold what the
    greediest of them took. What is set already stays."""
    for name, value in (("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", str(256 << 10)), ("MALLOC_TRIM_THRESHOLD_", str(1 << 20)), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        spark.sparkContext.environment.setdefault(name, value)
