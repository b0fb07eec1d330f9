"""Tables in the folder that driver and executors share.

A table that a lazy result still reads can't be deleted by whoever made it.  Work
whose result is stored itself runs in scratch(), which deletes all others made
meanwhile; clean() deletes what is older than some hours.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset and the master is local (as in tests), a folder in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", keep: bool = False, rows: int = 0) -> DataFrame:
    """df written to a new shared folder and read back: plans don't grow, nothing is worked out twice, and no row changes its place.

    keep: not deleted by a scratch() around it.  rows: the most a file holds (0: any number).
    """
    path = new_path(df.sparkSession, name)
    if (made := _made.get()) is not None and not keep:
        made.append(path)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The size of a plan's result as Spark's optimizer knows it: of a stored table, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Delete the folder of a table made by stored(), once nothing reads it again."""
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored meanwhile are deleted in the end; within it, a result to keep is stored by stored(.., keep=True)."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def clean(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete tables in the shared folder that are older than so many hours; gives how many."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs, n = at.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in fs.listStatus(at) if fs.exists(at) else []:
        if re.search(r"-[0-9a-f]{32}$", status.getPath().getName()) and status.getModificationTime() < (time.time() - 3600 * hours) * 1000:
            fs.delete(status.getPath(), True)
            n += 1
    return n
