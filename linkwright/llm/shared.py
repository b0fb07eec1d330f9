"""Tables in the folder that driver and executors share, and input sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import forget, scratch, shared_dir

__all__ = ["apart", "documents", "forget", "input_bytes", "remainder", "scratch", "shared_dir", "shuffle_partitions", "small_batches", "steady", "stored"]


#: Session settings of Arrow batches that the operators put in place of Spark's defaults.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Batches of a few MB between Spark and Python: texts are long, and each task holds some batches on both sides.

    Spark reads these settings when a plan runs, so they stay for the session; one
    that the user has set, to whatever value, isn't touched.
    """
    given = spark._jsparkSession.sessionState().conf()
    for name, small in ARROW.items():
        if not given.contains(name):
            spark.conf.set(name, str(small))


def stored(df: DataFrame, name: str, keep: bool = False, rows: int = 0) -> DataFrame:
    """df written as Parquet to a new folder of the shared directory and read back; see storage.stored."""
    small_batches(df.sparkSession)
    return storage.stored(df, name, keep, rows)


def steady(df: DataFrame, name: str) -> DataFrame:
    """df itself if it is a scan, whose tasks read the same rows in the same order again; else its stored copy.

    For operators that number the rows of a task: behind a shuffle a repeated
    task may meet its rows in another order.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, name) if "Exchange" in plan else df


def input_bytes(df: DataFrame) -> int:
    """Size of a plan's input as Spark's optimizer knows it (file sizes for a scan); 0 if it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0 if size >= 1 << 60 else size


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, n: int):
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The column that stands for all others than doc_id and text while an operator works.
_OTHERS = "__others"


def apart(docs: DataFrame, run: Callable[[DataFrame], DataFrame], added: list[str]) -> DataFrame:
    """run(doc_id, text and one column for all others), then the columns of docs again and those that run added.

    So no column of docs can take the name of one that the operator uses on its
    way; one named like a result is replaced by it.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", *added)]
    if not others:
        return run(docs.select("doc_id", "text")).select("doc_id", "text", *added)
    out = run(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias(_OTHERS)))
    whole = [F.col(c) if c in ("doc_id", "text") else F.col(_OTHERS)[c].alias(c) for c in docs.columns if c not in added]
    return out.select(*whole, *added)
