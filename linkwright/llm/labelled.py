"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remainder, small_batches


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """text and y (0 or 1) of at most `rows` labelled documents, each text once.

    Rows whose crc32(doc_id) mod modulus is held are never read.  Several labels
    of one doc_id count as the largest.  The choice goes by a hash of the doc_id,
    so it is the same in every run; its size bounds the broadcast of its ids.
    """
    small_batches(docs.sparkSession)
    known = labels.where((remainder("doc_id", modulus) != held) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return both.groupBy(F.xxhash64("text").alias("k")).agg(F.min_by(F.struct("text", "y"), "doc_id").alias("r")).select("r.text", "r.y")
