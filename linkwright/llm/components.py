"""Connected components of an edge table, labelled with the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum with a
    map-side combine, until the edges no longer change.  Every round is written
    to the shared folder, so a lost executor repeats one round at most, and the
    tables of earlier rounds are deleted.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while True:
        after = stored(_star(_star(now, large=True), large=False), "edges")
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        forget(now)
        now = after
        if sign == before:
            break
        before = sign
    low = now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    out = stored(now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(low), "labels")
    forget(now)
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every neighbour (large: greater ones; else all smaller ones and itself) is tied to the smallest one."""
    if large:
        both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    else:
        both = edges.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi != lo").distinct()
