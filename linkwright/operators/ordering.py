"""Row numbers and running sums of a whole table, and sorted neighbours, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over all rows before it in the order of the columns (nulls first).

    Rows are dealt out by ranges of the order and stored, so that their range is
    fixed; a row's sum is that of smaller ranges and of the rows before it in its own.
    Rows equal in all columns of the order stay in one range, so end it with an id.
    """
    rows = stored(df.repartitionByRange(*order).withColumns({"__range": F.spark_partition_id(), "__value": value}), "ranges")
    sizes = rows.groupBy("__range").agg(F.sum("__value").alias("__n"))  # a row a range
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__range") < F.col("a.__range"), "left")
    before = before.groupBy(F.col("a.__range").alias("__range")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    earlier = Window.partitionBy("__range").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("__in", F.coalesce(F.sum("__value").over(earlier), F.lit(0)))
    return inside.join(before, "__range").withColumn(name, F.col("__before") + F.col("__in")).drop("__range", "__value", "__in", "__before")


def numbered(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """df with name: 0, 1, ... in the order of the columns, nulls first; see running()."""
    return running(df, order, F.lit(1).cast("long"), name)


def within(left: DataFrame, right: DataFrame, place: str, reach: int) -> DataFrame:
    """Rows of both sides whose places differ by less than reach, joined on stretches of the order: none has more than reach rows of a side."""
    stretch = F.floor(F.col(place) / reach)
    near = left.withColumn("__stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1))).withColumnRenamed(place, f"{place}1")
    both = near.join(right.withColumn("__stretch", stretch).withColumnRenamed(place, f"{place}2"), "__stretch")
    return both.where(F.abs(F.col(f"{place}1") - F.col(f"{place}2")) < reach).drop("__stretch")


def _keyed(df: DataFrame, id_column: str, key: Column, side: int) -> DataFrame:
    return df.select(key.alias("key"), F.lit(side).alias("side"), F.col(id_column).alias("id")).where("key IS NOT NULL AND key <> ''")


def neighbours(df: DataFrame, id_column: str, key: Column, window: int) -> DataFrame:
    """(id1, id2) of the records of one table that stand less than window places apart when sorted by key and id, the earlier one first.

    Records with a null or empty key have no neighbours.
    """
    _check(window)
    rows = stored(numbered(_keyed(df, id_column, key, 0), ["key", "id"]).select("id", "place"), "places")
    pairs = within(rows.withColumnRenamed("id", "id1"), rows.withColumnRenamed("id", "id2"), "place", window)
    return pairs.where("place1 < place2").select("id1", "id2")


def neighbour_pairs(d1: DataFrame, d2: DataFrame, id1: str, id2: str, keys: Iterable[tuple[Column, Column]], window: int) -> DataFrame:
    """Distinct (id1, id2) of two tables, sorted together by each of the keys: records of both less than window places apart in one of the orders."""
    _check(window)
    out = None
    for key1, key2 in keys:
        both = _keyed(d1, id1, key1, 1).unionByName(_keyed(d2, id2, key2, 2).withColumn("id", F.col("id").cast(d1.schema[id1].dataType)))
        rows = stored(numbered(both, ["key", "side", "id"]).select("id", "side", "place"), "places")
        pairs = within(rows.where("side = 1").select(F.col("id").alias("id1"), "place"), rows.where("side = 2").select(F.col("id").alias("id2"), "place"), "place", window)
        out = pairs.select("id1", "id2") if out is None else out.union(pairs.select("id1", "id2"))
    if out is None:
        raise ValueError("at least one key is needed")
    return out.distinct()


def _check(window: int) -> None:
    if window < 2:
        raise ValueError("a window has two places at least")
