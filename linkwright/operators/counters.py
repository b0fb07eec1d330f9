"""Rates and increases of counters: samples that only grow, but for resets to zero.

A counter's increase is the sum of what it grows by between neighbouring samples of
a series; where a sample is smaller than the one before, the counter was reset and
its whole value counts.  Over a window, the growth between the window's first and
last sample is carried on to the window's ends, as far as the distance of samples
makes likely: up to an end that is no more than 1.1 mean distances away, else by half
a mean distance, and never back beyond where the counter would have been zero.  A
window needs two samples; one with fewer has no rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Mean distances of samples up to which an end of the window is reached.
REACH = 1.1


def with_previous(samples: DataFrame, series: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """samples with previous: a struct of carried of the sample before it in its series, or null.

    Samples are dealt out by ranges of series and order, so one long series is spread
    over many tasks; the last sample of a range is carried on to the first of the
    next one that has any.
    """
    rows = stored(samples.repartitionByRange(*series, *order).withColumn("__range", F.spark_partition_id()), "samples")
    keys, value = F.struct(*series), F.struct(*carried)
    inside = Window.partitionBy("__range").orderBy(*series, *order)
    ranges = rows.groupBy("__range").agg(F.max_by(F.struct(keys.alias("keys"), value.alias("value")), F.struct(*series, *order)).alias("last"))  # a row a range
    before = ranges.alias("a").join(ranges.alias("b"), F.col("b.__range") < F.col("a.__range")).groupBy(F.col("a.__range").alias("__range")).agg(F.max_by(F.col("b.last"), F.col("b.__range")).alias("__before"))
    lagged = rows.withColumn("__last", F.lag(F.struct(keys.alias("keys"), value.alias("value"))).over(inside)).join(before, "__range", "left")
    last = F.coalesce("__last", "__before")
    return lagged.withColumn("previous", F.when(last["keys"].eqNullSafe(keys), last["value"])).drop("__range", "__last", "__before")


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _seconds(c: Column) -> Column:
    return _micros(c) / 1e6


def increases(samples: DataFrame, series: list[str], length: str, slide: str | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Per series and window (columns ts and value): window_start, samples, resets, increase and rate (per second).

    order: what puts the samples of a series in order, its time first.  Windows hold
    their start and not their end.  Windows with fewer than two samples are left out.
    """
    rows = with_previous(samples, series, list(order), ["ts", "value"])
    placed = rows.withColumn("w", F.window("ts", length, slide) if slide else F.window("ts", length))
    inside = F.col("previous.ts") >= F.col("w.start")
    reset = F.col("value") < F.col("previous.value")
    grown = F.when(inside, F.col("value") - F.when(reset, 0.0).otherwise(F.col("previous.value")))
    place = F.struct(*order)
    g = placed.groupBy(*series, "w").agg(
        F.count("*").alias("n"), F.coalesce(F.count_if(inside & reset), F.lit(0)).alias("resets"), F.sum(grown).alias("raw"), F.min_by("value", place).alias("first"),
        _seconds(F.min("ts")).alias("t0"), _seconds(F.max("ts")).alias("t1"))
    g = g.where("n > 1 AND t1 > t0").withColumns({"start": _seconds(F.col("w.start")), "end": _seconds(F.col("w.end")), "span": F.col("t1") - F.col("t0")})
    mean = F.col("span") / (F.col("n") - 1)
    reach = lambda gap: F.when(gap < REACH * mean, gap).otherwise(mean / 2)
    zero = F.when((F.col("raw") > 0) & (F.col("first") >= 0), F.col("span") * F.col("first") / F.col("raw"))  # back to where it was zero
    ahead = F.least(reach(F.col("t0") - F.col("start")), F.coalesce(zero, F.lit(float("inf"))))
    increase = F.col("raw") * ((F.col("span") + ahead + reach(F.col("end") - F.col("t1"))) / F.col("span"))
    out = g.withColumn("increase", increase).withColumn("rate", F.col("increase") / (F.col("end") - F.col("start")))
    return out.select(*series, F.col("w.start").alias("window_start"), F.col("n").alias("samples"), "resets", "increase", "rate")


def latest_rates(samples: DataFrame, series: list[str], length: str, slide: str | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Per series and window the rate between its last two samples: window_start, rate."""
    rows = with_previous(samples, series, list(order), ["ts", "value"])
    placed = rows.withColumn("w", F.window("ts", length, slide) if slide else F.window("ts", length)).where(F.col("previous.ts") >= F.col("w.start"))
    grown = F.col("value") - F.when(F.col("value") < F.col("previous.value"), 0.0).otherwise(F.col("previous.value"))
    last = placed.select(*series, "w", F.struct(*order).alias("o"), grown.alias("grown"), ((_micros(F.col("ts")) - _micros(F.col("previous.ts"))) / 1e6).alias("span"))
    best = last.groupBy(*series, "w").agg(F.max_by(F.struct("grown", "span"), "o").alias("x")).where("x.span > 0")
    return best.select(*series, F.col("w.start").alias("window_start"), (F.col("x.grown") / F.col("x.span")).alias("rate"))
