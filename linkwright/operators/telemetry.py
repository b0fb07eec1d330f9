"""Aggregates over traces, errors, jobs, progress and stored results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ordering import running

SLOW, VERY_SLOW, ERRORS, MANY_ERRORS = 5.0, 10.0, 0.1, 0.2


def exact_place(df: DataFrame, keys: list[str], column: str, qs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """For each group the values (numbers) at places int(q n), exactly, without sorting a group in one task.

    A quantile sketch of each group gives, for every place, two values that it lies
    between, some 8 / accuracy of the group apart by rank whatever the values are.
    Values below are counted, and only the distinct ones between are put in order.  A
    place outside (a sketch worse than it promises) is looked for in the whole group.
    """
    rows = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("__v"))
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys], F.lit(True))
    rest = lambda a: [F.col(f"{a}.`{k}`") for k in keys]
    near = lambda q: F.percentile_approx("__v", min(1.0, max(0.0, q)), accuracy)
    ends = [x for i, q in enumerate(qs.values()) for x in (near(q - 4 / accuracy).alias(f"__l{i}"), near(q + 4 / accuracy).alias(f"__h{i}"))]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), *ends)
    place = lambda q: F.least(F.floor(F.lit(q) * F.col("__n")), F.col("__n") - 1).cast("long")
    each = F.array(*[F.struct(F.lit(name).alias("name"), place(q).alias("at"), F.col(f"__l{i}").alias("low"), F.col(f"__h{i}").alias("high")) for i, (name, q) in enumerate(qs.items())])
    bounds = stored(bounds.select(*keys, "__min", "__max", F.explode(each).alias("p")).select(*keys, "__min", "__max", "p.*"), "bounds")
    counted = stored(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__k")), "values")  # distinct values combine before any shuffle
    within = F.when(F.col("v.__v") < F.col("b.low"), 0).when(F.col("v.__v") <= F.col("b.high"), 1)
    sums = counted.alias("v").join(bounds.alias("b"), same("v", "b")).groupBy(*rest("b"), "b.name").agg(F.coalesce(F.sum(F.when(within == 0, F.col("v.__k"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(within == 1, F.col("v.__k"))), F.lit(0)).alias("inside"))
    both = bounds.alias("b").join(sums.alias("s"), same("b", "s") & (F.col("b.name") == F.col("s.name")))
    found = (F.col("s.below") <= F.col("b.at")) & (F.col("b.at") < F.col("s.below") + F.col("s.inside"))
    state = both.select(*rest("b"), "b.name", F.when(found, F.col("b.low")).otherwise(F.col("b.__min")).alias("low"), F.when(found, F.col("b.high")).otherwise(F.col("b.__max")).alias("high"), F.when(found, F.col("b.at") - F.col("s.below")).otherwise(F.col("b.at")).alias("at"))
    held = counted.alias("v").join(state.alias("t"), same("v", "t") & F.col("v.__v").between(F.col("t.low"), F.col("t.high"))).select(*rest("v"), "t.name", "t.at", "v.__v", "v.__k")
    run = held.withColumn("__c", F.sum("__k").over(Window.partitionBy(*keys, "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys).agg(*[F.min(F.when((F.col("name") == name) & (F.col("__c") > F.col("at")), F.col("__v"))).alias(name) for name in qs])


def trace_summary(traces: DataFrame) -> DataFrame:
    """Counts, error rate, mean duration of traces (operation, duration or null while active, status)."""
    done = F.col("duration").isNotNull()
    n, errors = F.count_if(done), F.count_if(done & (F.col("status") == "error"))
    return traces.agg(F.count("*").alias("total"), F.count_if(~done).alias("active"), n.alias("completed"), errors.alias("errors"), F.when(n == 0, 0.0).otherwise(errors / n).alias("error_rate"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"))


def operation_stats(traces: DataFrame) -> DataFrame:
    done = traces.where("duration IS NOT NULL")
    errors = F.count_if(F.col("status") == "error")
    return done.groupBy("operation").agg(F.count("*").alias("n"), F.avg("duration").alias("avg_duration"), F.max("duration").alias("max_duration"), errors.alias("errors"), (errors / F.count("*")).alias("error_rate"))


def bottlenecks(traces: DataFrame, slow: float = SLOW, very_slow: float = VERY_SLOW, errors: float = ERRORS, many: float = MANY_ERRORS) -> DataFrame:
    """Operations that are slow on average or fail often, with a severity."""
    s = operation_stats(traces)
    kinds = F.array(
        F.when(F.col("avg_duration") > slow, F.struct(F.lit("slow_operation").alias("type"), F.when(F.col("avg_duration") > very_slow, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("error_rate") > errors, F.struct(F.lit("high_error_rate").alias("type"), F.when(F.col("error_rate") > many, "high").otherwise("medium").alias("severity"))),
    )
    return s.withColumn("k", F.explode(F.array_compact(kinds))).select("operation", "k.type", "k.severity", "avg_duration", "max_duration", "error_rate")


def satisfaction(high: Column, medium: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.2 * high - 0.1 * medium))


def signature(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def error_groups(events: DataFrame, last: int = 10, seen_from: Column | None = None) -> DataFrame:
    """Errors by signature (columns kind, module, function, line, message, ts, event_id): counts, times, first message, last events.

    seen_from: only groups whose last event isn't earlier.
    """
    keyed = events.withColumn("signature", signature("kind", "module", "function", "line"))
    order = Window.partitionBy("signature").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = keyed.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= last).groupBy("signature").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "event_id"))), lambda x: x["event_id"]).alias("recent"))
    groups = keyed.groupBy("signature").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("message", F.struct("ts", "event_id")).alias("message"))
    groups = groups if seen_from is None else groups.where(F.col("last_seen") >= seen_from)
    return groups.join(recent, "signature")


def last_events(events: DataFrame, key: str, n: int = 10) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def error_statistics(events: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Totals of the last minutes."""
    recent = events.where(F.col("ts") >= now - F.make_dt_interval(mins=F.lit(minutes)))
    return recent.agg(F.count("*").alias("total_errors"), F.countDistinct("kind").alias("unique_types"), (F.count("*") / max(1, minutes)).alias("rate_per_minute"))


def top_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def eta(steps: DataFrame, window: int = 50) -> DataFrame:
    """Remaining seconds of (operation, ts, step, total): mean of the last durations times remaining steps.

    Before there is a duration, the time since started_at (where that column is
    given) over the steps done stands for the mean.
    """
    order = Window.partitionBy("operation").orderBy("ts", "step")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = steps.withColumn("duration", (at - F.lag(at).over(order)) / 1e6)
    mean = F.avg("duration").over(order.rowsBetween(1 - window, 0))
    if "started_at" in steps.columns:
        elapsed = (at - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
        mean = F.coalesce(mean, elapsed / F.greatest(F.col("step"), F.lit(1)))
    left = F.greatest(F.col("total") - F.col("step"), F.lit(0))
    return timed.withColumn("avg_duration", mean).withColumn("eta", F.when((F.col("step") > 0) & (F.col("total") > 0), F.col("avg_duration") * left))


def remaining_time(progress: Column, elapsed: Column) -> Column:
    return F.when(progress > 0, F.floor((100 - progress) / (progress / elapsed)))


def storage_info(results: DataFrame, now: Column) -> DataFrame:
    """Stored results by age (up to a day, a week, a month, older): how many, bytes, and where known compressed, public and shared ones."""
    days = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400
    age = F.when(days <= 1, "1_day").when(days <= 7, "7_days").when(days <= 30, "30_days").otherwise("older")
    kinds = {"compressed": ("compressed", F.col("compressed")), "is_public": ("public", F.col("is_public")), "shared_with": ("shared", F.size("shared_with") > 0)}
    more = [F.count_if(holds).alias(name) for column, (name, holds) in kinds.items() if column in results.columns]
    return results.groupBy(age.alias("age")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *more)


def processed_files(files: DataFrame, recent: int = 10) -> DataFrame:
    """By user (columns user, file_id, processed_at, n_pii, anonymized): files, those with personal data, anonymized ones, the newest files."""
    order = Window.partitionBy("user").orderBy(F.desc("processed_at"), F.desc("file_id"))
    last = files.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= recent).groupBy(F.col("user").alias("__u")).agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "file_id"))), lambda x: x["file_id"]).alias("recent"))
    counts = files.groupBy("user").agg(F.count("*").alias("files"), F.count_if(F.col("n_pii") > 0).alias("with_pii"), F.count_if("anonymized").alias("anonymized"), F.sum("n_pii").alias("n_pii"))
    return counts.join(last, F.col("user").eqNullSafe(F.col("__u"))).drop("__u")


def evict(results: DataFrame, limit: int, target: float = 0.8) -> DataFrame:
    """Results to delete, least recently used first (then by id), until target of the limit is left; running sums go by ranges of rows."""
    total = results.agg(F.sum("size")).first()[0] or 0
    if total <= limit:
        return results.limit(0)
    return running(results, ["last_accessed", "result_id"], F.col("size"), "__freed").where(F.col("__freed") < total - target * limit).select(*results.columns)


def size_class(c: Column) -> Column:
    mb = 1024 * 1024
    return F.when(c < mb, "small").when(c < 10 * mb, "medium").when(c < 100 * mb, "large").otherwise("very_large")


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def health(checks: DataFrame) -> DataFrame:
    """The worst status and the mean duration of checks (status, duration)."""
    some = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    worst = F.when(some("unhealthy"), "unhealthy").when(some("degraded"), "degraded").when(F.count("*") == 0, "unknown").otherwise("healthy")
    return checks.agg(worst.alias("status"), F.count("*").alias("n"), F.avg("duration").alias("avg_duration"))


#: Upper bounds of the buckets of a histogram, the last one open.
BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def histogram(value: Column, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """An aggregate: how many values lie up to each bound, and all of them."""
    return F.array(*[F.count_if(value <= b) for b in bounds], F.count(value))


def histogram_quantile(counts: Column, q: float, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The quantile of a histogram, linear within a bucket; in the open bucket the last bound."""
    rank = F.lit(q) * counts[len(bounds)]
    out, low, below = F.lit(float(bounds[-1])), 0.0, F.lit(0)
    steps = []
    for i, b in enumerate(bounds):
        steps.append((counts[i] >= rank, low + (b - low) * (rank - below) / (counts[i] - below)))
        low, below = b, counts[i]
    for holds, value in reversed(steps):
        out = F.when(holds, value).otherwise(out)
    return F.when(counts[len(bounds)] > 0, out)


def windowed_rates(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Counts, errors, ratios and quantiles by event-time window, for recording rules (columns ts, kind, value)."""
    errors = F.count_if(F.col("kind") == "error")
    g = events.groupBy(F.window("ts", f"{minutes} minutes").alias("w"))
    out = g.agg(F.count("*").alias("n"), errors.alias("errors"), (F.count("*") / (60.0 * minutes)).alias("rate"), (errors / F.count("*")).alias("error_ratio"), F.avg("value").alias("avg_value"), histogram(F.col("value")).alias("h"))
    return out.select(F.col("w.start").alias("window_start"), "n", "errors", "rate", "error_ratio", "avg_value", histogram_quantile(F.col("h"), 0.95).alias("p95"), histogram_quantile(F.col("h"), 0.99).alias("p99"))


def increases(events: DataFrame, hours: int) -> DataFrame:
    """By window of so many hours: events, sum of values, and the share of events that are no errors (columns ts, kind, value)."""
    g = events.groupBy(F.window("ts", f"{hours} hours").alias("w"))
    ok = F.count_if(F.col("kind") != "error") / F.count("*")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("volume"), ok.alias("success_rate")).select(F.col("w.start").alias("window_start"), "n", "volume", "success_rate")


def average_over_time(windows: DataFrame, column: str, days: int = 7) -> DataFrame:
    """By day the mean of a column of finer windows (window_start) over the days up to it; only a row a day is put in order."""
    daily = windows.groupBy(F.date_trunc("day", "window_start").alias("day")).agg(F.sum(column).alias("s"), F.count(column).alias("k"))
    over = daily.select(F.explode(F.sequence("day", F.col("day") + F.make_dt_interval(F.lit(days - 1)), F.expr("INTERVAL 1 DAY"))).alias("day"), "s", "k")
    return over.groupBy("day").agg((F.sum("s") / F.sum("k")).alias("average")).join(daily.select("day"), "day")


def average_by(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(column).alias("average"))


# Alert rules by name: metric, comparison, limit, minutes for which it has to hold.
ALERTS = {
    "HighErrorRate": ("error_rate", ">", 0.1, 2),
    "HighResponseTime": ("response_time_p95", ">", 5, 3),
    "HighMemoryUsage": ("memory_mb", ">", 800, 5),
    "HighCPUUsage": ("cpu_percent", ">", 80, 5),
    "PodRestarting": ("restarts_1h", ">", 0, 0),
    "ServiceDown": ("up", "==", 0, 1),
    "RedisConnectionFailed": ("redis_clients", "==", 0, 2),
    "LowDiskSpace": ("disk_free_percent", "<", 10, 5),
    "HighProcessingQueueSize": ("queue_size", ">", 100, 5),
    "LowMatchingAccuracy": ("matching_accuracy", "<", 0.7, 10),
    "LowProcessingThroughput": ("throughput", "<", 100, 5),
    "LowCacheHitRatio": ("cache_hit_ratio", "<", 0.5, 10),
    "LowUserSatisfaction": ("user_satisfaction", "<", 0.6, 15),
    "HighResourceUtilization": ("resource_percent", ">", 90, 5),
    "HighDataVolumeProcessing": ("data_volume_rate", ">", 100_000_000, 2),
    "NodeNotReady": ("node_ready", "==", 0, 5),
    "PodCrashLooping": ("restart_rate_15m", ">", 0, 5),
    "DeploymentReplicaMismatch": ("missing_replicas", "!=", 0, 5),
}


def alerting(metrics: DataFrame, rules: dict[str, tuple[str, str, float, int]] | None = None, minutes: int = 5) -> DataFrame:
    """(alert, window_start): windows at which a rule has held for its time, from mean values by window (window_start, metric, value).

    A rule of m minutes needs all windows that begin within m minutes up to its own;
    a window without values ends it.
    """
    rules = ALERTS if rules is None else rules
    compare = {">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    each = [F.when((F.col("metric") == m) & compare[op](F.col("value"), F.lit(limit)), F.struct(F.lit(name).alias("alert"), F.lit(max(1, -(-wait // minutes))).alias("need"))) for name, (m, op, limit, wait) in rules.items()]
    hits = metrics.select("window_start", F.explode(F.array_compact(F.array(*each))).alias("r")).select("window_start", "r.*")
    # a hit counts for its own window and for those after it that look back to it
    counted = hits.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("need") - 1))).groupBy("alert", "need", (F.col("window_start") + F.make_dt_interval(mins=F.col("at") * minutes)).alias("window_start"))
    return counted.agg(F.count("*").alias("k"), F.max(F.col("at") == 0).alias("own")).where("own AND k = need").select("alert", "window_start")


def alerts(rates: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each window and rule that holds."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rates.withColumn("alert", F.explode(hits))


def span_tree(spans: DataFrame) -> DataFrame:
    """Depth of every span (span_id, parent_id) under its root; spans with an unknown ancestor are left out, cycles raise.

    Each round doubles the steps that the pointers of unfinished spans lead up, so
    the longest chain of n spans takes about log2(n) rounds.
    """
    spans = stored(spans.select("span_id", "parent_id"))
    done = spans.where("parent_id IS NULL").select("span_id", F.col("span_id").alias("root"), F.lit(0).alias("depth"))
    left = spans.where("parent_id IS NOT NULL").select("span_id", F.col("parent_id").alias("up"))
    steps, n = 1, spans.count()
    while not left.isEmpty():
        if steps > n:
            raise ValueError("the spans' parents form a cycle")
        # left holds all ways of exactly so many steps, done all shorter ones that end at a root
        near = left.alias("l").join(done.alias("d"), F.col("l.up") == F.col("d.span_id")).select("l.span_id", "d.root", (F.col("d.depth") + steps).alias("depth"))
        far = left.alias("l").join(left.alias("r"), F.col("l.up") == F.col("r.span_id")).select("l.span_id", "r.up")
        done, left, steps = stored(done.unionByName(near)), stored(far), 2 * steps
    return done


def places(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, its rows' number from 1 in the order: a count for each range, then numbers inside ranges."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    ranged = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    totals = ranged.groupBy("__p").agg(F.max("__n").alias("__c"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.__c"), F.lit(0)).alias("__b"))
    return ranged.join(F.broadcast(before), "__p").withColumn("place", F.col("__n") + F.col("__b")).drop("__p", "__n", "__b")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows replaced by key; the columns in keep stay as they were where the row existed."""
    old = table.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
    fresh = changes.join(old, keys, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep} if keep else {}).select(*table.columns)
    return table.join(changes.select(*keys), keys, "left_anti").select(*table.columns).unionByName(fresh)


def delete_where_in(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return table.join(keys.select(column).distinct(), column, "left_anti").select(*table.columns)


def compression_stats(stored: DataFrame) -> DataFrame:
    """By kind (columns kind, raw, packed): entries, bytes, overall and mean ratio."""
    return stored.groupBy("kind").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum("packed").alias("packed"), (F.sum("packed") / F.sum("raw")).alias("ratio"), F.avg(F.col("packed") / F.col("raw")).alias("mean_ratio"))


def throughput(n1: int, n2: int, seconds: float) -> float:
    """Comparisons a second that a run of all pairs stands for."""
    return n1 * n2 / seconds if seconds > 0 else 0.0


def observed(df: DataFrame, name: str, *metrics: Column):
    """df and an observation that holds the metrics once df has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *(metrics or (F.count(F.lit(1)).alias("rows"),))), seen


def measured(df: DataFrame, name: str) -> dict:
    """Run a plan for its time and rows alone."""
    import time

    from pyspark.sql import Observation

    seen, began = Observation(f"measured-{name}"), time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return {"name": name, "rows": seen.get["rows"], "ms": (time.perf_counter() - began) * 1000}


def performance_stats(runs: DataFrame) -> DataFrame:
    """By name (columns name, rows, ms): runs, rows, total and mean time, rows a second."""
    g = runs.groupBy("name").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"))
    return g.withColumn("rows_per_second", F.when(F.col("total_ms") > 0, F.col("rows") * 1000.0 / F.col("total_ms")).otherwise(0.0))
