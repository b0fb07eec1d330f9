"""Queries over telemetry: traces, errors, jobs, windows, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import counters
from .operators import telemetry as T
from .registry import query, table
from .storage import new_path
from .streaming import alerting, monitor

NOW = "2024-01-20 00:00:00"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def traces(spark, sf_dir):
    """Events as traces: the type is the operation, the value its duration; errors fail, some are still active."""
    e = events(spark, sf_dir)
    return e.select("event_id", F.col("event_type").alias("operation"), F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("duration"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("ok").alias("status"))


TRACES = "(SELECT event_id, event_type AS operation, CASE WHEN event_id % 50 <> 0 THEN value END AS duration, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status FROM events) t"


@query(f"SELECT count(*) AS total, count(*) FILTER (duration IS NULL) AS active, count(duration) AS completed, count(*) FILTER (duration IS NOT NULL AND status = 'error') AS errors, round(count(*) FILTER (duration IS NOT NULL AND status = 'error')::DOUBLE / count(duration), 6) AS error_rate, round(avg(duration), 6) AS avg_duration FROM {TRACES}")
def trace_summary(spark, sf_dir):
    return T.trace_summary(traces(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("error_rate", "avg_duration")})


_L = "list_sort(list(duration) FILTER (duration IS NOT NULL))"


@query(f"SELECT operation, {_L}[least(floor(0.95 * count(duration)), count(duration) - 1)::BIGINT + 1] AS p95, {_L}[least(floor(0.99 * count(duration)), count(duration) - 1)::BIGINT + 1] AS p99 FROM {TRACES} GROUP BY operation")
def trace_percentiles(spark, sf_dir):
    return T.exact_place(traces(spark, sf_dir), ["operation"], "duration", {"p95": 0.95, "p99": 0.99})


_OPS = f"SELECT operation, count(*) AS n, round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration, count(*) FILTER (status = 'error') AS errors, round(count(*) FILTER (status = 'error')::DOUBLE / count(*), 6) AS error_rate FROM {TRACES} WHERE duration IS NOT NULL GROUP BY operation"


@query(_OPS)
def trace_operations(spark, sf_dir):
    return T.operation_stats(traces(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("avg_duration", "error_rate")})


@query(f"WITH o AS ({_OPS}) SELECT operation, 'slow_operation' AS type, CASE WHEN avg_duration > 10 THEN 'high' ELSE 'medium' END AS severity FROM o WHERE avg_duration > 5 UNION ALL SELECT operation, 'high_error_rate', CASE WHEN error_rate > 0.2 THEN 'high' ELSE 'medium' END FROM o WHERE error_rate > 0.1")
def trace_bottlenecks(spark, sf_dir):
    return T.bottlenecks(traces(spark, sf_dir)).select("operation", "type", "severity")


@query(f"WITH o AS ({_OPS}), s AS (SELECT count(*) FILTER (avg_duration > 10) AS h, count(*) FILTER (avg_duration BETWEEN 5 AND 10) AS m FROM o) SELECT round(greatest(0.0, least(1.0, 1 - 0.2 * h - 0.1 * m))::DOUBLE, 6) AS score FROM s")
def satisfaction_score(spark, sf_dir):
    o = T.operation_stats(traces(spark, sf_dir))
    s = o.agg(F.count_if(F.col("avg_duration") > 10).alias("h"), F.count_if(F.col("avg_duration").between(5, 10)).alias("m"))
    return s.select(F.round(T.satisfaction(F.col("h"), F.col("m")), 6).alias("score"))


def errors(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", "ts", F.col("event_type").alias("kind"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("module"), F.lit("f").alias("function"), (F.col("user_id") % 3).cast("string").alias("line"), F.col("props").alias("message"))


ERRORS = "(SELECT event_id, ts, event_type AS kind, 'm' || (user_id % 4)::VARCHAR AS module, 'f' AS function, (user_id % 3)::VARCHAR AS line, props AS message FROM events) e"


@query(f"SELECT md5(concat_ws(':', kind, module, function, line)) AS signature, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(message, (ts, event_id)) AS message, (list(event_id ORDER BY ts DESC, event_id DESC))[1:10] AS recent FROM {ERRORS} GROUP BY kind, module, function, line")
def error_groups(spark, sf_dir):
    return T.error_groups(errors(spark, sf_dir))


@query(f"SELECT md5(concat_ws(':', kind, module, function, line)) AS signature, count(*) AS n FROM {ERRORS} GROUP BY kind, module, function, line HAVING max(ts) >= TIMESTAMP '2024-01-30 18:00:00'")
def error_groups_since(spark, sf_dir):
    """Groups that were seen in a time window."""
    since = F.lit("2024-01-30 18:00:00").cast(events(spark, sf_dir).schema["ts"].dataType)
    return T.error_groups(errors(spark, sf_dir), seen_from=since).select("signature", "n")


@query(f"SELECT count(*) AS total_errors, count(DISTINCT kind) AS unique_types, round(count(*) / 1440.0::DOUBLE, 6) AS rate_per_minute FROM {ERRORS} WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 1440 MINUTE")
def error_statistics(spark, sf_dir):
    now = F.lit(NOW).cast(events(spark, sf_dir).schema["ts"].dataType)
    return T.error_statistics(errors(spark, sf_dir), now, 1440).withColumn("rate_per_minute", F.round("rate_per_minute", 6))


@query(f"SELECT module, count(*) AS n FROM {ERRORS} GROUP BY module ORDER BY n DESC, module LIMIT 10")
def error_top_modules(spark, sf_dir):
    return T.top_counts(errors(spark, sf_dir), "module")


@query(f"SELECT kind, event_id, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS rank FROM {ERRORS} QUALIFY rank <= 10")
def error_last_events(spark, sf_dir):
    return T.last_events(errors(spark, sf_dir), "kind").select("kind", "event_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def job_queue_stats(spark, sf_dir):
    return T.counts_by(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query("SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_orderdate NULLS FIRST, o_orderkey) AS place FROM orders")
def job_queue_places(spark, sf_dir):
    """Every job with its place in the order, from 1."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return T.places(o, [F.desc("priority"), F.asc("created_at"), F.asc("job_id")]).select("job_id", "place")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def newest_first(spark, sf_dir):
    from .operators.results import newest

    return newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 25, ("o_orderkey",))


@query("""WITH s AS (SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS d FROM events),
a AS (SELECT *, coalesce(avg(d) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / greatest(event_id, 1)) AS m FROM s)
SELECT user_id AS operation, event_id AS step, round(d, 6) AS duration, round(m, 4) AS avg_duration, round(CASE WHEN event_id > 0 THEN m * greatest(5000 - event_id, 0) END, 1) AS eta FROM a""")
def progress_eta(spark, sf_dir):
    s = events(spark, sf_dir).select(F.col("user_id").alias("operation"), "ts", F.col("event_id").alias("step"), F.lit(5000).alias("total"), F.lit("2024-01-01").cast("timestamp").alias("started_at"))
    return T.eta(s).select("operation", "step", F.round("duration", 6).alias("duration"), F.round("avg_duration", 4).alias("avg_duration"), F.round("eta", 1).alias("eta"))


@query("SELECT o_orderkey, CASE WHEN p > 0 THEN floor((100 - p) / (p / e))::BIGINT END AS remaining FROM (SELECT o_orderkey, (o_orderkey % 101)::DOUBLE AS p, (o_custkey + 1)::DOUBLE AS e FROM orders)")
def remaining_time(spark, sf_dir):
    progress, elapsed = (F.col("o_orderkey") % 101).cast("double"), (F.col("o_custkey") + 1).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.remaining_time(progress, elapsed).alias("remaining"))


_STORED = "(SELECT o_orderkey AS result_id, round(o_totalprice)::BIGINT AS size, o_orderdate AS created_at, o_orderstatus = 'O' AS is_public, o_orderkey % 3 = 0 AS compressed, CASE WHEN o_orderkey % 5 = 0 THEN ['a'] ELSE [] END AS shared_with FROM orders) r"


def stored_results(spark, sf_dir):
    key = F.col("o_orderkey")
    shared_with = F.when(key % 5 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select(key.alias("result_id"), F.round("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("last_accessed"), (F.col("o_orderstatus") == "O").alias("is_public"), (key % 3 == 0).alias("compressed"), shared_with.alias("shared_with"))


@query(f"SELECT CASE WHEN d <= 1 THEN '1_day' WHEN d <= 7 THEN '7_days' WHEN d <= 30 THEN '30_days' ELSE 'older' END AS age, count(*) AS n, sum(size)::BIGINT AS bytes, count(*) FILTER (compressed) AS compressed, count(*) FILTER (is_public) AS public, count(*) FILTER (len(shared_with) > 0) AS shared FROM (SELECT *, (epoch(TIMESTAMP '1998-01-01') - epoch(created_at)) / 86400 AS d FROM {_STORED}) GROUP BY 1")
def storage_by_age(spark, sf_dir):
    r = stored_results(spark, sf_dir)
    return T.storage_info(r.withColumn("created_at", F.col("created_at").cast("timestamp")), F.lit("1998-01-01").cast("timestamp"))


@query("SELECT o_orderstatus AS user, count(*) AS files, count(*) FILTER (o_orderkey % 4 > 0) AS with_pii, count(*) FILTER (o_orderkey % 2 = 0) AS anonymized, sum(o_orderkey % 4)::BIGINT AS n_pii, (list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC))[1:10] AS recent FROM orders GROUP BY 1")
def processed_files(spark, sf_dir):
    key = F.col("o_orderkey")
    return T.processed_files(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("user"), key.alias("file_id"), F.col("o_orderdate").alias("processed_at"), (key % 4).alias("n_pii"), (key % 2 == 0).alias("anonymized")))


@query("WITH r AS (SELECT o_orderkey AS result_id, round(o_totalprice)::BIGINT AS size, o_orderdate AS t FROM orders), c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY t, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(size) OVER () AS total FROM r) SELECT result_id FROM c WHERE freed < total - 0.8 * 100000000")
def storage_eviction(spark, sf_dir):
    r = stored_results(spark, sf_dir).withColumn("last_accessed", F.col("last_accessed").cast("timestamp"))
    return T.evict(r, 100_000_000).select("result_id")


@query("SELECT CASE WHEN l_extendedprice * 1000 < 1048576 THEN 'small' WHEN l_extendedprice * 1000 < 10485760 THEN 'medium' WHEN l_extendedprice * 1000 < 104857600 THEN 'large' ELSE 'very_large' END AS size_class, CASE WHEN l_discount * 10 >= 0.9 THEN 'high' WHEN l_discount * 10 >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_class, count(*) AS n FROM lineitem GROUP BY ALL")
def metric_buckets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(T.size_class(F.col("l_extendedprice") * 1000).alias("size_class"), T.confidence_class(F.col("l_discount") * 10).alias("confidence_class")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN bool_or(event_type = 'error') THEN 'unhealthy' ELSE 'healthy' END AS status, count(*) AS n, round(avg(value), 6) AS avg_duration FROM events")
def health_rollup(spark, sf_dir):
    checks = events(spark, sf_dir).select(F.when(F.col("event_type") == "error", "unhealthy").otherwise("healthy").alias("status"), F.col("value").alias("duration"))
    return T.health(checks).withColumn("avg_duration", F.round("avg_duration", 6))


def _sql_quantile(q: float) -> str:
    """Linear within the bucket of a histogram over T.BOUNDS that holds the rank."""
    upto = [f"count(*) FILTER (value <= {b})" for b in T.BOUNDS]
    cases, low, below = [], 0.0, "0"
    for b, n in zip(T.BOUNDS, upto, strict=True):
        cases.append(f"WHEN {n} >= {q}::DOUBLE * count(value) THEN {low} + ({b} - {low})::DOUBLE * ({q}::DOUBLE * count(value) - {below}) / ({n} - {below})")
        low, below = b, n
    return f"CASE {' '.join(cases)} ELSE {T.BOUNDS[-1]} END"


_RATES = f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) / 300.0::DOUBLE, 9) AS rate, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 6) AS error_ratio, round(avg(value), 6) AS avg_value, round({_sql_quantile(0.95)}, 6) AS p95, round({_sql_quantile(0.99)}, 6) AS p99 FROM events GROUP BY 1"


def _rates(spark, sf_dir, minutes=5):
    return T.windowed_rates(events(spark, sf_dir).withColumnRenamed("event_type", "kind"), minutes)


def _rounded_rates(spark, sf_dir):
    return _rates(spark, sf_dir).withColumns({c: F.round(c, 9 if c == "rate" else 6) for c in ("rate", "error_ratio", "avg_value", "p95", "p99")})


@query(_RATES)
def recording_rules(spark, sf_dir):
    return _rounded_rates(spark, sf_dir)


def _sql_increase(hours: int) -> str:
    return f"SELECT time_bucket(INTERVAL {hours} HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, round(sum(value), 4) AS volume, round(count(*) FILTER (event_type <> 'error')::DOUBLE / count(*), 6) AS success_rate FROM events GROUP BY 1"


@query(f"SELECT 1 AS hours, * FROM ({_sql_increase(1)}) UNION ALL SELECT 24, * FROM ({_sql_increase(24)})")
def recording_increases(spark, sf_dir):
    e = events(spark, sf_dir).withColumnRenamed("event_type", "kind")
    hourly, daily = (T.increases(e, h).select(F.lit(h).alias("hours"), "window_start", "n", F.round("volume", 4).alias("volume"), F.round("success_rate", 6).alias("success_rate")) for h in (1, 24))
    return hourly.unionByName(daily)


@query(f"WITH r AS ({_RATES}), d AS (SELECT date_trunc('day', window_start)::TIMESTAMP AS day, sum(avg_value) AS s, count(avg_value) AS k FROM r GROUP BY 1) SELECT a.day, round(sum(b.s) / sum(b.k), 5) AS average FROM d a JOIN d b ON b.day > a.day - INTERVAL 7 DAY AND b.day <= a.day GROUP BY a.day")
def recording_weekly_average(spark, sf_dir):
    return T.average_over_time(_rounded_rates(spark, sf_dir), "avg_value").select("day", F.round("average", 5).alias("average"))


def _counter(spark, sf_dir):
    """A counter of events by type that is reset every midnight: a sample at each event."""
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_type", "ts", "event_id", F.row_number().over(day).cast("double").alias("value"))


_COUNTER = """WITH s AS (SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id)::DOUBLE AS value FROM events),
p AS (SELECT *, lag(value) OVER v AS pv, lag(ts) OVER v AS pt FROM s WINDOW v AS (PARTITION BY event_type ORDER BY ts, event_id)),
w AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * i AS ws FROM p, range(6) r(i))"""


@query(f"""{_COUNTER},
g AS (SELECT event_type, ws, count(*) AS n, count(*) FILTER (pt >= ws AND value < pv) AS resets, sum(CASE WHEN pt >= ws THEN value - CASE WHEN value < pv THEN 0 ELSE pv END END) AS raw,
      arg_min(value, (ts, event_id)) AS first, epoch_us(min(ts)) / 1e6 AS t0, epoch_us(max(ts)) / 1e6 AS t1 FROM w GROUP BY 1, 2 HAVING count(*) > 1),
e AS (SELECT *, epoch_us(ws) / 1e6 AS a, epoch_us(ws) / 1e6 + 21600 AS b, t1 - t0 AS span, (t1 - t0) / (n - 1) AS mean FROM g WHERE t1 > t0),
x AS (SELECT *, CASE WHEN t0 - a < 1.1 * mean THEN t0 - a ELSE mean / 2 END AS ahead, CASE WHEN b - t1 < 1.1 * mean THEN b - t1 ELSE mean / 2 END AS behind, CASE WHEN raw > 0 THEN span * first / raw END AS zero FROM e),
r AS (SELECT *, raw * (span + least(ahead, zero) + behind) / span AS increase FROM x)
SELECT event_type, ws AS window_start, n AS samples, resets, round(increase, 5) AS increase, round(increase / 21600, 8) AS rate FROM r""")
def recording_counter_rates(spark, sf_dir):
    """Increase and rate of a counter with resets, over six hours from every hour on."""
    r = counters.increases(_counter(spark, sf_dir), ["event_type"], "6 hours", "1 hour", ("ts", "event_id"))
    return r.withColumns({"increase": F.round("increase", 5), "rate": F.round("rate", 8)})


@query(f"""{_COUNTER}, l AS (SELECT event_type, ws, value - CASE WHEN value < pv THEN 0 ELSE pv END AS grown, (epoch_us(ts) - epoch_us(pt)) / 1e6 AS span, row_number() OVER (PARTITION BY event_type, ws ORDER BY ts DESC, event_id DESC) AS k FROM w WHERE pt >= ws)
SELECT event_type, ws AS window_start, round(grown / span, 8) AS rate FROM l WHERE k = 1 AND span > 0""")
def recording_latest_rates(spark, sf_dir):
    """The counter's rate between the last two samples of the same windows."""
    return counters.latest_rates(_counter(spark, sf_dir), ["event_type"], "6 hours", "1 hour", ("ts", "event_id")).withColumn("rate", F.round("rate", 8))


@query("SELECT event_type, round(avg(value), 6) AS average FROM events GROUP BY 1")
def recording_average_by(spark, sf_dir):
    return T.average_by(events(spark, sf_dir), "event_type", "value").withColumn("average", F.round("average", 6))


_METRICS = {"queue_size": "sum(value)", "cpu_percent": "max(value)", "throughput": "3 * sum(value)", "matching_accuracy": "avg(value) / 100", "user_satisfaction": "least(1, avg(value) / 60)", "up": "CASE WHEN min(value) > 2 THEN 1 ELSE 0 END", "missing_replicas": "count(CASE WHEN event_type = 'error' THEN 1 END)"}
_WINDOWS = " UNION ALL ".join(f"SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, '{m}' AS metric, round(({x})::DOUBLE, 6) AS value FROM events GROUP BY 1" for m, x in _METRICS.items())


def _sql_alert(name: str) -> str:
    metric, op, limit, wait = T.ALERTS[name]
    need = max(1, -(-wait // 5))
    hit = f"SELECT window_start FROM w WHERE metric = '{metric}' AND value {'=' if op == '==' else op} {limit}"
    back = " ".join(f"AND window_start - INTERVAL {5 * k} MINUTE IN ({hit})" for k in range(1, need))
    return f"SELECT '{name}' AS alert, window_start FROM ({hit}) WHERE true {back}"


@query(f"WITH w AS MATERIALIZED ({_WINDOWS}) " + " UNION ALL ".join(_sql_alert(name) for name, rule in T.ALERTS.items() if rule[0] in _METRICS))
def alert_rules(spark, sf_dir):
    """The rules whose metrics can be made of events, each with the time for which it has to hold."""
    e = events(spark, sf_dir).groupBy(F.window("ts", "5 minutes").alias("w"))
    each = e.agg(*[F.expr(f"round(cast({x} AS double), 6)").alias(m) for m, x in _METRICS.items()])
    rows = each.select(F.col("w.start").alias("window_start"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _METRICS])).alias("r")).select("window_start", "r.*")
    return T.alerting(rows)


@query(f"WITH r AS ({_RATES}) SELECT window_start, 'many_errors' AS alert FROM r WHERE error_ratio > 0.5 UNION ALL SELECT window_start, 'low_rate' FROM r WHERE n < 2")
def alert_conditions(spark, sf_dir):
    rules = {"many_errors": F.col("error_ratio") > 0.5, "low_rate": F.col("n") < 2}
    return T.alerts(_rates(spark, sf_dir), rules).select("window_start", "alert")


_TRIED = "(SELECT o_orderkey AS job_id, o_orderkey % 7 AS k FROM orders)"


@query(f"SELECT job_id, CASE WHEN k <= 3 THEN 'done' ELSE 'dead' END AS status, least(k, 4)::INTEGER AS retries FROM {_TRIED}")
def queue_work(spark, sf_dir):
    """Every order as a message that succeeds at its o_orderkey % 7-th repetition; dead after three."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return monitor.work(monitor.put(o), lambda m: m.withColumn("acknowledged", F.col("retries") >= F.col("job_id") % 7)).select("job_id", "status", "retries")


@query(f"SELECT CASE WHEN k <= 3 THEN 'done' ELSE 'dead' END AS status, count(*) AS n, sum(least(k, 4))::BIGINT AS retries FROM {_TRIED} GROUP BY 1")
def queue_stats(spark, sf_dir):
    return monitor.queue_stats(queue_work(spark, sf_dir))


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'queued' ELSE 'queued' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS retries FROM orders")
def queue_settle(spark, sf_dir):
    """A round in which a third of the messages succeed, a third fail and a third aren't tried."""
    o = monitor.put(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at")))
    tried = o.where("job_id % 3 < 2").select("job_id", (F.col("job_id") % 3 == 0).alias("acknowledged"))
    return monitor.settle(o, tried).select("job_id", "status", "retries")


@query("SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 100")
def queue_take(spark, sf_dir):
    """The next hundred messages."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return monitor.take(monitor.put(o), 100).select("job_id")


@query("WITH RECURSIVE t AS (SELECT turn + conv_id * 1000 AS span_id, 0 AS depth, turn + conv_id * 1000 AS root FROM conversations WHERE turn = 0 UNION ALL SELECT c.turn + c.conv_id * 1000, t.depth + 1, t.root FROM conversations c JOIN t ON c.turn + c.conv_id * 1000 - 1 = t.span_id AND c.turn > 0) SELECT DISTINCT span_id, root, depth FROM t")
def span_tree(spark, sf_dir):
    key = F.col("turn") + F.col("conv_id") * 1000
    spans = table(spark, sf_dir, "conversations").select(key.alias("span_id"), F.when(F.col("turn") > 0, key - 1).alias("parent_id")).distinct()
    return T.span_tree(spans)


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def table_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return T.upsert(s, changes, ["s_suppkey"], keep=("s_name",))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def table_delete_subquery(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return T.delete_where_in(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), old, "o_custkey").select("o_orderkey")


@query("SELECT l_returnflag AS kind, count(*) AS n, round(sum(l_tax * l_extendedprice) / sum(l_extendedprice), 6) AS ratio, round(avg(l_tax), 6) AS mean_ratio FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def compression_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0")
    s = T.compression_stats(li.select(F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("raw"), (F.col("l_tax") * F.col("l_extendedprice")).alias("packed")))
    return s.select("kind", "n", F.round("ratio", 6).alias("ratio"), F.round("mean_ratio", 6).alias("mean_ratio"))


@query("SELECT c_custkey, CASE WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0::DOUBLE) ELSE printf('%.1f MB', b / 1048576.0::DOUBLE) END AS size, CASE WHEN b >= 3600 THEN printf('%dh %dm %ds', b // 3600, b % 3600 // 60, b % 60) WHEN b >= 60 THEN printf('%dm %ds', b // 60, b % 60) ELSE printf('%ds', b) END AS took FROM (SELECT c_custkey, c_custkey * 37 + 5 AS b FROM customer)")
def readable_sizes(spark, sf_dir):
    from .functions.formatting import duration_text, size_text

    b = F.col("c_custkey") * 37 + 5
    return table(spark, sf_dir, "customer").select("c_custkey", size_text(b).alias("size"), duration_text(b).alias("took"))


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS text, true AS same FROM events")
def iso_times(spark, sf_dir):
    from .functions.formatting import iso_text, iso_time

    e = events(spark, sf_dir).select("event_id", "ts", iso_text(F.col("ts")).alias("text"))
    return e.select("event_id", "text", (iso_time(F.col("text")) == F.col("ts").cast("timestamp")).alias("same"))


@query("SELECT event_type AS name, count(*) AS runs, sum(user_id)::BIGINT AS rows, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, round(sum(user_id) * 1000.0::DOUBLE / sum(value), 4) AS rows_per_second FROM events GROUP BY 1")
def performance_stats(spark, sf_dir):
    runs = events(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("user_id").alias("rows"), F.col("value").alias("ms"))
    return T.performance_stats(runs).withColumns({"total_ms": F.round("total_ms", 4), "mean_ms": F.round("mean_ms", 6), "rows_per_second": F.round("rows_per_second", 4)})


# ---- streams over the event table, run to the end of what is there


def event_stream(spark, sf_dir):
    schema = events(spark, sf_dir).schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS highest FROM events GROUP BY 1, 2")
def stream_window_stats(spark, sf_dir):
    rows = monitor.run_once(monitor.window_stats(event_stream(spark, sf_dir), "event_type", "value"))
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total", "highest"), "n").alias("s"))
    return last.select("window_start", "event_type", "s.n", F.round("s.total", 4).alias("total"), "s.highest")


@query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest(range(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 1 MINUTE, INTERVAL 15 MINUTE)) AS w FROM events) GROUP BY ALL")
def stream_sliding_counts(spark, sf_dir):
    rows = monitor.run_once(monitor.sliding_counts(event_stream(spark, sf_dir), "event_type", "60 minutes", "15 minutes"))
    return rows.groupBy("window_start", "event_type").agg(F.max("n").alias("n"))


@query("""WITH RECURSIVE h AS (SELECT 'user ' || (user_id % 5)::VARCHAR AS rule, ts, value FROM events WHERE event_type = 'error'),
a AS (SELECT rule, min(ts) AS ts FROM h GROUP BY rule UNION ALL SELECT a.rule, min(h.ts) FROM a JOIN h ON h.rule = a.rule AND h.ts >= a.ts + INTERVAL 1 HOUR GROUP BY a.rule)
SELECT a.rule, a.ts, h.value FROM a JOIN h ON h.rule = a.rule AND h.ts = a.ts""")
def stream_alerts(spark, sf_dir):
    hits = event_stream(spark, sf_dir).where("event_type = 'error'").select(F.concat(F.lit("user "), (F.col("user_id") % 5).cast("string")).alias("rule"), "ts", "value")
    return monitor.run_once(monitor.alerts(hits, 3600.0), "append").drop("batch")


def _alerts_in_parts(hits, cooldown, parts, late):
    """Alerts of a table of hits that arrives in parts, each a start of the stream: by their time and some minutes more or less."""
    spark, root = hits.sparkSession, new_path(hits.sparkSession, "alerts")
    hits = hits.withColumn("ts", F.col("ts").cast("timestamp"))
    ends = hits.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    if ends["a"] is None:
        return spark.createDataFrame([], "rule string, ts timestamp, value double")
    arrived = F.unix_micros("ts") - ends["a"] + F.pmod(F.xxhash64("ts", "rule"), F.lit(3_600_000_000))
    part = F.least(F.floor(arrived * parts / (ends["b"] - ends["a"] + 3_600_000_000)), F.lit(parts - 1)).cast("int")
    with alerting.settings(spark):
        for k in range(parts):
            hits.where(part == k).write.parquet(f"{root}/in/{k}")
            if k == parts - 1:
                alerting.end_mark(spark, F.timestamp_micros(F.lit(ends["b"]).cast("long")) + F.expr("INTERVAL 1000 DAYS")).write.parquet(f"{root}/in/end")
            stream = spark.readStream.schema("rule string, ts timestamp, value double").option("recursiveFileLookup", "true").parquet(f"{root}/in")
            sink = alerting.alerts(stream, cooldown, late).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
            sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("rule string, ts timestamp, value double").parquet(f"{root}/out")


@query("""WITH RECURSIVE h AS (SELECT 'user ' || (user_id % 20)::VARCHAR AS rule, ts, value FROM events WHERE event_type = 'error'),
a AS (SELECT rule, min(ts) AS ts FROM h GROUP BY rule UNION ALL SELECT a.rule, min(h.ts) FROM a JOIN h ON h.rule = a.rule AND h.ts >= a.ts + INTERVAL 1 HOUR GROUP BY a.rule)
SELECT a.rule, a.ts::TIMESTAMP AS ts, min(h.value) AS value FROM a JOIN h ON h.rule = a.rule AND h.ts = a.ts GROUP BY ALL""")
def stream_alerts_by_time(spark, sf_dir):
    """Errors by group of users, an hour apart, of events that arrive in three parts, up to an hour late."""
    hits = events(spark, sf_dir).where("event_type = 'error'").select(F.concat(F.lit("user "), (F.col("user_id") % 20).cast("string")).alias("rule"), "ts", "value")
    return _alerts_in_parts(hits, 3600.0, 3, "2 hours")


@query("SELECT user_id AS operation, coalesce(arg_min(event_type, ts) FILTER (event_type = 'error'), arg_max(event_type, ts)) AS status FROM events GROUP BY user_id")
def progress_states(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("user_id").alias("operation"), "ts", F.col("event_type").alias("status"), F.col("event_id").alias("done"))
    return monitor.progress(e).select("operation", "status")
