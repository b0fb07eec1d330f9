"""Counter rates against a plain version, over resets, single samples and many ranges."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from linkwright.operators import counters


def plain(samples, length):
    by = defaultdict(list)
    for k, t, v in sorted(samples, key=lambda s: (s[0] or "", s[1])):
        by[k, t // length].append((t, v))
    out = {}
    for (k, w), xs in by.items():
        if len(xs) < 2 or xs[-1][0] == xs[0][0]:
            continue
        raw = sum(b[1] - (0 if b[1] < a[1] else a[1]) for a, b in zip(xs, xs[1:]))
        span, (first_t, first), last_t = xs[-1][0] - xs[0][0], xs[0], xs[-1][0]
        mean = span / (len(xs) - 1)
        ahead, behind = first_t - w * length, (w + 1) * length - last_t
        ahead = ahead if ahead < 1.1 * mean else mean / 2
        behind = behind if behind < 1.1 * mean else mean / 2
        if raw > 0:
            ahead = min(ahead, span * first / raw)
        last = xs[-1][1] - (0 if xs[-1][1] < xs[-2][1] else xs[-2][1])
        out[k, w * length] = (len(xs), sum(b[1] < a[1] for a, b in zip(xs, xs[1:])), round(raw * (span + ahead + behind) / span, 6), round(last / (xs[-1][0] - xs[-2][0]), 6))
    return out


def test_rates_equal_plain_ones(spark):
    rng = random.Random(3)
    samples = []
    for k, n in (("hot", 3000), ("a", 200), (None, 50), ("one", 1)):
        v, times = 0.0, sorted(rng.sample(range(90_000), n))
        for t in times:
            v = 0.0 if rng.random() < 0.02 else v + rng.choice([0, 0, 1, 5.5])
            samples.append((k, t, v))
    df = spark.createDataFrame(samples, "k string, t long, value double").select("k", F.timestamp_seconds("t").alias("ts"), "value").repartition(11)
    got = {(r["k"], int(r["window_start"].timestamp())): (r["samples"], r["resets"], round(r["increase"], 6)) for r in counters.increases(df, ["k"], "1 hour").collect()}
    want = plain(samples, 3600)
    assert got == {k: v[:3] for k, v in want.items()} and sum(v[1] for v in want.values()) > 30
    rates = {(r["k"], int(r["window_start"].timestamp())): round(r["rate"], 6) for r in counters.latest_rates(df, ["k"], "1 hour").collect()}
    assert rates == {k: v[3] for k, v in want.items()}
    plan = counters.increases(df, ["k"], "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(k" not in plan and "SinglePartition" not in plan
    assert counters.increases(df.limit(0), ["k"], "1 hour").collect() == []
