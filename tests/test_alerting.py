"""Alerts by event time: the same in one start and in many, with late hits and ties."""

import datetime as dt
import random

from pyspark.sql import functions as F

from linkwright.catalog_telemetry import _alerts_in_parts
from linkwright.streaming import alerting


def plain(hits, cooldown):
    last, out = {}, set()
    for rule, ts, value in sorted(hits):
        if rule not in last or (ts - last[rule]).total_seconds() >= cooldown:
            last[rule] = ts
            out.add((rule, ts, value))
    return out


def test_one_start_and_many_give_the_same_alerts(spark):
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    hits = [(rng.choice("abbbb"), start + dt.timedelta(seconds=rng.randrange(400_000), microseconds=rng.randrange(3)), float(rng.randrange(9))) for _ in range(3000)]
    hits += hits[:50] + [(r, t, v + 1) for r, t, v in hits[:50]]
    df = spark.createDataFrame(hits, "rule string, ts timestamp, value double").repartition(5)
    want = plain(hits, 3000)
    assert len(want) > 100
    for parts in (1, 4):
        got = [tuple(r) for r in _alerts_in_parts(df, 3000.0, parts, "2 hours").collect()]
        assert set(got) == want and len(got) == len(want)
    assert _alerts_in_parts(df.limit(0), 3000.0, 2, "2 hours").collect() == []


def test_spaced_times():
    import numpy as np

    assert alerting.spaced(np.array([0, 5, 9, 10, 30]), None, 10) == [0, 3, 4]
    assert alerting.spaced(np.array([0, 5, 9, 10, 30]), 1, 10) == [4]
    assert alerting.spaced(np.array([], np.int64), 1, 10) == []


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.unloadOnCommit"
    before = spark.conf.get(name, None)
    with alerting.settings(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before
    assert alerting.end_mark(spark, F.current_timestamp()).first()["rule"] is None
