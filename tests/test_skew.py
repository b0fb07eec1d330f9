"""Exact places, evictions and pseudonyms with one outlier, one hot time and repeated values."""

import random

from pyspark.sql import functions as F

from linkwright.operators import privacy, telemetry


def test_places_with_an_outlier_and_heavy_tails(spark, monkeypatch):
    rng = random.Random(6)
    values = {"a": [rng.random() for _ in range(20_000)] + [1e9], "b": [10.0 ** rng.uniform(-300, 300) for _ in range(5_000)], "c": [1.0] * 3_000 + [2.0], None: [5.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    qs = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "top": 1.0}
    sizes = []
    kept = telemetry.stored
    monkeypatch.setattr(telemetry, "stored", lambda d, name="table", **more: sizes.append(name) or kept(d, name, **more))
    for accuracy in (10_000, 100, 10):  # of the last, the sketch is coarse
        got = {r["k"]: [r[q] for q in qs] for r in telemetry.exact_place(df, ["k"], "v", qs, accuracy).collect()}
        assert got == {k: [sorted(vs)[min(int(q * len(vs)), len(vs) - 1)] for q in qs.values()] for k, vs in values.items()}
    # what is put in order for one place
    near = df.where("k = 'a'").agg(F.percentile_approx("v", 0.5 - 0.0004, 10_000).alias("l"), F.percentile_approx("v", 0.5 + 0.0004, 10_000).alias("h")).first()
    assert sum(near["l"] <= v <= near["h"] for v in values["a"]) < 100
    assert telemetry.exact_place(df.limit(0), ["k"], "v", qs).collect() == []


def test_evictions_of_one_time(spark):
    rng = random.Random(5)
    rows = [(i, "2024-01-01 00:00:00" if i % 3 else f"2024-01-{1 + i % 28:02d} 00:00:00", rng.randrange(1, 50)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "result_id long, t string, size long").select("result_id", F.to_timestamp("t").alias("last_accessed"), "size")
    total = sum(r[2] for r in rows)
    freed, want = 0, set()
    for i, _, size in sorted(rows, key=lambda r: (r[1], r[0])):
        if freed < total - 0.8 * 10_000:
            want.add(i)
        freed += size
    got = telemetry.evict(df, 10_000)
    assert {r["result_id"] for r in got.collect()} == want and len(want) > 1000
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_pseudonyms_in_the_order_of_appearance(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "hot", f"v{rng.randrange(500)}"])) for i in range(3_000)]
    seen = {}
    for _, v in rows:
        if v is not None:
            seen.setdefault(v, f"ANON_{len(seen) + 1:06d}")
    got = privacy.pseudonymize(spark.createDataFrame(rows, "id long, v string").repartition(9), "v", "id").collect()
    assert {r["id"]: r["v"] for r in got} == {i: seen.get(v) for i, v in rows}
