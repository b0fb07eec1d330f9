"""Sorted neighbourhoods, canopies, adaptive blocks and stable assignment against plain versions."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkwright.catalog_linkage import records
from linkwright.operators import blocking as B
from linkwright.operators import canopy
from linkwright.operators import linkage as L
from linkwright.operators.ordering import neighbour_pairs, neighbours, numbered
from linkwright.operators.scoring import Algorithm, FieldMapping


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "", "c" * rng.randrange(9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id long").repartition(7)
    got = numbered(df, ["k", "id"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["k"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got.collect()) == list(range(3000))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert numbered(df.limit(0), ["k", "id"]).collect() == []


@pytest.mark.parametrize("window", [2, 3, 7])
def test_neighbours_cross_ranges(spark, window):
    rng = random.Random(window)
    rows = [(i, rng.choice([None, "", "x", "y", "z" * rng.randrange(1, 200)])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string")
    order = sorted((k, i) for i, k in rows if k)
    want = {(order[a][1], order[b][1]) for a in range(len(order)) for b in range(a + 1, min(len(order), a + window))}
    got = [tuple(r) for r in neighbours(df, "id", F.col("k"), window).collect()]
    assert set(got) == want and len(got) == len(want)
    left, right = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    both = sorted([(k, 1, i) for i, k in left if k] + [(k, 2, i) for i, k in right if k])
    want = {(p[2], q[2]) for a, p in enumerate(both) for b, q in enumerate(both) if p[1] == 1 and q[1] == 2 and abs(a - b) < window}
    pairs = neighbour_pairs(spark.createDataFrame(left, "id long, k string"), spark.createDataFrame(right, "id long, k string"), "id", "id", [(F.col("k"), F.col("k"))], window)
    assert {tuple(r) for r in pairs.collect()} == want


def test_a_window_needs_two_places(spark):
    with pytest.raises(ValueError):
        neighbours(spark.range(3).withColumn("k", F.lit("a")), "id", F.col("k"), 1)


def greedy_canopies(classes, order, loose, tight):
    alike = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    taken, out = set(), {}
    for c in order:
        if c not in taken:
            out[c] = {d for d, g in classes.items() if d == c or alike(classes[c], g) >= loose}
            taken |= {d for d, g in classes.items() if alike(classes[c], g) >= tight}
    return out


def test_canopies_equal_the_greedy_ones(spark):
    df = records(spark, "/root/testdata/sf0.01")
    grams = {r["id"]: frozenset(r["g"] or []) for r in df.select("id", B.ngram_keys(F.col("title")).alias("g")).collect()}
    first = {}
    for i in sorted(grams):
        first.setdefault(grams[i], i)
    classes = {i: set(g) for g, i in first.items()}
    hashed = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id", F.lit(0)).alias("h")).collect()}
    for loose, tight in ((0.4, 0.6), (0.25, 0.3)):
        want = greedy_canopies(classes, sorted(classes, key=lambda c: (hashed[c], c)), loose, tight)
        got = {}
        for r in canopy.canopies(df, "id", "title", loose, tight).collect():
            got.setdefault(r["canopy"], set()).add(r["id"])
        assert got == {c: {i for i, g in grams.items() if first[g] in members} for c, members in want.items()}
        assert set().union(*got.values()) == set(grams) and len(want) > 100


def test_canopies_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "abc"), (5, "abc"), (6, "ABC!"), (7, "abcd")]
    got = {(r["canopy"], r["id"]) for r in canopy.canopies(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.5, 0.9).collect()}
    assert {(1, 1), (1, 2), (3, 3), (4, 4), (4, 5), (4, 6), (4, 7), (7, 7)} <= got
    assert canopy.canopies(spark.createDataFrame([], "id long, t string"), "id", "t").collect() == []
    with pytest.raises(ValueError):
        canopy.canopies(spark.range(1).withColumn("t", F.lit("a")), "id", "t", 0.8, 0.5)


def test_adaptive_blocks_lose_no_pair(spark):
    rng = random.Random(3)
    rows = [("s", rng.choice(["hot", "hot", "warm", f"k{rng.randrange(40)}"]), i) for i in range(1500)]
    left = spark.createDataFrame(rows, "strategy string, key string, id long")
    right = spark.createDataFrame([(s, k, i + 5000) for s, k, i in rows[::3]], "strategy string, key string, id long")
    want = sorted(map(tuple, B.candidate_pairs(left, right).collect()))
    assert sorted(map(tuple, B.adaptive_pairs(left, right, part_rows=20, task_pairs=2000).collect())) == want
    assert sorted(map(tuple, B.adaptive_pairs(left, right).collect())) == want
    assert B.adaptive_pairs(left.limit(0), right).collect() == []


def test_a_hot_key_is_dealt_evenly(spark, monkeypatch):
    n = 3000
    rows = spark.createDataFrame([("s", "one", i) for i in range(n)], "strategy string, key string, id long")
    monkeypatch.setattr(type(rows), "distinct", lambda self: self.withColumn("task", F.spark_partition_id()))  # before the last shuffle
    sizes = [r["count"] for r in B.adaptive_pairs(rows, rows, part_rows=100, task_pairs=200_000).groupBy("task").count().collect()]
    assert sum(sizes) == n * n and len(sizes) > 40 and max(sizes) < 3 * n * n / 45


def plain_stable(matches):
    order = sorted(matches, key=lambda m: (-round(m[2], 9), -round(m[3], 9), hashlib.md5(f"0:{m[0]}:{m[1]}".encode()).hexdigest(), m[0], m[1]))
    one, two, out = set(), set(), set()
    for a, b, *_ in order:
        if a not in one and b not in two:
            one.add(a), two.add(b), out.add((a, b))
    return out


def test_stable_pairs_equal_the_greedy_ones(spark, monkeypatch):
    rng = random.Random(8)
    cases = [
        [(a, b, 100.0, 100.0) for a in range(40) for b in range(50)],  # equal records
        [(a, b, 75.0 + rng.randrange(5), 60.0 + rng.randrange(3)) for a in range(120) for b in rng.sample(range(100), 6)],
        [(i, i + d, 80.0 + i / 100, 70.0) for i in range(60) for d in (0, 1)],  # a chain
        [],
    ]
    for matches in cases:
        df = spark.createDataFrame(matches, "id1 long, id2 long, confidence double, similarity double")
        got = [tuple(r)[:2] for r in L.stable_pairs(df).collect()]
        assert set(got) == plain_stable(matches) and len(got) == len(set(got))


def test_equal_records_pair_off_in_few_rounds(spark, monkeypatch):
    rounds = Counter()
    kept = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name, **more: rounds.update([name]) or kept(df, name, **more))
    df = spark.range(60).crossJoin(spark.range(60).withColumnRenamed("id", "id2")).select(F.col("id").alias("id1"), "id2", F.lit(100.0).alias("confidence"), F.lit(100.0).alias("similarity"))
    assert L.stable_pairs(df).count() == 60 and rounds["best"] < 20


def test_linkage_by_every_method(spark):
    left = spark.createDataFrame([(1, "anna maria stone"), (2, "jon smith"), (3, "nobody else"), (4, None)], "i long, name string")
    right = spark.createDataFrame([(1, "anna mario stone"), (2, "jon smyth"), (3, "zzz qqq"), (4, "")], "k long, title string")
    base = {"mappings": (FieldMapping("name", "title"),), "algorithms": (Algorithm("fuzzy", {"method": "levenshtein", "compose": False}),), "threshold": 75.0}
    for method, more in (("adaptive", {"strategies": ("exact_prefix",)}), ("sorted_neighbourhood", {"window": 3}), ("canopy", {"canopy": (0.2, 0.5)}), ("keys", {"strategies": ("ngram",)})):
        found = L.find_matches(left, right, "i", "k", L.LinkageConfig(**base, method=method, **more))
        assert {tuple(r) for r in found.matched.select("id1", "id2").collect()} == {(1, 1), (2, 2)}
        assert {r["i"] for r in found.unmatched_1.collect()} == {3, 4} and {r["k"] for r in found.unmatched_2.collect()} == {3, 4}
    with pytest.raises(ValueError):
        L.LinkageConfig(**base, method="guess")
    with pytest.raises(ValueError):
        L.LinkageConfig(**base, method="canopy", max_block=3)


def test_running_sums_and_parts_of_large_blocks(spark):
    rng = random.Random(2)
    rows = [("s", rng.choice(["hot", "hot", "a", "b"]), i) for i in range(900)]
    got = {tuple(r) for r in B.split_blocks(spark.createDataFrame(rows, "strategy string, key string, id long"), 40).collect()}
    want = set()
    for key in ("hot", "a", "b"):
        ids = sorted(i for _, k, i in rows if k == key)
        want |= {("s", f"{key}_{n // 40}" if len(ids) > 40 else key, i) for n, i in enumerate(ids)}
    assert got == want
    plan = B.split_blocks(spark.createDataFrame(rows, "strategy string, key string, id long"), 40)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(strategy" not in plan
