"""Linking of equal records as classes, pairs without a stored or shuffled table of them, and bounds of scores."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.operators import blocking as B
from linkwright.operators import linkage as L
from linkwright.operators.scoring import Algorithm, FieldMapping

FUZZY = Algorithm("fuzzy", {"method": "levenshtein", "compose": False})


def people(spark, seed, n):
    rng = random.Random(seed)
    names = ["anna stone", "anna stony", "an", "jon smith", "jon smyth", "joan smit", "", None, "zed"]
    rows = [(i, rng.choice(names), rng.choice(["ann@x", "jo@y", "zz", None]), rng.choice(["rome", "roma", "oslo", None])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, name string, mail string, city string")


def test_pairs_are_neither_stored_nor_shuffled(spark, monkeypatch):
    rows = spark.range(400).select("id", F.lit("one and the same").alias("t"))
    sizes, kept = [], L.stored
    for module in (L, B):
        monkeypatch.setattr(module, "stored", lambda df, name="table", **more: (sizes.append(df.count()), kept(df, name, **more))[1])
    found = L.find_matches(rows, rows, "id", "id", L.LinkageConfig((FieldMapping("t", "t"),), (Algorithm("exact"), FUZZY), strategies=("exact_prefix",)))
    assert found.statistics.first()["matches"] == found.statistics.first()["total_comparisons"] == found.matched.count() == 160_000
    assert max(sizes) <= 400  # all 160,000 pairs before
    index = B.index(rows, "id", ["t"], ["exact_prefix"], pairing=True)
    for make in (B.candidate_pairs, B.adaptive_pairs):
        plan = make(index, index)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan


def test_a_pair_of_several_common_keys_is_made_once(spark):
    _, left = people(spark, 1, 60)
    _, right = people(spark, 2, 50)
    one, two = (B.index(df, "id", ["name", "mail"], ["exact_prefix", "ngram"], pairing=True) for df in (left, right))
    got = [tuple(r) for r in B.adaptive_pairs(one, two, part_rows=7, task_pairs=50).collect()]
    want = {tuple(r) for r in B.candidate_pairs(one.drop("rest"), two.drop("rest")).collect()}
    assert len(got) == len(want) and set(got) == want
    ones = [x.withColumn("__n", F.lit(1)) for x in (one, two)]
    assert B.count_pairs(*ones).first()["n"] == len(want)


@pytest.mark.parametrize("cardinality", ["many_to_many", "many_to_one", "one_to_many", "one_to_one", "stable_one_to_one"])
def test_classes_give_the_matches_of_all_records(spark, monkeypatch, cardinality):
    monkeypatch.setattr(L, "LISTED", 3)
    _, left = people(spark, 3, 50)
    _, right = people(spark, 4, 40)
    config = L.LinkageConfig((FieldMapping("name", "name"), FieldMapping("city", "city", 0.5)), (Algorithm("exact"), FUZZY), 75.0, strategies=("exact_prefix",), block_on=(("name", "name"), ("mail", "mail")), cardinality=cardinality)
    found = L.find_matches(left, right, "id", "id", config)
    pairs = L.candidates(left, right, "id", "id", config)
    want = L.with_cardinality(L.score_pairs(pairs, left, right, "id", "id", config), cardinality)
    rows = lambda df: sorted((r["id1"], r["id2"], r["algorithm"], round(r["similarity"], 6), round(r["confidence"], 6)) for r in df.collect())
    assert rows(found.matched) == rows(want) and rows(want)
    assert all(r["record1"]["id"] == r["id1"] and r["record2"]["id"] == r["id2"] for r in found.matched.collect())
    s, ids = found.statistics.first(), [{r[k] for r in rows(want)} for k in (0, 1)]
    assert s["matches"] == len(rows(want)) and s["total_comparisons"] == pairs.count()
    assert (s["unmatched_1"], s["unmatched_2"]) == (50 - len(ids[0]), 40 - len(ids[1]))
    assert {r["id"] for r in found.unmatched_1.collect()} == set(range(50)) - ids[0] and {r["id"] for r in found.unmatched_2.collect()} == set(range(40)) - ids[1]


def test_no_distance_is_below_its_bound(spark):
    rng = random.Random(5)
    texts = ["", "a", "ab", "мир", "The and attion to"] + ["".join(rng.choice("abcde xyz'éж😀") for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [t[: len(t) // 2] + rng.choice("abx") + t[len(t) // 2 + rng.randrange(3) :] for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[c.alias(f"s{k}") for k, c in enumerate(S.signature(F.col("t")))])
    a, b = (df.withColumnsRenamed({c: f"{c}_{k}" for c in df.columns}) for k in (1, 2))
    marks = [[F.col(f"s{i}_{k}") for i in range(4)] for k in (1, 2)]
    bound = S.fewest_edits(*marks, (F.length("t_1"), F.length("t_2")))
    both = a.crossJoin(b).select(bound.alias("b"), F.levenshtein("t_1", "t_2").alias("d"))
    assert both.where("b > d").count() == 0 and both.where("b > 5").count() > 1000
