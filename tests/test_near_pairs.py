"""Distances of many pairs at once, near pairs in cells, and top-k and statistics by distinct texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.functions import distance
from linkwright.operators import blocking as B
from linkwright.operators import linkage as L
from linkwright.operators import topk
from linkwright.operators.scoring import Algorithm, FieldMapping


def texts(seed, n):
    rng = random.Random(seed)
    some = ["", "a", "мир", "the and attion to"] + ["".join(rng.choice("abcde xyz'éж中😀") for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    some += ["".join(rng.choice("ab c") for _ in range(k)) for k in (31, 32, 33, 63, 64, 65, 130)]
    return some + [t[: len(t) // 2] + rng.choice("abx") + t[len(t) // 2 + rng.randrange(3) :] for t in some]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_texts_are_those_of_a_plain_distance(monkeypatch):
    monkeypatch.setattr(distance, "COLUMNS", 64)
    monkeypatch.setattr(distance, "MASKS", 500)
    a, b = texts(1, 40), texts(2, 40) + texts(1, 10)
    for share in (0.0, 0.35, 1.0):
        shares = np.where(np.arange(len(a)) % 3, share, share / 2)
        got = [(int(i), int(j), int(d)) for x in distance.near(a, b, shares) for i, j, d in zip(*x, strict=True)]
        want = [(i, j, d) for i, x in enumerate(a) for j, y in enumerate(b) if (d := plain(x, y)) <= int(shares[i] * max(len(x), len(y)) + 1e-6)]
        assert sorted(got) == want


def test_pairs_of_cut_blocks_are_all_found_once(spark, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 7)
    monkeypatch.setattr(B, "CELLS", 10**9)
    some = sorted(set(texts(3, 30)))
    rows = spark.createDataFrame([("s", t[:1] > "c" and "x" or "y", i, t, 0.4, len(t) if i % 2 else None) for i, t in enumerate(some)], "strategy string, key string, id long, text string, share double, mark long")
    got = [(r["id1"], r["id2"]) for r in B.near_pairs(rows, rows, half=True).collect()]
    side = lambda t: t[:1] > "c"
    want = {(i, j) for i, a in enumerate(some) for j, b in enumerate(some) if i <= j and side(a) == side(b) and (plain(a, b) <= int(0.4 * max(len(a), len(b)) + 1e-6) or (i % 2 and j % 2 and len(a) == len(b)))}
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_not_multiplied_for_the_best(spark, monkeypatch):
    """300 copies of one text were 90,000 pairs."""
    made, kept = [], topk.top_k
    monkeypatch.setattr(topk, "top_k", lambda pairs, k=5: (made.append(pairs.count()), kept(pairs, k))[1])
    rows = spark.range(300).select("id", F.lit("one and the same").alias("t")).union(spark.createDataFrame([(500, "one and the sane"), (501, "other"), (502, None)], "id long, t string"))
    q, c = rows.select(F.col("id").alias("q_id"), F.col("t").alias("q")), rows.select(F.col("id").alias("c_id"), F.col("t").alias("c"))
    best = topk.best_pairs(q, c, 0.6, 5)
    assert made and made[0] <= 20
    got = {tuple(r) for r in best.select("q_id", "c_id", "rank").collect()}
    want = {tuple(r) for r in kept(topk.similarity_pairs(q, c, 0.6), 5).select("q_id", "c_id", "rank").collect()}
    assert got == want and len(got) == 301 * 5 + 1
    assert topk.pair_statistics(q, c, 0.6, 303).collect() == topk.match_statistics(topk.similarity_pairs(q, c, 0.6), 303).collect()


@pytest.mark.parametrize("uzbek", [False, True])
def test_matches_of_one_field_by_near_texts_alone(spark, monkeypatch, uzbek):
    params = {"normalize_uzbek": uzbek, "compose": False}
    config = L.LinkageConfig((FieldMapping("t", "t"),), (Algorithm("exact", params), Algorithm("fuzzy", {"method": "levenshtein", **params})), 75.0, strategies=("exact_prefix", "ngram"))
    some = [*texts(4, 25), None, "o'zbek", "o`zbek", "ўзбек шаҳар", "o'zbek shahar", "O'ZBEK  SHAHAR", "!!", "!!?"] * 2
    a, b = (spark.createDataFrame([(i, t) for i, t in enumerate(x)], "id long, t string") for x in (some, some[::3]))
    stored, kept = {}, L.stored
    monkeypatch.setattr(L, "stored", lambda df, name="table", **more: (stored.__setitem__(name, df.count()), kept(df, name, **more))[1])
    rows = lambda df: sorted((r["id1"], r["id2"], r["algorithm"], round(r["similarity"], 6), round(r["confidence"], 6)) for r in df.collect())
    for other in (a, b):
        found = L.find_matches(a, other, "id", "id", config)
        pairs = L.candidates(a, other, "id", "id", config)
        want = rows(L.score_pairs(pairs, a, other, "id", "id", config))
        assert rows(found.matched) == want and found.statistics.first()["total_comparisons"] == pairs.count()
        assert stored.pop("pairs") < pairs.count() / 4  # of all that share a key
