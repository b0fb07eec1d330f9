"""Combined scores are worked out in Python only where they can be the best and reach the threshold."""

import random

from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.operators import linkage as L
from linkwright.operators.scoring import FieldMapping


def some(seed, n):
    rng = random.Random(seed)
    word = lambda hi: "".join(rng.choice("abcdет ж'") for _ in range(rng.randrange(hi)))
    rows = [(word(12), word(12)) for _ in range(n)]
    return rows + [(a, a[:3] + word(3) + a[4:]) for a, _ in rows] + [("", ""), ("", "a"), ("!", "?"), (None, "a")]


def test_no_combined_score_is_above_its_bound(spark):
    df = spark.createDataFrame(some(1, 300), "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(S.combined(a, b).alias("x"), S.most_combined(a, b, S.levenshtein(a, b)).alias("most"), "a", "b").where("a != '' AND b != ''")
    assert got.where("most < x - 1e-9").count() == 0 and got.where("x < 65 AND most < 65").count() > 100


def test_pairs_that_another_algorithm_wins_are_not_sent_to_python(spark, monkeypatch):
    """All pairs with a key in common were sent."""
    a, b = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(some(2, 40))], "id long, t string"), spark.createDataFrame([(i, t) for i, (_, t) in enumerate(some(2, 40))], "id long, t string")
    config = L.LinkageConfig((FieldMapping("t", "t"),), threshold=75.0, strategies=("phonetic_key", "exact_prefix"))
    rows = lambda: sorted((r["id1"], r["id2"], r["algorithm"], round(r["similarity"], 6), round(r["confidence"], 6)) for r in L.find_matches(a, b, "id", "id", config).matched.collect())
    made, combined = [], S.combined
    monkeypatch.setattr(S, "combined", lambda x, y, least=None, spoken=None: (made.append(least), combined(x, y, least, spoken))[1])
    got = rows()
    assert made and made[0] is not None
    monkeypatch.setattr(S, "combined", lambda x, y, *more: combined(x, y))
    assert got == rows() and len(got) > 20
    # a bound of 100 by another algorithm: nothing but equal texts can reach it, and the score stays its Levenshtein part
    df = spark.createDataFrame([("abcd", "abce")], "a string, b string")
    assert df.select(combined(F.col("a"), F.col("b"), F.lit(100.0))).first()[0] == 0.4 * 75.0
