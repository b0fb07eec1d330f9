"""Scores of matches, worked out once a pair of classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkwright.operators import linkage as L
from linkwright.operators.scoring import Algorithm, FieldMapping


def test_scores_are_those_of_the_matched_records(spark):
    rows = [(i, ["anna bel", "Anna bell", "anton", None, "", "berta"][i % 6]) for i in range(2700)]
    d = spark.createDataFrame(rows, "id long, t string")
    config = L.LinkageConfig((FieldMapping("t", "t"),), (Algorithm("exact"), Algorithm("fuzzy", {"method": "levenshtein", "compose": False})), 75.0, strategies=("exact_prefix",))
    found = L.find_matches(d, d, "id", "id", config)
    counted = lambda df: sorted(map(tuple, df.groupBy("c", "s", "k").agg(F.count("*"), F.sum(F.hash("id1", "id2"))).collect()))
    of = lambda m: m.select("*", F.map_keys("field_results").alias("keys"))
    made = found.scores({"c": F.round("confidence", 3), "s": F.col("similarity"), "k": F.array_join("keys", ",")}, of)
    assert made.count() == found.matched.count() > 1_000_000  # above that lists are spread
    assert counted(made) == counted(of(found.matched).select("id1", "id2", F.round("confidence", 3).alias("c"), F.col("similarity").alias("s"), F.array_join("keys", ",").alias("k")))
    above, _, below = made._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert "round(" not in above and "round(" in below
