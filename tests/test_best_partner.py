"""The best partners of records of one field, found by equal forms first."""

import pytest

from linkwright.operators import blocking as B
from linkwright.operators import linkage as L
from linkwright.operators.scoring import Algorithm, FieldMapping

from .test_near_pairs import texts

KINDS = ("many_to_one", "one_to_many", "one_to_one")


def pairs(df):
    return sorted((r["id1"], r["id2"], r["algorithm"], round(r["similarity"], 6), round(r["confidence"], 6)) for r in df.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_best_partners_are_those_of_all_pairs(spark, kind):
    some = [*texts(6, 12), None, "a!", "a!!", "o'zbek", "o`zbek", "O'ZBEK  SHAHAR", "o'zbek shahar", "!!", "!!?"] * 2
    a, b = (spark.createDataFrame([(i, t) for i, t in enumerate(x)], "id long, t string") for x in (some, some[::3]))
    params = {"normalize_uzbek": True, "compose": False}
    config = L.LinkageConfig((FieldMapping("t", "t", 0.7),), (Algorithm("exact", params), Algorithm("fuzzy", {"method": "levenshtein", **params})), 75.0, strategies=("exact_prefix",), cardinality=kind)
    for one, two in ((a, a), (b, a)):
        # all scores of distinct records: of equal ones that with the smallest id alone is a partner
        scores = L.score_pairs(L.candidates(one, two, "id", "id", config), one, two, "id", "id", config)
        want = pairs(L.with_cardinality(scores, kind))
        got = pairs(L.find_matches(one, two, "id", "id", config).matched)
        assert got == want


@pytest.mark.parametrize("kind", KINDS)
def test_records_with_an_equal_partner_are_not_compared_with_others(spark, monkeypatch, kind):
    """All records of a key were compared with one another, the square of their number."""
    looked, near = [], B.near_pairs
    monkeypatch.setattr(B, "near_pairs", lambda x, y, *a: (looked.append(x.count() * y.count()), near(x, y, *a))[1])
    rows = [(i, f"the title no {i}") for i in range(200)]
    one, two = spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame([*rows[1:], (900, "the titel no zero")], "id long, t string")
    config = L.LinkageConfig((FieldMapping("t", "t"),), (Algorithm("exact"), Algorithm("fuzzy", {"method": "levenshtein"})), 75.0, strategies=("exact_prefix",), cardinality=kind)
    assert L.find_matches(one, one, "id", "id", config).matched.count() == 200 and not looked
    got = {(r["id1"], r["id2"]) for r in L.find_matches(one, two, "id", "id", config).matched.collect()}
    assert len(got) >= 199 and sum(looked) <= 400
