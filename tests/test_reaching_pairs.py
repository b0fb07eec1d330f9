"""Pairs of records of several fields that can reach a threshold, compared in cells, against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from linkwright.functions import distance
from linkwright.operators import blocking as B
from linkwright.operators import linkage as L
from linkwright.operators.scoring import Algorithm, FieldMapping

from .test_near_pairs import plain, texts


def records(seed, n):
    rng = random.Random(seed)
    some, cities = texts(seed, n), ["", "aachen", "aachem", "köln", "x" * 70]
    return [(t, rng.choice([0, 0, 7]), rng.random() < 0.8, rng.choice([0.0, 15.0]), c, len(c), c != "", 0.0) for t in some for c in [rng.choice(cities)]]


def confidence(a, b, weights, loss):
    total = weight = raised = 0.0
    for k, w in enumerate(weights):
        (t, m, full, up), (u, n, full2, up2) = a[4 * k : 4 * k + 4], b[4 * k : 4 * k + 4]
        if full and full2:
            top = 100.0 if m == n else 100.0 - 100.0 * loss * plain(t, u) / max(len(t), len(u), 1) + min(up, up2)
            total, weight, raised = total + max(top, 0.0) * w, weight + w, raised + 10.0 * (top >= 50.0)
    return total / weight + raised if weight else -1.0


@pytest.mark.parametrize("strip,once", [(1 << 16, 1 << 18), (50, 40)])
def test_reaching_records_are_those_of_plain_distances(monkeypatch, strip, once):
    monkeypatch.setattr(distance, "STRIP", strip)
    monkeypatch.setattr(distance, "AT_ONCE", once)
    monkeypatch.setattr(distance, "MASKS", 500)
    a, b, weights = records(1, 20), records(2, 20) + records(1, 5), (1.0, 0.5)
    values = lambda rows: [distance.Values([r[4 * k] for r in rows], [r[4 * k + 1] for r in rows], [w * r[4 * k + 2] for r in rows], [r[4 * k + 3] for r in rows]) for k, w in enumerate(weights)]
    for loss, least in ((1.0, 75.0), (0.4, 90.0), (1.0, 0.0)):
        got = [(int(i), int(j)) for x in distance.reaching(values(a), values(b), loss, least, 10.0, 50.0) for i, j in zip(*x, strict=True)]
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if confidence(x, y, weights, loss) >= least}
        doubtful = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(confidence(x, y, weights, loss) - least) < 0.01}
        assert len(got) == len(set(got)) and want <= set(got) and set(got) - want <= doubtful


def test_records_of_several_fields_leave_their_cells_only_near(spark, monkeypatch):
    """They were all joined, with all that is compared, in one shuffle."""
    made, whole = [], B.reaching_pairs
    monkeypatch.setattr(B, "reaching_pairs", lambda *a, **k: (made.append(whole(*a, **k)), made[-1])[1])
    monkeypatch.setattr(B, "PART_ROWS", 7)
    rng = random.Random(5)
    name = lambda: "an" + "".join(rng.choice("abcdefgh") for _ in range(10))
    rows = [(i, name(), rng.choice(["bonn", "ulm", None])) for i in range(60)]
    others = [(i + 100, t[:7] + "x" + t[8:], c) for i, t, c in rows[:20]] + [(i + 200, name(), "ulm") for i in range(60)]
    one, two = spark.createDataFrame(rows, "id long, name string, city string"), spark.createDataFrame(others, "id long, name string, city string")
    config = L.LinkageConfig((FieldMapping("name", "name"), FieldMapping("city", "city", 0.5)), (Algorithm("exact"), Algorithm("fuzzy", {"method": "levenshtein"})), 75.0, strategies=("exact_prefix",))
    got = {(r["id1"], r["id2"]) for r in L.find_matches(one, two, "id", "id", config).matched.select("id1", "id2").collect()}
    free = L.LinkageConfig(config.mappings, config.algorithms, 75.0, use_blocking=False)
    want = {(r["id1"], r["id2"]) for r in L.find_matches(one, two, "id", "id", free).matched.select("id1", "id2").collect()}
    assert got == want and len(got) >= 20
    own = L.find_matches(one, one, "id", "id", config).matched.select("id1", "id2").collect()
    plainly = L.find_matches(one, one, "id", "id", free).matched.where(F.substring("record1.name", 1, 2) == "an").select("id1", "id2").collect()
    assert {tuple(r) for r in own} == {tuple(r) for r in plainly} and len(own) == len(plainly)
    assert len(made) == 2
