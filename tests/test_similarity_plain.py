"""Jaro-Winkler, the sequence ratio and the combined scores against versions written from their definitions."""

import difflib

import pytest

from linkwright.catalog import QUERIES


def jaro(a, b):
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, pairs = set(), []
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y and abs(i - j) <= reach and j not in taken:
                taken.add(j)
                pairs.append((i, j))
                break
    if not pairs:
        return 0.0
    left, right = [a[i] for i, _ in pairs], [b[j] for j in sorted(taken)]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (len(pairs) / len(a) + len(pairs) / len(b) + (len(pairs) - moved) / len(pairs)) / 3


def winkler(a, b):
    same = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    j = jaro(a, b)
    return j + 0.1 * same * (1 - j)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_combined_scores(spark, sf):
    rows = QUERIES["similarity_combined"](spark, sf).collect()
    assert len(rows) > 500
    for r in rows:
        a, b = r["a"], r["b"]
        if not a or not b:
            assert r["combined"] == (100.0 if a == b else 0.0)
            continue
        w, s = 100 * winkler(a, b), 100 * difflib.SequenceMatcher(None, a, b).ratio()
        v = 100 * (1 - levenshtein(a, b) / max(len(a), len(b)))
        assert r["jaro_winkler"] == pytest.approx(w, abs=1e-5) and r["sequence"] == pytest.approx(s, abs=1e-5)
        assert r["combined"] == pytest.approx(0.4 * v + 0.4 * w + 0.2 * s, abs=1e-5)


def test_all_algorithms_take_the_best(spark, sf):
    """Every match is a candidate pair, scores lie above the threshold, and the same titles match in full."""
    rows = QUERIES["linkage_all_algorithms"](spark, sf).collect()
    assert rows and all(75 <= r["confidence"] <= 100 and r["similarity"] <= r["confidence"] for r in rows)
    assert {r["algorithm"] for r in rows} <= {"exact", "fuzzy", "phonetic"}
    own = {r["id1"] for r in rows if r["id1"] == r["id2"] and r["confidence"] == 100}
    assert len(own) > 50
