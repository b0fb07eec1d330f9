"""Pairs of large blocks: whole, once each, and in few bytes where they are written."""

from __future__ import annotations

import os

import pytest

from linkwright.operators import blocking as B


def index_of(spark, names):
    return B.index(spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string"), "id", ["name"], ["exact_prefix"], pairing=True)


@pytest.mark.parametrize("part_rows", [None, 40])
def test_pairs_in_runs_are_whole(spark, part_rows):
    left = ["Anna", "anton", None, "B", "", "Berta"] * 50
    right = ["ANKA", "Bela", "Carl"] * 110 + [None]
    one, two = index_of(spark, left), index_of(spark, right)
    key = lambda t: t.lower()[:2] if t and len(t) >= 2 else None
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if key(a) and key(a) == key(b))
    assert sorted(map(tuple, B.adaptive_pairs(one, two, part_rows=part_rows, task_pairs=5000).collect())) == want
    itself = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(left) if key(a) and key(a) == key(b))
    assert sorted(map(tuple, B.candidate_pairs(one, one).collect())) == itself


def test_written_pairs_take_few_bytes(spark, tmp_path):
    """Before, 1.1 to 1.4 bytes a pair."""
    rows = index_of(spark, [f"th{i}" for i in range(1500)])
    at = str(tmp_path / "pairs")
    B.adaptive_pairs(rows, rows).write.option("compression", "snappy").parquet(at)
    assert sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.endswith(".parquet")) < 0.4 * 1500 * 1500
    assert spark.read.parquet(at).distinct().count() == 1500 * 1500
