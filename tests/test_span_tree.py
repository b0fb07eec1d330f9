import pytest

from linkwright.operators import telemetry as T

SCHEMA = "span_id long, parent_id long"


def test_long_chains_keep_all_spans(spark):
    chain = [(i, i - 1 if i else None) for i in range(200)]
    tree = [(1000 + i, 1000 + (i - 1) // 2 if i else None) for i in range(50)]
    orphans = [(5000, 4999), (5001, 5000)]
    got = {(r["span_id"], r["root"], r["depth"]) for r in T.span_tree(spark.createDataFrame(chain + tree + orphans, SCHEMA)).collect()}
    want = {(i, 0, i) for i in range(200)} | {(1000 + i, 1000, (i + 1).bit_length() - 1) for i in range(50)}
    assert got == want


def test_cycles_raise_and_no_spans_pass(spark):
    with pytest.raises(ValueError, match="cycle"):
        T.span_tree(spark.createDataFrame([(0, None), (1, 3), (2, 1), (3, 2)], SCHEMA))
    assert T.span_tree(spark.createDataFrame([], SCHEMA)).count() == 0
