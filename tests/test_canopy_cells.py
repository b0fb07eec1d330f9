"""Similar sets are compared where they meet and leave their tasks once, in place of all pairs that share a gram."""

import random

import numpy as np
import pyarrow as pa
import pytest

from linkwright.operators import canopy


@pytest.mark.parametrize("strip,once", [(1 << 16, 1 << 18), (8, 20)])
def test_similar_sets_of_a_cell_are_those_of_a_plain_version(monkeypatch, strip, once):
    monkeypatch.setattr(canopy, "STRIP", strip)
    monkeypatch.setattr(canopy, "AT_ONCE", once)
    rng = random.Random(3)
    sets = [sorted({7, *rng.sample(range(30), rng.randrange(0, 9))}) for _ in range(40)]
    sets += [sorted({7, *rng.sample(range(10**6), 400)}) for _ in range(2)]
    a, b = sets[:25], sets[20:]
    made = lambda rows: canopy._Sets(pa.chunked_array([pa.array(rows, pa.list_(pa.int32()))]), pa.chunked_array([pa.array([r.index(7) for r in rows])]))
    for least in (0.2, 0.4, 1.0):
        parts = list(canopy._alike(made(a), made(b), least))
        got = {(int(i), int(j)): float(s) for p in parts for i, j, s in zip(*p, strict=True)}
        want = {}
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                common = set(x) & set(y)
                if min(common) == 7 and len(common) / len(set(x) | set(y)) >= least:
                    want[i, j] = len(common) / len(set(x) | set(y))
        assert got == want and sum(len(p[0]) for p in parts) == len(got)
    assert np.bitwise_count(made(a).bits).sum() > 0
