import random

import numpy as np

from linkwright.llm import op2_simhash, textbatch

from . import brute


def _connected(pairs, nodes):
    parent = {int(x): int(x) for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(int(a))] = root(int(b))
    return {x: root(x) for x in parent}


def test_a_hot_key_is_cut_into_blocks(spark, monkeypatch):
    """Fingerprints that share the same 35 bits of a key, with and without links among them."""
    rng, low = random.Random(8), 0x155555555
    fps = sorted({low | rng.getrandbits(29) << 35 for _ in range(4000)} | {low | 1 << 40 | 1 << b for b in range(41, 60)})
    groups = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = brute.components(list(range(len(fps))), fps)
    for hot in (op2_simhash.HOT, 300):
        monkeypatch.setattr(op2_simhash, "HOT", hot)
        met = [r for b in [list(op2_simhash.meet(_batches(fps), 4))] for r in b]
        assert (sum(r.column(4).null_count < r.num_rows for r in met) > 3) == (hot == 300)
        got = _connected([(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in op2_simhash.links(groups).collect()], fps)
        first = {}
        for i, f in enumerate(fps):
            assert first.setdefault(want[i], got[f]) == got[f]
        assert len(set(got.values())) == len(set(want.values()))


def _batches(fps):
    import pyarrow as pa

    fp = np.array(fps, np.uint64).view(np.int64)
    key = np.r_[np.full(3, -5), np.full(len(fp) - 8, 7), np.full(5, 9)]
    for at in range(0, len(fp), 130):
        yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 130]), pa.array(fp[at : at + 130])], names=["key", "fp"])


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Alpha", "beta\n\t", "gÄmma", "x" * 90]) for _ in range(n)) for n in (0, 1, 3, 4, 5, 300)] + [None, " \n", "one", "a\x1cb c\x85d  e f"]
    want = [brute.fingerprint(t) for t in texts]
    for piece in (1, 7, 64, textbatch.PIECE):
        monkeypatch.setattr(textbatch, "PIECE", piece)
        assert [op2_simhash.fingerprint(t.encode() if t is not None else None) & (1 << 64) - 1 for t in texts] == want
