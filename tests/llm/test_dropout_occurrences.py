import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from linkwright.llm import op9_dropout, textbatch

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def one_by_one(tree, doc_id, text):
    out, key = [], op9_dropout.xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), tree.seed)
    for n, piece in enumerate(op9_dropout._CUT.findall(" " + text)):
        salt = int(textbatch.mix64(np.array([key + n & op9_dropout._ALL], np.uint64))[0]) + tree.hashed(piece) & op9_dropout._ALL
        out += [tree.model.byte_ids[10]] if piece == "\n" else tree.model.codes(op9_dropout.merge(piece, tree.model.ranks, tree.skips(salt)))
    return np.array(out, "<u4").tobytes()


def test_a_word_is_dealt_anew_at_each_occurrence(spark):
    word, n = "internationalization", 3000
    docs = spark.createDataFrame([(i, " ".join([word] * n)) for i in range(2)], "doc_id long, text string")
    seen = Counter()
    for row in op9_dropout.encode(docs, PIECES).collect():
        table, now = op9_dropout.Model(PIECES).bytes, []
        for i in np.frombuffer(row["ids"], "<u4").tolist():
            if table[i].startswith(b" ") and now:
                seen[tuple(now)] += 1
                now = []
            now.append(i)
        seen[tuple(now)] += 1
    assert sum(seen.values()) == 2 * n and len(seen) > 50


@pytest.mark.parametrize("rate", [0.1, 0.7, 1.0])
def test_tree_equals_one_by_one(monkeypatch, rate):
    tree, rng = op9_dropout.Tree(PIECES, 5, rate), random.Random(4)
    texts = ["".join(rng.choice("abenorst   é▁語\n") for _ in range(300)) for _ in range(30)] + ["ab" * 32 + " " + "x" * 500, "ab" * 31, "\n\n", " ", "\U0001f600 the the the"]
    want = [one_by_one(tree, i, t) for i, t in enumerate(texts)]
    assert tree.encode_all(list(range(len(texts))), texts) == want
    assert tree.encode_all(list(range(len(texts))), texts) == want
    monkeypatch.setattr(op9_dropout, "NODES", 10)
    monkeypatch.setattr(op9_dropout, "STEPS", 2)
    assert [tree.encode(i, t) for i, t in enumerate(texts)] == want


def test_share_of_skipped_merges():
    tree = op9_dropout.Tree(PIECES, 17, 0.1)
    plain = len(tree.model.codes(op9_dropout.merge(" of", tree.model.ranks, lambda a, m, b: False)))
    n = 20_000
    ids = np.frombuffer(tree.encode(1, " ".join(["of"] * n)), "<u4")
    assert plain == 1  # by either order of two merges: 0.9 ** 2, or 0.1 * 0.9 ** 2 after the first candidate is skipped
    whole = tree.model.ids[op9_dropout.SPACE + "of"]
    assert abs((ids == whole).mean() * len(ids) / n - 0.891) < 0.01
