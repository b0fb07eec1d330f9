"""Which pairs of texts are kept apart before their distance is worked out, and that none in reach is."""

from __future__ import annotations

import random

import numpy as np
import pytest

from linkwright.functions import distance

SYLLABLES = "th an er in on re he nd at ou it is en ti or st es of le al".split()


def titles(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 5))) for _ in range(4)) for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4, 0.7, 1.0])
def test_no_near_pair_is_kept_apart(share):
    rng = random.Random(5)
    a = [*titles(60, 1), "", "x", "ab", "ab" * 40, "е" * 300, "é b"]
    b = [*titles(60, 2), *["".join(c for c in t if rng.random() > share / 2) for t in a], *[t[::-1] for t in a[:10]], "а" * 290, "ab" * 90]
    got = [(int(i), int(j), int(d)) for x in distance.near(a, b, np.full(len(a), share)) for i, j, d in zip(*x, strict=True)]
    d = {(i, j): distance.long_distance(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
    assert sorted(got) == sorted((i, j, d[i, j]) for i, j in d if d[i, j] <= np.floor(share * max(len(a[i]), len(b[j])) + 1e-6))


def test_cuts_leave_less_to_compare(monkeypatch):
    """By whole texts alone 0.55 of the pairs were left."""
    compared, columns = [], distance.columns
    monkeypatch.setattr(distance, "columns", lambda *args: (compared.append(len(args[1])), columns(*args))[1])
    a, b = titles(500, 3), titles(500, 4)
    for _ in distance.near(a, b, np.full(500, 0.35)):
        pass
    assert sum(compared) < 0.4 * 250_000


def test_bounds_of_records_take_four_bytes():
    """Before, eight; lengths that don't fit the short form keep their pairs."""
    a, b = (distance.Values(t, [1, 2, 3], [1.0] * 3, [0.0] * 3) for t in (["abc", "x" * 40_000, ""], ["abd", "x" * 35_000, "q"]))
    i, j = np.arange(3)[:, None], np.arange(3)[None, :]
    top, weight = a.top(b, i, j, a.fewest(b, i, j), 1.0)
    assert top.dtype == weight.dtype == np.float32
    assert all(a.fewest(b, i, j)[x, y] <= distance.long_distance(s, t) for x, s in enumerate(a.texts.texts) for y, t in enumerate(b.texts.texts) if max(len(s), len(t)) < 9 or not min(len(s), len(t)))
