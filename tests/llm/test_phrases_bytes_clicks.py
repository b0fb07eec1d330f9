"""Phrase mining, byte-level BPE and click deduplication against plain versions."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from linkwright.llm import op11_phrases, op12_bytes, op13_clicks

from .test_operators import ODD

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain_phrases(rows, top=2000, least=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, 6) for i in range(len(ws) - k + 1))
    cands = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    gone = {(q[0], *q[i : i + m]) for q, a in cands.items() for m in range(2, len(q) - 1) for i in range(1, len(q) - m + 1) if a >= f[(q[0], *q[i : i + m])]}
    out = defaultdict(list)
    for p, a in cands.items():
        if p not in gone:
            lang, ws = p[0], p[1:]
            cuts = [(1000 * a * n[lang] // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top]))


def mined(df, **more):
    return sorted(map(tuple, op11_phrases.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_phrases_equal_plain_counts(spark):
    rng = random.Random(7)
    vocab = ["Alpha", "beta", "GAMMA", "d\x1ce", "é", "x" * 300, "omega", "日本"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" "] * 12 + ["  ", "\t", " \t", ", ", ".", "\n", "\x0b"]) for _ in range(rng.randrange(0, 400))) for _ in range(400)]
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), "mine") for i, t in enumerate(texts)] + [(None, texts[0], "en", None)] * 3 + [(5, t, None, "") for t in ODD]
    got = mined(spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string"))
    want = plain_phrases([(r[1], r[2]) for r in rows])
    assert len(want) > 100 and got == want
    some = mined(spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string"), top=3)
    assert some == plain_phrases([(r[1], r[2]) for r in rows], top=3)


def test_phrases_of_no_rows_and_of_a_long_text(spark):
    schema = "doc_id long, text string, lang string"
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame([(1, None, None)], schema)) == []
    unit, n = "alpha beta, gamma delta epsilon. ", 100_000
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(unit), n).alias("text"), F.lit("en").alias("lang"))
    assert mined(long) == [("en", 1, "alpha beta", n, n, n, 5 * n, 5000), ("en", 2, "gamma delta epsilon", n, n, n, 5 * n, 5000)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op12_bytes.read_ranks(RANKS), special_tokens={})


def test_bytes_equal_the_library(spark, sf, library):
    newer = ["a՘b's", "\U000323b0's x࢏9"]
    rng = random.Random(3)
    mixed = ["".join(rng.choice("ab c'stSLl1 \n\t.,é日  \x1c\x85ß") for _ in range(rng.randrange(60))) for _ in range(500)]
    odd = [(i, t, "mine", b"") for i, t in enumerate([*ODD, *newer, *mixed, "<|endoftext|> x"])] + [(3, ODD[3], None, None), (None, "no id", "", None)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("ids"), F.lit(b"").alias("decoded"))
    for df in (docs, spark.createDataFrame(odd, "doc_id long, text string, ids string, decoded binary")):
        for r in op12_bytes.decode(op12_bytes.encode(df, RANKS), RANKS).collect():
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == library.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids)
            assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert op12_bytes.decode(op12_bytes.encode(docs.limit(0), RANKS), RANKS).collect() == []


def test_long_pretokens_and_cuts(library, monkeypatch):
    e, rng = op12_bytes.Encoder(RANKS), random.Random(5)
    check = lambda t: np.frombuffer(e.encode(t), "<u4").tolist() == library.encode_ordinary(t)
    for n in (1023, 1024, 20_000):
        assert all(check("".join(rng.choice(a) for _ in range(n))) for a in ("a", "ab", "é日ü", "=-", "0123456789", "etaoin"))
    monkeypatch.setattr(op12_bytes, "PIECE", 40)
    assert all(check("".join(rng.choice("ab c'st1 \n.é  ") for _ in range(300))) for _ in range(500))


def test_the_rank_queue_takes_the_least():
    rng, q, left = random.Random(9), op12_bytes.RankQueue(50_000), []
    start = np.array([rng.choice([-1, 5, 700, 49_999]) for _ in range(300)], np.int32)
    q.fill(start)
    left = sorted((int(r), i) for i, r in enumerate(start) if r >= 0)
    for _ in range(3000):
        if left and rng.random() < 0.55:
            assert q.pop() == left.pop(0)
        else:
            x = (rng.choice([5, 6, 700, rng.randrange(50_000)]), rng.randrange(1000))
            if x not in left:
                q.push(*x)
                left = sorted([*left, x])
        assert bool(q.top) == bool(left)


# --- clicks ---------------------------------------------------------------------

EPOCH = dt.datetime(1970, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hash string, batch int"


def plain_windows(rows, batches=12, window=72, late=48):
    each = []
    for i, ts, at, client, kind, value, props, *_ in rows:
        if at is None:
            continue
        hour = (at - EPOCH) // dt.timedelta(hours=1)
        for j in range(max(0, math.fmod(i or 0, 3)).__int__() + 1):
            c = zlib.crc32(f"{'' if i is None else i}:{j}".encode())
            h = hour + 6 * j * (c % 10)
            text = lambda x: "" if x is None else str(x)
            cents = None if value is None else math.floor(100 * value + 0.5)
            us = None if ts is None else (ts - EPOCH) // dt.timedelta(microseconds=1)
            digest = hashlib.sha256("|".join(map(text, [client, kind, cents, us, props, c % 3])).encode()).hexdigest()
            each.append((i, h, h + c // 10 % 200, digest))
    if not each:
        return []
    low, high = min(x[2] for x in each), max(x[2] for x in each)
    dealt = defaultdict(list)
    for i, h, at, digest in each:
        dealt[(at - low) * batches // (high - low + 1)].append((i, h, digest))
    is_open, out, m = {}, [], None
    for b in range(batches):
        by = defaultdict(list)
        for i, h, digest in dealt[b]:
            if m is None or h >= m - late:
                by[i].append((h, digest))
        for i, xs in by.items():
            for h, digest in sorted(xs):
                w = is_open.get(i)
                if w is not None and h <= w[0] + window:
                    w[1] += 1
                    if digest != w[4]:
                        w[2] += 1
                        w[3] += zlib.crc32(digest.encode())
                else:
                    if w is not None:
                        out.append((i, w[0], b, *w[1:]))
                    is_open[i] = [h, 0, 0, 0, digest]
        m = max([*([m] if m is not None else []), *(x[1] for x in dealt[b])], default=None)
        for i, w in list(is_open.items()):
            if b == batches - 1 or (m is not None and w[0] + window < m - late):
                out.append((i, w[0], b, *is_open.pop(i)[1:]))
    return sorted(out, key=repr)


def windows(df, **more):
    names = ("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash")
    return sorted((tuple(r[c] for c in names[:2]) + (r["closed_batch"], r["n_repeats"], r["n_conflicts"], r["conflict_crc"], r["hash"]) for r in op13_clicks.deduplicate(df, **more).collect()), key=repr)


def clicks(rng, n, ids, hours):
    at = lambda: EPOCH + dt.timedelta(days=19_700, hours=rng.random() * hours)
    some = lambda x: x if rng.random() > 0.1 else None
    rows = [(rng.choice(ids), some(at()), some(at()), some(rng.randrange(3)), some("a|b"), some(rng.randrange(300) / 7), some('{"k": 1}'), "x", 1) for _ in range(n)]
    return rows + [r for r in rows if rng.random() < 0.2]


def test_windows_equal_plain_ones(spark):
    rng = random.Random(11)
    rows = clicks(rng, 400, [None, -5, 0, 1, 2, 2, 2, 5, 8, 1 << 60, *range(20, 60)], 3000)
    want = plain_windows(rows, batches=5)
    assert len(want) > 100 and any(w[4] for w in want) and len({w[2] for w in want}) == 5
    assert windows(spark.createDataFrame(rows, CLICKS), batches=5) == want


def test_batches_without_rows(spark):
    at = lambda day: EPOCH + dt.timedelta(days=19_700 + day)
    rows = [(3 * i, None, at(day), 1, "a", 1.0, None, None, None) for i, day in enumerate([0, 1, 2, 2, 40, 41, 90, 91])]
    want = plain_windows(rows, batches=8)
    assert len({w[2] for w in want}) == 2
    assert windows(spark.createDataFrame(rows, CLICKS), batches=8) == want


def test_hot_click_one_time_and_no_rows(spark):
    at = EPOCH + dt.timedelta(days=-400)
    rows = [(2, at, at, 1, "view", 1.5, "p" * 100_000, None, None)] * 50 + [(1, None, at, None, None, None, None, None, None)]
    assert windows(spark.createDataFrame(rows, CLICKS), batches=2) == plain_windows(rows, batches=2)
    assert windows(spark.createDataFrame([], CLICKS)) == []
    assert windows(spark.createDataFrame([(1, at, None, 1, "", 0.0, "", "", 0)], CLICKS)) == []


def test_the_fold_in_any_batches():
    """Rows folded at once or in steps of time give the same windows."""
    rng = np.random.default_rng(1)
    n = 4000
    ids, hour = rng.integers(0, 40, n), np.sort(rng.integers(0, 5000, n))
    words = rng.integers(0, 3, (n, 4)).astype(np.uint64)
    rows = lambda s: op13_clicks.counted(np.ones(len(ids[s]), bool), ids[s], hour[s], words[s], np.ones(len(ids[s]), np.int64))
    once, closed = op13_clicks.fold(op13_clicks.Windows.none(), rows(slice(None)))
    state, parts = op13_clicks.Windows.none(), []
    cuts = [0, *np.flatnonzero(np.diff(hour) > 0)[::97] + 1, n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        state, done = op13_clicks.fold(op13_clicks.Windows.unpacked(state.packed()), rows(slice(a, b)))
        parts.append(done)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.joined(p)
    table = lambda w: sorted(zip(w.id.tolist(), w.start.tolist(), w.repeats.tolist(), w.conflicts.tolist(), w.crc.tolist(), w.hash.tolist(), strict=True))
    assert table(state) == table(once) and table(whole) == table(closed) and len(closed) > 1000
