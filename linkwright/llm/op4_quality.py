"""Quality classifier: a factorisation machine.

A text is a sparse vector: the share of each hashed word (DIM buckets, square
root, unit length) and the structure statistics of STATS, which include size
metadata of the text.  The score is
    sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)),
the pairwise interactions of rank RANK in linear time.  Fitted on the driver by
Adagrad on at most ROWS labelled rows (a documented bound; 32 KB a row at most),
scored by numpy over whole slices.

Defined results.  Null and empty texts have an all-zero word part and are scored
like any other.  Without labelled rows the score is 0.5 for all.  Null doc_ids,
repeated rows and extra columns pass; a column named like a result is replaced.
Of several labels of one doc_id the largest counts; a score that ties with the
threshold is predicted 1.  An empty table has no rows.  A very long text is one
slice, read whole: its words take up to twenty bytes for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

DIM, RANK, ROWS, EPOCHS, BATCH, RATE, DECAY = 1 << 12, 8, 4000, 20, 64, 0.1, 1e-4
THRESHOLD = 0.7
#: Names of the structure statistics, columns DIM.. of the vector.
STATS = ["size", "lines", "symbols", "bars", "bangs", "upper", "digits", "stops", "long_words", "short_words", "wide_bytes", "repeats", "same_words", "one"]
FIELDS = [("score", "double"), ("predicted", "int")]


def _share(flags: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    return tb.sums(flags, offsets) / np.maximum(1, of)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as first entries (n + 1), feature numbers and values."""
    raw, offsets = tb.text_bytes(texts)
    buf = tb.lower_ascii(raw)
    w, n = tb.Words(buf, offsets, tb.PLAIN), len(offsets) - 1
    rows, h = w.rows(), w.hashes()
    size, words = np.diff(offsets), w.counts
    begin = w.windows(3)
    gram = tb.span_hashes(tb.prefix_hashes(h, tb.WORD_BASE), begin, begin + 3, tb.WORD_BASE)
    own = tb.mix64(rows.astype(np.uint64) + np.uint64(1))
    again = w.per_row(w.covered(begin[tb.repeated(gram ^ own[begin])], 3))
    length = w.ends - w.starts
    mark = np.isin(np.arange(256), list(b"#*$%&<>"))
    letters = tb.sums((buf >= 0x61) & (buf <= 0x7A), offsets)
    stats = np.stack(
        [
            np.log1p(size) / 12, np.log1p(tb.sums(raw == 0x0A, offsets)) / 8, np.minimum(1, 5 * _share(tb.look(mark, raw), offsets, size)), np.minimum(1, 10 * _share(raw == 0x7C, offsets, size)),
            np.minimum(1, 10 * _share(raw == 0x21, offsets, size)), _share((raw >= 0x41) & (raw <= 0x5A), offsets, letters), np.minimum(1, 5 * _share((raw >= 0x30) & (raw <= 0x39), offsets, size)),
            np.minimum(1, 10 * _share(tb.look(np.isin(np.arange(256), list(b".,;:?")), raw), offsets, size)), w.per_row(length > 15) / np.maximum(1, words), w.per_row(length < 3) / np.maximum(1, words),
            _share(raw >= 0x80, offsets, size), again / np.maximum(1, words), w.per_row(tb.repeated(h ^ own)) / np.maximum(1, words), np.ones(n),
        ],
        axis=1,
    )
    key = np.sort((rows.astype(np.int64) * DIM) + (h >> np.uint64(52)).astype(np.int64))
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    row, bucket = key[head] // DIM, key[head] % DIM
    value = np.sqrt(np.diff(np.r_[head, len(key)]) / np.maximum(1, words)[row])
    row = np.concatenate([row, np.repeat(np.arange(n), len(STATS))])
    order = np.argsort(row, kind="stable")
    number = np.concatenate([bucket, np.tile(DIM + np.arange(len(STATS)), n)])[order]
    first = np.searchsorted(row[order], np.arange(n + 1))
    return first, number, np.concatenate([value, stats.ravel()])[order]


class Machine:
    """w0, w and V; score() and the gradient step share the sums of the identity."""

    def __init__(self, seed: int = 7):
        size = DIM + len(STATS)
        rng = np.random.default_rng(seed)
        self.w, self.v, self.fitted = np.zeros(size), rng.normal(0, 0.01, (size, RANK)), False

    def margin(self, first: np.ndarray, number: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores and the sums V x of each row; every row has entries (the statistics)."""
        vx = self.v[number] * value[:, None]
        at = first[:-1]
        s = np.add.reduceat(vx, at, axis=0)
        return np.add.reduceat(self.w[number] * value, at) + 0.5 * (s**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1), s

    def fit(self, first: np.ndarray, number: np.ndarray, value: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        gw, gv = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for part in np.split(order, range(BATCH, len(order), BATCH)):
                sizes = first[part + 1] - first[part]
                at = np.r_[0, np.cumsum(sizes)]
                take = np.arange(at[-1]) + np.repeat(first[part] - at[:-1], sizes)
                num, val = number[take], value[take]
                m, s = self.margin(at, num, val)
                err = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) * weight[part] / len(part)
                e = np.repeat(err, sizes) * val
                own = np.repeat(np.arange(len(part)), sizes)
                used, back = np.unique(num, return_inverse=True)
                dw = np.bincount(back, e, len(used)) + DECAY * self.w[used]
                step = e[:, None] * (s[own] - self.v[num] * val[:, None])
                dv = np.stack([np.bincount(back, step[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= 0.5 * RATE * dv / np.sqrt(gv[used])
        self.fitted = True

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.fitted or not len(texts):
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.margin(*features(texts))[0], -30, 30)))


def learn(rows: DataFrame) -> Machine:
    """A machine fitted to text, y rows (see labelled.sample for their bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            first, number, value = features(part.column(0))
            cut = [(number[a:b].astype(np.int32).tobytes(), value[a:b].astype(np.float32).tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())], names=["y", "number", "value"])

    got = rows.select("text", "y").mapInArrow(tb.tidy(run), "y int, number binary, value binary").collect()
    got.sort(key=lambda r: (r["number"], r["value"], r["y"]))  # the same order in every run
    machine = Machine()
    if got:
        number = [np.frombuffer(r["number"], np.int32) for r in got]
        value = np.concatenate([np.frombuffer(r["value"], np.float32) for r in got]).astype(np.float64)
        machine.fit(np.r_[0, np.cumsum([len(x) for x in number])], np.concatenate(number).astype(np.int64), value, np.array([r["y"] for r in got], np.float64))
    return machine


def classify(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(part: pa.RecordBatch) -> list:
        score = sent.value.score(part.column(part.schema.get_field_index("text")))
        return [score, (score >= threshold).astype(np.int32)]

    return tb.with_columns(docs, FIELDS, run)
