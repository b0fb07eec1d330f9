"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of characters that aren't letters becomes one
space-like mark, and all 1-, 2- and 3-grams with a letter are hashed to BUCKETS.
Counts by language are taken over all training rows: every task adds up one
vector for each language, and the vectors are added in Spark.  The matrix of log
probabilities (languages x BUCKETS, 256 KB a language) is broadcast; a slice of
texts is scored by one gather and a sum over each text.

Defined results.  A text that is null or has no letter gets ``und`` and score 0;
so does every text if nothing can be learned.  Ties go to the first language in
text order.  Null doc_ids, repeated rows and extra columns pass; a column named
like a result is replaced.  An empty table has no rows.  A very long text is read
whole, CHARS characters at a time beside its lower-cased copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import small_batches

BUCKETS, GRAMS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
#: Characters whose n-grams are worked out at once.
CHARS = 1 << 19
_PART = 1 << 12
FIELDS = [("lang_pred", "string"), ("score", "double")]


@lru_cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _within(ends: np.ndarray, at: int, n: int) -> np.ndarray:
    """Where texts that end there begin and end within the n characters from at on."""
    return np.clip(np.concatenate([np.zeros(1, np.int64), ends]) - at, 0, n)


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams and the text of each, for CHARS characters of the texts at a time."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in lowered], dtype=np.int64)
    kept, last = [np.zeros(0, np.uint32)], False
    sizes = np.zeros(len(texts), np.int64)
    for at in range(0, len(codes), CHARS):  # one mark for a run of other characters
        some = codes[at : at + CHARS]
        letter = _letters()[some]
        first = np.zeros(len(some), bool)
        a, b = np.searchsorted(ends, [at, at + len(some)], "left")
        first[ends[a:b] - at] = True  # the first character after a text
        keep = letter | np.r_[last, letter[:-1]] | first
        keep[0] |= at == 0
        last = bool(letter[-1])
        kept.append(np.where(letter, some, 0x20)[keep].astype(np.uint32))
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
        sizes += np.diff(upto[_within(ends, at, len(some))])
    code, ends = np.concatenate(kept), np.cumsum(sizes)
    longest = max(GRAMS)
    for at in range(0, len(code), CHARS):
        some = code[at : at + CHARS + longest - 1].astype(np.uint64)
        row, letter = np.repeat(np.arange(len(texts)), np.diff(_within(ends, at, len(some)))), some != 0x20
        buckets, rows = [], []
        for n in GRAMS:
            m = min(CHARS, len(some) - n + 1)
            if m <= 0:
                continue
            h, whole = np.full(m, n, np.uint64), np.zeros(m, bool)
            for k in range(n):
                h = h * np.uint64(0x1000193) + some[k : k + m]
                whole |= letter[k : k + m]
            whole &= row[:m] == row[n - 1 : n - 1 + m]
            buckets.append((tb.mix64(h[whole]) >> np.uint64(48)).astype(np.int64))
            rows.append(row[:m][whole])
        yield np.concatenate(buckets), np.concatenate(rows)


def learn(docs: DataFrame, chosen: Column) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (BUCKETS + 1 rows; the last one is the prior)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in tb.slices(batches):
            langs = part.column(1).to_pylist()
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs], np.int64)
            for k, name in enumerate(names):
                total.setdefault(name, np.zeros(BUCKETS + _PART, np.int64))[BUCKETS] += int((own == k).sum())
            for bucket, row in grams(part.column(0).to_pylist()):
                n = np.bincount(own[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for k, name in enumerate(names):
                    total[name][:BUCKETS] += n[k]
        for name, n in total.items():
            cuts = n.reshape(-1, _PART)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cuts)), pa.array(range(len(cuts)), pa.int32()), pa.array([x.tobytes() for x in cuts])], names=["lang", "part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["lang"], row["part"]
                total[key] = total.get(key, 0) + np.frombuffer(row["n"], np.int64)
        for (name, part), n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([n.tobytes()])], names=["lang", "part", "n"])

    small_batches(docs.sparkSession)
    kinds = "lang string, part int, n binary"
    rows = docs.where(chosen & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(tb.tidy(count), kinds).repartition("lang", "part").mapInArrow(tb.tidy(add), kinds).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), BUCKETS + _PART), np.float64)
    for r in rows:
        counts[langs.index(r["lang"]), r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["n"], np.int64)
    grams_n, docs_n = counts[:, :BUCKETS], counts[:, BUCKETS]
    out = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    if langs:
        out[:BUCKETS] = np.log((grams_n + SMOOTHING) / (grams_n.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)).T
        out[BUCKETS] = np.log(np.maximum(docs_n, 1) / max(1.0, docs_n.sum()))
    return langs, out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred and score (the posterior probability of lang_pred)."""
    sent, wide = docs.sparkSession.sparkContext.broadcast(model), max(1, len(model[0]) // 8)

    def run(part: pa.RecordBatch) -> list:
        langs, matrix = sent.value
        names, scores = [], []
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        for at in range(0, len(texts), max(1, len(texts) // wide)):
            some = texts[at : at + max(1, len(texts) // wide)]
            total, n = np.tile(matrix[BUCKETS].astype(np.float64), (len(some), 1)), np.zeros(len(some), np.int64)
            for bucket, row in grams(some):
                for k in range(len(langs)):
                    total[:, k] += np.bincount(row, matrix[bucket, k], len(some))
                n += np.bincount(row, minlength=len(some))
            for i in range(len(some)):
                if not n[i] or not langs:
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(np.argmax(total[i]))
                    names.append(langs[best])
                    scores.append(float(1 / np.exp(np.minimum(700, total[i] - total[i, best])).sum()))
        return [pa.array(names), pa.array(scores, pa.float64())]

    return tb.with_columns(docs, FIELDS, run)
