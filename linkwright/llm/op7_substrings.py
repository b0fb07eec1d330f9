"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted across the corpus.

A word is removed if a window over it also starts in a document with a smaller
doc_id.  Three steps:

1. Every task hashes all windows of its documents (two polynomials modulo 2**64
   over hashed words, a prefix sum and two multiplications a window each).  Up to
   CHUNK windows make a chunk.  Inside it each window whose hash also occurs in
   a smaller doc_id of the chunk is known to go; only those of the smallest
   doc_id are sent on, packed by hash range.  A window that a third of the
   corpus shares is thus sent once for each chunk.
2. Each hash range counts its hashes over all chunks: those found in several
   documents go from all but the smallest doc_id.  The answer returns to the
   chunk as word positions.
3. Each chunk merges its removed windows into maximal word intervals for each
   document; a join by doc_id and text hash brings them to the texts.  A bitmap
   of fixed size keeps most texts that lose nothing out of that shuffle.

A range holds what RANGE_BYTES of input give at most, so their number grows with
the input.  Above FIRST bits of it the ranges are reached in two steps, coarse ones
and then fine ones within them, so a packed row still holds about a hundred
windows; a coarse range is dealt to several tasks by chunk.

Windows are compared by 88 bits of two independent hashes (of words and of
windows): over 10**13 windows less than one chance meeting is expected in all.
Windows are judged on the input, not on what is left.  Chunks number the rows of
a task, so an input that comes from a shuffle is stored first.

Defined results.  A null text has no words (kept text empty).  A null doc_id is
neither smaller nor greater than others: its words stay and remove nothing.
Rows with the same doc_id don't remove each other's words; rows that repeat get
equal results.  Extra columns pass; one named like a result is replaced.  An
empty table has no rows.  A very long text is one slice: its words take up to
twenty bytes for each byte of it, never more than a chunk and itself at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import apart, input_bytes, shuffle_partitions, small_batches, steady, stored

WINDOW = 50
#: Windows of a chunk; bounds a task's memory.
CHUNK = 1 << 19
#: Input bytes (as stored) for a hash range, and for a task that counts ranges.
RANGE_BYTES, TASK_BYTES = 8 << 20, 32 << 20
#: Bits (as a power of two) of the bitmap of documents with spans.
MARKS = 24
#: Bits of the ranges that one step deals out, and bytes of the second hash that are kept.
FIRST, MORE = 12, 3
SEED = 42

_ROWS = "range int, chunk long, directory boolean, a binary, b binary, c binary, d binary"
_NAMES = ["range", "chunk", "directory", "a", "b", "c", "d"]
_KINDS = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]


def pack(x: np.ndarray, width: int = 0) -> bytes:
    """The array's bytes in planes (all lowest bytes first), compressed; width: leading planes that are kept."""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T[: width or x.itemsize]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data) or bytearray(), np.uint8), np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def later(h: np.ndarray, more: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions of the windows whose hashes (h, more) also occur with a smaller doc."""
    twice = np.flatnonzero(tb.repeated(h))
    order = twice[np.lexsort((doc[twice], more[twice], h[twice]))]
    hs, ms, ds = h[order], more[order], doc[order]
    head = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ms[1:] != ms[:-1])]) if len(order) else order
    return order[ds > np.repeat(ds[head], np.diff(np.r_[head, len(hs)]))]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def dealt(h: np.ndarray, more: np.ndarray, at: np.ndarray, doc: np.ndarray, bits: int, chunk: int | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows of windows by hash range; chunk: one for all windows, or one for each."""
    part = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    h, more, at, doc, part = h[order], more[order], at[order], doc[order], part[order]
    of = chunk[order] if isinstance(chunk, np.ndarray) else None
    low = np.concatenate([h.view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8], more.view(np.uint8).reshape(-1, 4)[:, :MORE]], axis=1)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    out: list[tuple] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out.append((int(part[a]), int(of[a]) if of is not None else chunk, False, low[a:b].tobytes(), pack(delta(at[a:b])), pack(delta(doc[a:b])), pack(delta(of[a:b])) if of is not None else None))
        if len(out) == 512 or b == cuts[-1]:
            yield batch(out)
            out = []


def undealt(rows: list[dict], bits: int) -> tuple[np.ndarray, ...]:
    """h, more, at, doc and chunk of the windows of packed rows of one range."""
    width = 8 - bits // 8
    low = [np.frombuffer(r["a"], np.uint8).reshape(-1, width + MORE) for r in rows]
    sizes, both = [len(x) for x in low], np.concatenate(low)
    h = np.zeros((len(both), 8), np.uint8)
    h[:, :width] = both[:, :width]
    h = h.view(np.uint64).ravel()
    if width < 8:
        h |= np.uint64((rows[0]["range"] >> bits % 8) << 8 * width)
    doc = np.concatenate([np.cumsum(unpack(r["c"], np.int64)) for r in rows])
    at = np.concatenate([np.cumsum(unpack(r["b"], np.uint32), dtype=np.uint32) for r in rows])
    of = np.concatenate([np.full(n, r["chunk"], np.int64) if r["d"] is None else np.cumsum(unpack(r["d"], np.int64)) for r, n in zip(rows, sizes, strict=True)])
    more = np.zeros((len(both), 4), np.uint8)
    more[:, :MORE] = both[:, width:]
    return h, more.view(np.uint32).ravel(), at, doc, of


class Chunk:
    """Windows of consecutive documents, gathered until there are so many of them."""

    def __init__(self, window: int, size: int):
        self.size = size
        self.window, self.n_words, self.n_docs, self.n = window, 0, 0, 0
        self.ids, self.keys, self.first, self.hashes, self.more, self.begins, self.counts = [], [], [], [], [], [], []

    def full(self) -> bool:
        return self.n >= self.size or self.n_words >= 4 * self.size or self.n_docs >= max(1, self.size // 4)

    def add(self, part: pa.RecordBatch) -> None:
        ids = part.column(0)
        buf, offsets = tb.text_bytes(part.column(1))
        w = tb.Words(buf, offsets, tb.PLAIN)
        begin = w.windows(self.window)
        known = np.asarray(ids.is_valid())
        begin = begin[known[w.rows()[begin]]]
        raw = memoryview(buf)
        self.keys += [xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.first.append(w.first[:-1] + self.n_words)
        if len(begin):
            hashes = [tb.span_hashes(tb.prefix_hashes(w.hashes(a), b), begin, begin + self.window, b) for a, b in ((tb.BYTE_BASE, tb.WORD_BASE), (tb.BYTE_BASE_2, tb.WORD_BASE_2))]
            self.hashes.append(hashes[0])
            self.more.append((hashes[1] >> np.uint64(64 - 8 * MORE)).astype(np.uint32))
            self.begins.append(begin + self.n_words)
        self.counts.append(np.bincount(w.rows()[begin], minlength=len(ids)))
        self.n_words += len(w)
        self.n_docs += len(ids)
        self.n += len(begin)

    def rows(self, number: int, bits: int) -> Iterator[pa.RecordBatch]:
        ids, first = np.concatenate(self.ids).astype(np.int64), np.concatenate(self.first).astype(np.int64)
        h, more, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.hashes, np.uint64), (self.more, np.uint32), (self.begins, np.int64)))
        doc, at = np.repeat(ids, np.concatenate(self.counts)), at.astype(np.uint32)
        gone = np.zeros(len(h), bool)
        gone[later(h, more, doc)] = True
        body = [pack(x) for x in (ids, np.array(self.keys, np.uint64), first)]
        yield batch([(number % (1 << bits), number, True, b"".join(len(x).to_bytes(8, "little") + x for x in body), pack(delta(at[gone])), int(self.n_words).to_bytes(8, "little"), None)])
        yield from dealt(h[~gone], more[~gone], at[~gone], doc[~gone], bits, number)


def _by_group(batches: Iterator[pa.RecordBatch], column: str, weight: Callable[[dict], int] = lambda row: 0, limit: int = 1) -> Iterator[tuple[int, list[dict]]]:
    """Rows of consecutive equal values, of batches sorted by the column; with a weight, in parts of about the limit."""
    now, rows, n = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (row[column] != now or n >= limit):
                yield now, rows
                rows, n = [], 0
            now = row[column]
            rows.append(row)
            n += weight(row)
    if rows:
        yield now, rows


def removed_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key (XXH64 of the text) and spans (pairs of int64: first word, end) of documents that lose words."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = steady(docs.select(F.col("doc_id").cast("long"), "text"), "texts")
    size = input_bytes(docs)
    parts = max(shuffle_partitions(spark), size // TASK_BYTES)
    bits = min(24, int(max(256, 16 * parts, size // RANGE_BYTES) - 1).bit_length())
    first = bits if bits <= FIRST else -(-bits // 2)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 32, Chunk(window, CHUNK)
        for part in tb.slices(batches):
            chunk.add(part)
            if chunk.full():
                yield from chunk.rows(number, first)
                number, chunk = number + 1, Chunk(window, CHUNK)
        if chunk.ids:
            yield from chunk.rows(number, first)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, "range", lambda r: 0 if r["directory"] else len(r["a"]) // 12, CHUNK):
            for r in rows:
                if r["directory"]:
                    yield batch([tuple(r[name] for name in _NAMES)])
            rows = [r for r in rows if not r["directory"]]
            if rows:
                h, more, at, doc, of = undealt(rows, first)
                yield from dealt(h, more, at, doc, bits, of)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "a", "b", "c"]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for _, rows in _by_group(batches, "range"):
            out = [(r["chunk"], r["a"], r["b"], r["c"]) for r in rows if r["directory"]]
            rows = [r for r in rows if not r["directory"]]
            if rows:
                h, more, at, doc, of = undealt(rows, bits)
                gone = later(h, more, doc)
                gone = gone[np.lexsort((at[gone], of[gone]))]
                cuts = np.flatnonzero(np.r_[True, of[gone][1:] != of[gone][:-1], True]) if len(gone) else np.zeros(1, np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out.append((int(of[gone[a]]), None, pack(delta(at[gone[a:b]])), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, "chunk"):
            top = next(r for r in rows if r["a"] is not None)
            n_words = int.from_bytes(top["c"], "little")
            begins = np.concatenate([np.cumsum(unpack(r["b"], np.uint32), dtype=np.uint32) for r in rows]).astype(np.int64)
            if not len(begins):
                continue
            data, body = top["a"], []
            while data:
                size = int.from_bytes(data[:8], "little")
                body.append(data[8 : 8 + size])
                data = data[8 + size :]
            ids, keys, first = unpack(body[0], np.int64), unpack(body[1], np.uint64), unpack(body[2], np.int64)
            change = np.bincount(begins, minlength=n_words + 1) - np.bincount(begins + window, minlength=n_words + 1)
            cover = np.cumsum(change[:n_words]) > 0
            edge = np.zeros(n_words + 1, bool)
            edge[first] = edge[n_words] = True
            start = np.flatnonzero(cover & np.r_[True, ~cover[:-1] | edge[1:n_words]])
            end = np.flatnonzero(cover & np.r_[~cover[1:] | edge[1:n_words], True]) + 1
            doc = np.searchsorted(first, start, "right") - 1
            pairs = np.stack([start - first[doc], end - first[doc]], axis=1)
            cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
            which = doc[cuts[:-1]]
            spans = [pairs[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(keys[which].view(np.int64)), pa.array(spans, pa.binary())], names=["doc_id", "text_key", "spans"])

    sent = docs.mapInArrow(tb.tidy(hashed), _ROWS)
    if bits > first:  # a coarse range goes to several tasks
        salts = max(1, parts >> first)
        sent = sent.repartition(parts, F.col("range"), F.pmod(F.xxhash64("chunk"), F.lit(salts))).sortWithinPartitions("range").mapInArrow(tb.tidy(split), _ROWS)
    answers = sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(tb.tidy(counted), "chunk long, a binary, b binary, c binary")
    spans = answers.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(tb.tidy(merged), "doc_id long, text_key long, spans binary")
    return spans.groupBy("doc_id", "text_key").agg(F.min("spans").alias("spans"))  # rows that repeat have the same spans


FIELDS = [("n_words", "long"), ("n_removed", "long"), ("kept_text", "string")]


def marked(spans: DataFrame) -> DataFrame:
    """(word, bits): 2**MARKS bits in words of 64, set where a document with spans falls by hash.  2**(MARKS - 6) rows at most."""
    place = F.col("place")
    places = spans.select(_place(F.col("__id"), F.col("__key")).alias("place"))
    return places.groupBy(F.shiftright(place, 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("__bits"))


def _place(doc_id, key):
    return F.pmod(F.xxhash64(doc_id, key), F.lit(1 << MARKS))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words joined by a space).

    Only documents that a bitmap of fixed size says may lose words are shuffled to
    meet their spans; the bitmap alone is sent to all tasks.
    """
    return apart(docs, lambda rows: _cut(rows, window), [name for name, _ in FIELDS])


def _cut(docs: DataFrame, window: int) -> DataFrame:
    spans = stored(removed_spans(docs, window).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")), "spans")
    mine = F.col("doc_id").cast("long")
    placed = docs.withColumn("__own", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__place", _place(mine, F.col("__own")))
    flagged = placed.join(F.broadcast(marked(spans)), F.shiftright("__place", 6) == F.col("__word"), "left")
    flagged = flagged.withColumn("__maybe", F.expr("coalesce(getbit(__bits, cast(__place & 63 AS int)), 0) = 1")).drop("__word", "__bits", "__place")
    some = flagged.where("__maybe").join(spans, (mine == F.col("__id")) & (F.col("__own") == F.col("__key")), "left").drop("__id", "__key")
    both = flagged.where("NOT __maybe").withColumn("__spans", F.lit(None).cast("binary")).unionByName(some).drop("__own", "__maybe")

    def cut(part: pa.RecordBatch) -> list:
        text, spans = (part.column(part.schema.get_field_index(x)) for x in ("text", "__spans"))
        n_words, n_removed, kept = [], [], []
        for t, s in zip(text, spans, strict=True):
            spans_of = np.frombuffer(s.as_py(), np.int64).reshape(-1, 2)[::-1].tolist() if s.is_valid else []
            n, gone, left = 0, 0, []
            for words in tb.word_lists(t.as_buffer().to_pybytes() if t.is_valid else b""):
                size = len(words)
                for a, b in spans_of:
                    if a < n + size and b > n:
                        del words[max(0, a - n) : b - n]
                n, gone = n + size, gone + size - len(words)
                if words:
                    left.append(b" ".join(words))
            n_words.append(n)
            n_removed.append(gone)
            kept.append(b" ".join(left).decode())
        return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]

    return tb.with_columns(both, FIELDS, cut).drop("__spans")
