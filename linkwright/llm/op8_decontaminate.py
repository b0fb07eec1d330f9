"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows of ten words (a shorter item is one window) are sets
of word shingles that a document must hold as a whole.  With full containment
the prefix filter needs just one shingle of a window, and the rarest does most:

1. the shingles of all windows are counted over the whole corpus;
2. each window is filed under its rarest shingle with that shingle's position;
3. documents look their shingles up among those prefixes; a find must leave room
   for the window in the document before and after it (length and position);
   the window's hash and then its words are compared.

The pairs of a window and an item that holds it are sent to the executors in
blocks of about BLOCK pairs and BLOCK_BYTES, each looked up in all documents;
usually there is one block.  The size of a block is checked before it is sent
and does not grow with the data; a window that many items share goes with some
of their ids in each block.

Defined results.  Null texts have no words; an item without words has no window.
Items with a null id count for hits but aren't listed.  Equal item_ids are
listed once, equal texts with each id.  A null doc_id stays null, repeated rows
get equal results.  Of equally rare shingles a window is filed under the first.
Extra columns pass; one named like a result is replaced.  Empty tables of
documents or items give no rows or no hits.  A very long text is one slice: its
words take up to twenty bytes for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import apart, forget, small_batches, stored

WINDOW, SHINGLE = 10, 3
#: Pairs and bytes that a block has, about.
BLOCK, BLOCK_BYTES = 1 << 18, 48 << 20
_BITS = 22

FIELDS = [("n_words", "long"), ("n_hit", "long"), ("hit_words", "binary"), ("items", "array<string>")]


def _words(text: bytes) -> list[bytes]:
    buf = tb.lower_ascii(np.frombuffer(text, np.uint8)) if text else np.zeros(0, np.uint8)
    return np.where(tb.ALNUM[buf], buf, 0x20).astype(np.uint8).tobytes().split()


def _hashes(part_bytes: np.ndarray, offsets: np.ndarray) -> tuple[tb.Words, np.ndarray]:
    w = tb.Words(tb.lower_ascii(part_bytes), offsets, tb.ALNUM)
    return w, tb.prefix_hashes(w.hashes(), tb.WORD_BASE)


def _span(prefix: np.ndarray, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    return tb.span_hashes(prefix, begin, begin + size, tb.WORD_BASE)


class Lookup:
    """A sorted set of hashes behind a bitmap."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.sorted >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of the members, and their places in sorted."""
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.sorted, h[at]), max(0, len(self.sorted) - 1))
        same = self.sorted[place] == h[at] if len(self.sorted) else np.zeros(0, bool)
        return at[same], place[same]


class Block:
    """Windows: their words, owners and shingles."""

    def __init__(self, texts: list[bytes], owners: list[list[str]]):
        self.texts, self.owners = texts, owners
        joined = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
        w = tb.Words(joined, offsets, tb.ALNUM)
        prefix = tb.prefix_hashes(w.hashes(), tb.WORD_BASE)
        self.sizes = w.counts
        first = w.first[:-1]
        self.hashes = _span(prefix, first, self.sizes)
        #: One row for each shingle: its window, its offset in it, its size and hash.
        size = np.minimum(self.sizes, SHINGLE)
        number = self.sizes - size + 1
        self.window = np.repeat(np.arange(len(texts)), number)
        self.offset = np.arange(len(self.window)) - np.repeat(np.cumsum(number) - number, number)
        self.size = size[self.window]
        self.shingle = _span(prefix, first[self.window] + self.offset, self.size)

    def file(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Keep for each window only its rarest shingle, as counted."""
        n = np.zeros(len(self.shingle), np.int64)
        if len(hashes):
            order = np.argsort(hashes)
            place = np.minimum(np.searchsorted(hashes[order], self.shingle), len(hashes) - 1)
            n = np.where(hashes[order][place] == self.shingle, counts[order][place], 0)
        order = np.lexsort((self.offset, n, self.window))
        keep = order[np.r_[True, self.window[order][1:] != self.window[order][:-1]]] if len(order) else order
        keep = keep[np.argsort(self.shingle[keep], kind="stable")]
        self.window, self.offset, self.size, self.shingle = (x[keep] for x in (self.window, self.offset, self.size, self.shingle))
        self.lookups = {int(s): Lookup(self.shingle[self.size == s]) for s in np.unique(self.size)}

    def search(self, w: tb.Words, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and window numbers of all occurrences."""
        begins, numbers = [], []
        rows = w.rows()
        for s, lookup in self.lookups.items():
            begin = w.windows(s)
            at, place = lookup.find(_span(prefix, begin, s))
            low = np.searchsorted(self.shingle, lookup.sorted[place], "left")
            number = np.searchsorted(self.shingle, lookup.sorted[place], "right") - low
            at = np.repeat(begin[at], number)
            k = np.repeat(low, number) + np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
            window, start = self.window[k], at - self.offset[k]
            row = rows[at]
            fits = (self.size[k] == s) & (start >= w.first[row]) & (start + self.sizes[window] <= w.first[row + 1])
            window, start = window[fits], start[fits]
            same = _span(prefix, start, self.sizes[window]) == self.hashes[window] if len(start) else np.zeros(0, bool)
            begins.append(start[same])
            numbers.append(window[same])
        begin, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, numbers))
        raw = w.buf.tobytes()
        starts, ends = w.starts, w.ends
        exact = [b" ".join(raw[a:b] for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True)) == self.texts[k] for i, n, k in zip(begin.tolist(), self.sizes[number].tolist(), number.tolist(), strict=True)]
        exact = np.array(exact, bool)
        return begin[exact], number[exact]


def windows_of(benchmark: DataFrame) -> DataFrame:
    """Distinct (window, item_id) rows: the windows of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            for item, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = _words(text.as_buffer().to_pybytes()) if text.is_valid else []
                starts = range(max(1, len(words) - WINDOW + 1) if words else 0)
                for at in range(0, len(starts), BLOCK):
                    found = list({b" ".join(words[i : i + WINDOW]) for i in starts[at : at + BLOCK]})
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in found], pa.string()), pa.array([item] * len(found), pa.string())], names=["window", "item_id"])

    return stored(benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(tb.tidy(cut), "window string, item_id string").distinct(), "windows")


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    pairs = windows_of(benchmark)
    size = pairs.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item_id"), F.lit(0))).alias("bytes")).first()
    n = max(1, -(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    for k in range(n):
        by: dict[str, set[str]] = {}
        for window, item in pairs.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(n)) == k).collect():
            by.setdefault(window, set()).update(() if item is None else (item,))
        if by:
            yield Block([x.encode() for x in by], [sorted(x) for x in by.values()])
    forget(pairs)


def shingle_counts(docs: DataFrame, wanted: Block) -> tuple[np.ndarray, np.ndarray]:
    """The block's shingles that occur in docs, and how often."""
    small_batches(docs.sparkSession)
    sizes = np.unique(wanted.size).tolist()
    sent = docs.sparkSession.sparkContext.broadcast({s: np.unique(wanted.shingle[wanted.size == s]) for s in sizes})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {s: Lookup(x) for s, x in sent.value.items()}
        totals = {s: np.zeros(len(x.sorted), np.int64) for s, x in lookups.items()}
        for part in tb.slices(batches):
            w, prefix = _hashes(*tb.text_bytes(part.column(0)))
            for s, lookup in lookups.items():
                _, place = lookup.find(_span(prefix, w.windows(s), s))
                totals[s] += np.bincount(place, minlength=len(totals[s]))
        for s, lookup in lookups.items():
            some = np.flatnonzero(totals[s])
            yield pa.RecordBatch.from_arrays([pa.array(lookup.sorted[some].view(np.int64)), pa.array(totals[s][some])], names=["shingle", "n"])

    rows = docs.select("text").mapInArrow(tb.tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, hit_words (one bit for each word) and items (sorted ids with a window in the text)."""
    return apart(docs, lambda rows: _found(rows, benchmark), [name for name, _ in FIELDS])


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out, found = docs.withColumns({"hit_words": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")}), False
    for block in blocks(benchmark):
        block.file(*shingle_counts(docs, block))
        out, found = _marked(out, block), True
    return out if found else _marked(out, None)


def _marked(df: DataFrame, block: Block | None) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(block)
    before = df.withColumnsRenamed({"hit_words": "__hit", "items": "__items"})

    def mark(part: pa.RecordBatch) -> list:
        text, hit, items = (part.column(part.schema.get_field_index(x)) for x in ("text", "__hit", "__items"))
        w, prefix = _hashes(*tb.text_bytes(text))
        cover, own = np.zeros(len(w), bool), {}
        if sent.value is not None:
            begin, number = sent.value.search(w, prefix)
            cover = w.covered(begin, sent.value.sizes[number])
            row = np.searchsorted(w.first, begin, "right") - 1
            for i, k in np.unique(np.stack([row, number], axis=1), axis=0).tolist():
                own.setdefault(i, set()).update(sent.value.owners[k])
        bits, lists = [], []
        for i in range(part.num_rows):
            a, b = w.first[i], w.first[i + 1]
            if hit[i].is_valid:
                cover[a:b] |= np.unpackbits(np.frombuffer(hit[i].as_py(), np.uint8), count=b - a).astype(bool)
            bits.append(np.packbits(cover[a:b]).tobytes())
            lists.append(sorted(own.get(i, set()).union(items[i].as_py() or ())))
        return [w.counts.astype(np.int64), w.per_row(cover), pa.array(bits, pa.binary()), pa.array(lists, pa.list_(pa.string()))]

    return tb.with_columns(before, FIELDS, mark).drop("__hit", "__items")
