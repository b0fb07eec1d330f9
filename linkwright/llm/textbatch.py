"""Vectorised views of the text column of an Arrow batch.

The operators read documents in ``mapInArrow``.  A batch is cut into slices
of a few MB, and words, lines and hashes of a whole slice are computed at once
by numpy over the UTF-8 bytes, so no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .shared import small_batches

SLICE_BYTES = 1 << 19
#: What is worked out byte by byte goes by pieces of so many bytes, so a long text needs no more.
PIECE = 1 << 19
#: Bytes of a word up to which the polynomial hashes are used.
SHORT_WORD = 32
_U64 = np.uint64
#: Odd multipliers of the polynomial hashes modulo 2**64, and a second pair for independent ones.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BYTE_BASE_2, WORD_BASE_2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_BLANK = re.compile(rb"[ \t-\r]")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, _U64), np.full(n, pow(base, -1, 1 << 64), _U64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=_U64), np.cumprod(down, dtype=_U64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


@lru_cache
def byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))


def prefix_hashes(codes: np.ndarray, base: int) -> np.ndarray:
    """S with S[i] = sum of codes[t] * base**t over t < i; see span_hashes."""
    out = np.zeros(len(codes) + 1, _U64)
    np.cumsum(codes * powers(base, len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed Rabin-Karp hashes of the spans [starts, ends) of what prefix_hashes read."""
    return mix64((prefix[ends] - prefix[starts]) * powers(base, len(prefix))[1][starts])


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true for the byte values in the closed ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


SPACE = table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of a word that ends at ASCII white space.
PLAIN = ~SPACE
#: Bytes of a lower-cased alphanumeric word; all of non-ASCII counts.
ALNUM = table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets from 0; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that a slice holds limit bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().lower(), np.uint8)


def look(flags: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """flags[buf] for 256 booleans, one byte of memory for each byte."""
    return np.frombuffer(buf.tobytes().translate(flags.astype(np.uint8).tobytes()), bool)


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text between ASCII white space, in lists of about PIECE bytes."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE)
        to = blank.end() if blank else len(text)
        yield text[at:to].split()
        at = to


class Words:
    """Words of a slice: byte spans, owning rows, first word of each row."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.buf, self.offsets, n = buf, offsets, len(buf)
        self.mask = look(inside, buf)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        if n:
            before[1:] = ~self.mask[:-1] | edge[1:n]
            after[:-1] = ~self.mask[1:] | edge[1:n]
        self.starts = np.flatnonzero(self.mask & before)
        self.ends = np.flatnonzero(self.mask & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, base: int = BYTE_BASE) -> np.ndarray:
        """A hash of each word; another base gives an independent one.

        Words above SHORT_WORD bytes are hashed by XXH64: sums modulo 2**64 are alike for
        some long words whatever the base (a Thue-Morse word and its complement).
        """
        out, at, codes, step = np.empty(len(self), _U64), 0, byte_codes(), max(PIECE, SHORT_WORD)
        while at < len(self):
            low = int(self.starts[at])
            to = int(np.searchsorted(self.ends, low + step, "right"))
            if to > at:
                p = prefix_hashes(codes[self.buf[low : self.ends[to - 1]]], base)
                out[at:to] = span_hashes(p, self.starts[at:to] - low, self.ends[at:to] - low, base)
            at = max(to, at + 1)  # a word longer than a piece is a long one
        raw, seed = memoryview(self.buf), base & (1 << 64) - 1
        for k in np.flatnonzero(self.ends - self.starts > SHORT_WORD).tolist():
            out[k] = xxhash.xxh64_intdigest(raw[self.starts[k] : self.ends[k]], seed)
        return out

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of size words that lie in one row."""
        ok = np.zeros(len(self), bool)
        n = len(self) - size + 1
        if n > 0:
            rows = self.rows()
            ok[:n] = rows[:n] == rows[size - 1 :]
        return np.flatnonzero(ok)

    def covered(self, begin: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """True for each word in one of the windows that start at the words begin."""
        n = len(self) + 1
        delta = np.bincount(begin, minlength=n) - np.bincount(begin + size, minlength=n)
        return np.cumsum(delta[:-1]) > 0

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sums by row of a value for each word."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (one for each byte) over consecutive spans."""
    upto, before = np.zeros(len(offsets), np.int64), 0
    for at in range(0, len(values), PIECE):
        total = np.cumsum(values[at : at + PIECE], dtype=np.int64)
        a, b = np.searchsorted(offsets, [at, at + len(total)], "right")
        upto[a:b] = before + total[offsets[a:b] - at - 1]
        before += int(total[-1])
    return np.diff(upto)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for every key that occurs twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def release() -> None:
    """Give memory that earlier tasks of this worker have left free back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, in a worker that begins each task with release(): workers live through many stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from fn(batches)

    return run


def with_columns(df: DataFrame, fields: list[tuple[str, str]], fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """df and new columns that fn makes for each slice of its rows.

    fields: names and Spark types of the new columns.  An input column of the
    same name is replaced.  df must have a column text.
    """
    small_batches(df.sparkSession)
    df = df.drop(*[name for name, _ in fields])
    added = [StructField(name, T._parse_datatype_string(kind)) for name, kind in fields]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            new = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(part)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return df.mapInArrow(tidy(run), schema)
