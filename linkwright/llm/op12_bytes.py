"""Byte-level BPE: encoding by a rank queue over a hierarchical bitmap, and decoding.

A text is cut by the vocabulary's pattern; each match (pre-token) is encoded by
itself.  A match that is a token is that token, as the library has it.  For any
other, neighbouring parts merge, the pair of the lowest rank first and of equal
ones the leftmost, until no pair has a rank.

The queue of pairs has a bucket for each rank, which holds positions in the linked
list of parts.  A bitmap marks the buckets that aren't empty, and a second one above
it the words of the first that aren't zero, so the next rank is found by two
find-first-set steps, however many ranks or positions there are.  A merge makes at
most two new pairs; entries whose pair has changed are skipped when they come up.
A pre-token of n bytes needs n merges at most, so a text of one pre-token costs no
more a byte than others do.  Above LONG bytes the first ranks come from a table of
byte pairs, and the linked list and first positions lie in packed arrays.

A worker remembers, within a bound, the ids of pre-tokens it has met.  Characters
that the two libraries' Unicode tables class differently (letters and numbers newer
than the tokenizer's) are found by asking the library, and taken as it takes them.

Defined results.  A null text is an empty one: no ids, empty bytes.  A null doc_id
passes.  Repeated rows get equal ids.  Strings of special tokens are ordinary text.
Extra columns pass; one named like a result is replaced.  An empty table has no rows.
A very long text is read whole, and encoded in pieces cut behind a run of letters or
numbers, where every match ends; a single pre-token takes about forty bytes of memory
for each of its own.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from . import textbatch as tb
from .shared import small_batches

#: Characters of text that are cut at once; bytes from which a pre-token is a long one.
PIECE, LONG = 1 << 20, 1 << 10
#: Remembered pre-tokens (twice as many with those before), and characters of one that is remembered.
REMEMBERED, SHORT = 250_000, 48
#: Bits of a word of the lower bitmap.
SHIFT = 8
_MASK = (1 << SHIFT) - 1
_BIT = [1 << k for k in range(1 << SHIFT)]
#: Linked lists of parts of one byte.
_AFTER, _BEFORE = list(range(1, LONG + 1)), list(range(-1, LONG - 1))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by rank: the lowest rank first, and the leftmost position of it."""

    def __init__(self, ranks: int):
        self.words, self.top = [0] * ((ranks >> SHIFT) + 1), 0
        self.buckets: dict[int, list[int]] = {}
        self.first: dict[int, tuple[int, int]] = {}  # of ranks that fill() has met, what is left in places
        self.places = np.zeros(0, np.int32)

    def _mark(self, rank: int) -> None:
        self.words[rank >> SHIFT] |= 1 << (rank & _MASK)
        self.top |= 1 << (rank >> SHIFT)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
        else:
            self.buckets[rank] = [position]
            self._mark(rank)

    def fill(self, ranks: np.ndarray) -> None:
        """The rank of every position, -1 where there is none; into an empty queue."""
        at = np.flatnonzero(ranks >= 0).astype(np.int32)
        self.places = at[np.argsort(ranks[at], kind="stable")]
        of = ranks[self.places]
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.first[int(of[a])] = (a, b)
            self._mark(int(of[a]))

    def pop(self) -> tuple[int, int]:
        """(rank, position), taken out; the queue must not be empty (top is 0 then)."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        rank = w << SHIFT | (word & -word).bit_length() - 1
        bucket, first = self.buckets.get(rank), self.first.get(rank)
        if first is not None and not (bucket and bucket[0] < self.places[first[0]]):
            position, first = int(self.places[first[0]]), (first[0] + 1, first[1])
            if first[0] < first[1]:
                self.first[rank] = first
            else:
                del self.first[rank]
        else:
            position = heappop(bucket)
        if not bucket and rank not in self.first:
            self.buckets.pop(rank, None)
            word &= word - 1
            self.words[w] = word
            if not word:
                self.top &= self.top - 1
        return rank, position


class Encoder:
    """Ids of texts by a file of ranks; remembers pre-tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, odd: str | None = None):
        self.ranks = read_ranks(path)
        self.size = max(self.ranks.values()) + 1
        self.queue, self.packed = RankQueue(self.size), {r: r.to_bytes(4, "little") for r in self.ranks.values()}
        self.pairs = np.full(1 << 16, -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.pair_list = self.pairs.tolist()
        self.pattern, self.ascii, self.odd, self.own = patterns(pattern, newer(path, pattern) if odd is None else odd)
        self.tokens = {t.decode(): r.to_bytes(4, "little") for t, r in self.ranks.items() if _is_text(t)}
        self.memo = _Memo(self, {})

    def _long(self, piece: bytes) -> tuple[array, array, array]:
        """Linked list and ranks of a long piece; its first pairs go into the queue."""
        b, n = np.frombuffer(piece, np.uint8), len(piece)
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.pairs[b[:-1].astype(np.int32) << 8 | b[1:]]
        self.queue.fill(ranks)
        after, before = (array("i", np.arange(a, n + a, dtype=np.int32).tobytes()) for a in (1, -1))
        return after, before, array("i", ranks.tobytes())

    def merged(self, piece: bytes) -> bytes:
        """Packed ids of one pre-token."""
        return self._by_queue(piece) if len(piece) >= LONG else self._short(piece)

    def _by_queue(self, piece: bytes) -> bytes:
        n, find, queue = len(piece), self.ranks.get, self.queue
        after, before, rank_at = self._long(piece)
        while queue.top:
            rank, i = queue.pop()
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i], rank_at[j], rank_at[i] = k, -1, -1
            if k < n:
                before[k] = i
                rank = find(piece[i : after[k]])
                if rank is not None:
                    rank_at[i] = rank
                    queue.push(rank, i)
            h = before[i]
            if h >= 0:
                rank = find(piece[h:k])
                if rank is None:
                    rank_at[h] = -1
                elif rank_at[h] != rank:
                    rank_at[h] = rank
                    queue.push(rank, h)
        ids, i = array("I"), 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return np.array(ids, "<u4").tobytes()

    def _short(self, piece: bytes) -> bytes:
        """The same with the queue's steps in line and all positions in its buckets."""
        n, find, pairs, words, top = len(piece), self.ranks.get, self.pair_list, self.queue.words, 0
        after, before, buckets = _AFTER[:n], _BEFORE[:n], {}
        rank_at = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:], strict=False)]
        for i, rank in enumerate(rank_at):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> SHIFT] |= _BIT[rank & _MASK]
                    top |= _BIT[rank >> SHIFT]
        rank_at.append(-1)
        while top:
            low = top & -top
            w = low.bit_length() - 1
            word = words[w]
            bit = word & -word
            rank = w << SHIFT | bit.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[w] = word = word ^ bit
                if not word:
                    top ^= low
            if rank_at[i] != rank:
                continue  # stale
            j = after[i]
            after[i] = k = after[j]
            rank_at[j] = rank_at[i] = -1
            if k < n:
                before[k] = i
                rank = find(piece[i : after[k]])
                if rank is not None:
                    rank_at[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        words[rank >> SHIFT] |= _BIT[rank & _MASK]
                        top |= _BIT[rank >> SHIFT]
            h = before[i]
            if h >= 0:
                rank = find(piece[h:k])
                if rank is None:
                    rank_at[h] = -1
                elif rank_at[h] != rank:
                    rank_at[h] = rank
                    if rank in buckets:
                        heappush(buckets[rank], h)
                    else:
                        buckets[rank] = [h]
                        words[rank >> SHIFT] |= _BIT[rank & _MASK]
                        top |= _BIT[rank >> SHIFT]
        ids, i, ranks, packed = [], 0, self.ranks, self.packed
        while i < n:
            k = after[i]
            ids.append(packed[ranks[piece[i:k]]])
            i = k
        return b"".join(ids)

    def cut(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of about PIECE characters."""
        if text.isascii() and self.ascii is not None:
            find = self.ascii
        else:
            find = self.own if self.odd is not None and self.odd.search(text) else self.pattern
        at, n = 0, len(text)
        while at < n:
            end = _END.search(text, at + PIECE) if n - at > PIECE else None
            to = end.end() if end else n
            yield find.findall(text, at, to)
            at = to

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = []
        for words in self.cut(text or ""):
            parts.append(b"".join(map(self.memo.__getitem__, words)))
            if len(self.memo) > len(self.tokens) + REMEMBERED:
                self.memo = _Memo(self, dict(self.memo))
        return parts[0] if len(parts) == 1 else b"".join(parts)


class _Memo(dict):
    """Ids of the tokens and of the pre-tokens met of late; what the memo before it has is taken over when it is met again."""

    def __init__(self, encoder: Encoder, older: dict[str, bytes]):
        super().__init__(encoder.tokens)
        self.encoder, self.older = encoder, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.encoder.merged(word.encode())
        if len(word) <= SHORT:
            self[word] = ids
        return ids


#: Behind it every match has ended.
_END = regex.compile(r"[\p{L}\p{N}](?![\p{L}\p{N}])")


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def patterns(pattern: str, odd: str) -> tuple:
    """The pattern; one for ASCII texts; the odd characters (a class's ranges), and the pattern for texts with them (None: none)."""
    plain = pattern
    for of, to in ((r"[^\s\p{L}\p{N}]", "[^ \\t-\\rA-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", "[ \\t-\\r]"), (r"\S", "[^ \\t-\\r]")):
        plain = plain.replace(of, to)
    own, ascii_only = regex.compile(pattern), None if r"\p" in plain else re.compile(plain)
    if not odd:
        return own, ascii_only, None, None
    kept = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{odd}]]")
    kept = regex.sub(r"(?<!\^\\s)(?<!\^\\s\\p\{L\})\\p\{([LN])\}", lambda m: f"[\\p{{{m[1]}}}--[{odd}]]", kept)
    return own, ascii_only, regex.compile(f"[{odd}]"), regex.compile(kept, regex.V1)


@lru_cache
def newer(path: str, pattern: str) -> str:
    """Ranges of the letters and numbers that this Python's Unicode tables don't have and the tokenizer's library doesn't take for such either."""
    ranks, own = read_ranks(path), regex.compile(pattern)
    library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    found = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and _LETTER.match(chr(c))]
    of = lambda text: [i for w in own.findall(text) for i in library._encode_single_piece(w.encode())]
    odd = np.array([c for c in found if any(of(t) != library.encode_ordinary(t) for t in (f"{chr(c)}'s", f"a{chr(c)}b", f"1{chr(c)}2"))], np.int64)
    runs = np.split(odd, np.flatnonzero(np.diff(odd) > 1) + 1) if len(odd) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


_LETTER = regex.compile(r"[\p{L}\p{N}]")
FIELDS = [("n_tokens", "long"), ("ids", "binary")]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with n_tokens and ids (little-endian unsigned 32-bit integers)."""
    odd, state = newer(path, pattern), {}

    def run(part: pa.RecordBatch) -> list:
        if "e" not in state:
            state["e"] = _encoder(path, pattern, odd)
        ids = [state["e"].encode(t.as_py()) for t in part.column(part.schema.get_field_index("text"))]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

    return tb.with_columns(docs, FIELDS, run)


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str, odd: str) -> Encoder:
    """One for all tasks of a worker."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern, odd)
    return _encoders[path, pattern]


def decode(encoded: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """encoded (with a column ids) and the bytes that its ids stand for; null ids give null."""
    small_batches(encoded.sparkSession)
    encoded = encoded.drop(to)
    schema = StructType([*[StructField(f.name, f.dataType) for f in encoded.schema.fields], StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes] = []
        for batch in batches:
            if not table:
                ranks = read_ranks(path)
                table = [b""] * (max(ranks.values()) + 1)
                for token, rank in ranks.items():
                    table[rank] = token
            at = table.__getitem__
            ids = batch.column(batch.schema.get_field_index("ids"))
            out = [b"".join(map(at, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.mapInArrow(tb.tidy(run), schema)
