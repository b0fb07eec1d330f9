"""SentencePiece encoding with seeded merge dropout, and decoding without loss.

A text gets the model's space prefix and is cut where no merge can cross (before
runs of spaces, around line feeds).  Each cut piece is merged from characters by
agenda: the best-ranked candidate is taken out first and skipped if a keyed hash
of (seed, doc_id, the piece's number and text, span) falls below the dropout
rate; a skipped candidate doesn't come back, but one made by a later merge is a
new one.  So every occurrence of a word is dealt by itself.  What a piece becomes
depends only on which candidates are skipped: a worker remembers, within a bound,
a tree of these choices for each piece, in which the 64-bit hashes of an occurrence
lead to its ids.  Candidates of equal rank are taken from the left.  With a rate
of 0 the ids are the library's own (but for a literal U+2581, see below).  Ids
depend on nothing but the row, the seed and the rate.  That the model's merges
stay within the cut pieces and that it doesn't change texts is checked.

Characters without a piece become byte pieces.  So does the space mark U+2581
itself where the text holds one, which the library would turn into a space;
decoding therefore gives back every text exactly.

Defined results.  A null text has null ids and decodes to null; an empty one
has no ids.  A null doc_id counts as 0 in the key.  Repeated rows get equal ids.
Extra columns pass; one named like a result is replaced.  An empty table has no
rows.  A very long text is encoded in pieces cut before words, with the numbers
that its pieces have in the whole; a piece above SHORT characters isn't remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import textbatch as tb
from .op3_counts import cut_after, cut_points

SEED, RATE = 17, 0.1
#: So many remembered choices are forgotten before the next batch.
NODES = 200_000
SPACE = "▁"
#: Up to this many characters a list beats a heap as agenda.
SHORT = 64
_CUT = re.compile("\n| +[^ \n]*|[^ \n]+")
_MARK, _NEVER, _LAST = "\n", 1 << 60, (1 << 31) - 1
#: Odd multipliers of a span's start, middle and end.
_WIDE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_ALL = (1 << 64) - 1
#: Choices of a piece up to this one are remembered.
STEPS = 62


class Model:
    """Ranks, ids and bytes of a SentencePiece BPE model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        cut_points(model)
        n = model.vocab_size()
        self.bytes: list[bytes] = [b""] * n
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        order = sorted(self.ids, key=lambda p: (-model.get_score(self.ids[p]), self.ids[p]))
        self.ranks = {p: r for r, p in enumerate(order)}

    def codes(self, symbols: list[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in (SPACE if s == _MARK else s).encode()]
        return out


def merge(piece: str, ranks: dict[str, int], skip: Callable[[int, int, int], bool]) -> list[str]:
    """Symbols of a piece after the agenda is empty; skip is asked once for each candidate (start, middle, end)."""
    # within a piece a literal space mark is stood for by a line feed, which no vocabulary piece holds
    parts = [*piece.replace(SPACE, _MARK).replace(" ", SPACE)]
    if len(parts) > SHORT:
        return _merge_long(parts, ranks, skip)
    get, starts = ranks.get, [*range(len(parts) + 1)]
    agenda = [get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
    while agenda:
        best = min(agenda)
        if best == _NEVER:
            break
        i = agenda.index(best)
        j = i + 1
        if skip(starts[i], starts[j], starts[j + 1]):
            agenda[i] = _NEVER
            continue
        parts[i] += parts[j]
        del parts[j], starts[j], agenda[i]
        if i < len(agenda):
            agenda[i] = get(parts[i] + parts[j], _NEVER)
        if i:
            agenda[i - 1] = get(parts[i - 1] + parts[i], _NEVER)
    return parts


def _merge_long(parts: list[str], ranks: dict[str, int], skip: Callable[[int, int, int], bool]) -> list[str]:
    n = len(parts)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        m = end[a]
        if m < n and (r := ranks.get(parts[a] + parts[m])) is not None:
            heapq.heappush(agenda, (r, a, m, end[m]))

    for a in range(n - 1):
        offer(a)
    while agenda:
        _, a, m, b = heapq.heappop(agenda)
        if not parts[a] or end[a] != m or m >= n or end[m] != b or skip(a, m, b):
            continue  # one of its symbols has been merged since, or it is dropped
        parts[a] += parts[m]
        parts[m] = ""
        end[a] = b
        if b < n:
            before[b] = a
            offer(a)
        if a:
            offer(before[a])
    return [p for p in parts if p]


class Pairs:
    """Which two symbols merge, into what and with which rank: a hash table for numpy.

    Symbols are the pieces by id and, after them, characters of pieces that are
    no pieces themselves; -1 is any other character.
    """

    BITS = 20

    def __init__(self, model: Model):
        number = dict(model.ids)
        for c in sorted({c for p in model.ids for c in p} - model.ids.keys()):
            number[c] = len(model.bytes) + len(number) - len(model.ids)
        self.pieces, self.width = len(model.bytes), len(model.bytes) + len(number)
        rows = [(number[p[:k]] * self.width + number[p[k:]], model.ranks[p], i) for p, i in model.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        key, rank, merged = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        size = 1 << self.BITS
        self.key, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, _LAST, np.int32), np.zeros(size, np.int32)
        left, slot = np.arange(len(key)), self.slots(key)
        while len(left):  # what finds its place taken goes one further
            free = left[self.key[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.key[at], self.rank[at], self.merged[at] = key[placed], rank[placed], merged[placed]
            left = np.setdiff1d(left, placed)
            slot[left] = (slot[left] + (self.key[slot[left]] != key[left])) & (size - 1)
        self.character = np.full(0x110000, -1, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.character[ord(c)] = i
        self.character[0x20], self.character[ord(SPACE)] = self.character[ord(SPACE)], -1  # a literal mark is no space

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (_LAST for no merge) and merged symbols of pairs."""
        key = np.where((a < 0) | (b < 0), -2, a.astype(np.int64) * self.width + b)
        slot = self.slots(key)
        todo = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            there = self.key[slot[todo]]
            todo = todo[(there != key[todo]) & (there >= 0)]
        return np.where(self.key[slot] == key, self.rank[slot], _LAST), self.merged[slot]


def segment_many(pieces: list[str], pairs: Pairs, skip: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """merge() of many pieces of 1 to SHORT characters, step by step side by side.

    skip is asked with the pieces' numbers and their candidates' starts, middles
    and ends, one candidate a piece at each step.  Gives the symbols of all pieces one after another, and their numbers.  Row r
    keeps its symbols in the columns of their first characters; following and
    earlier lead from one symbol to the next and back.
    """
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n, width = len(pieces), int(length.max(initial=1))
    column = np.arange(width)
    inside = column < length[:, None]
    symbol = np.full((n, width), -1, np.int32)
    symbol[inside] = pairs.character[np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)]
    live = inside.copy()
    following = np.broadcast_to(column + 1, (n, width)).astype(np.int64)
    earlier = following - 2
    rank, merged = np.full((n, width), _LAST, np.int32), np.zeros((n, width), np.int32)
    r, c = np.nonzero(column < length[:, None] - 1)
    rank[r, c], merged[r, c] = pairs.find(symbol[r, c], symbol[r, c + 1])
    rows = np.arange(n)
    while len(rows):
        i = np.argmin(rank[rows], axis=1)  # of equal ranks the leftmost
        some = rank[rows, i] < _LAST
        rows, i = rows[some], i[some]
        if not len(rows):
            break
        m = following[rows, i]
        b = following[rows, m]
        out = skip(rows, i, m, b)
        rank[rows[out], i[out]] = _LAST
        r, i, m, b = (x[~out] for x in (rows, i, m, b))
        symbol[r, i] = merged[r, i]
        following[r, i] = b
        rank[r, m], live[r, m] = _LAST, False
        rank[r, i] = _LAST
        more = b < length[r]
        x, y, z = r[more], i[more], b[more]
        earlier[x, z] = y
        rank[x, y], merged[x, y] = pairs.find(symbol[x, y], symbol[x, z])
        p = earlier[r, i]
        more = p >= 0
        x, y, z = r[more], p[more], i[more]
        rank[x, y], merged[x, y] = pairs.find(symbol[x, y], symbol[x, z])
    return symbol[live], live.sum(axis=1)


def _put(a: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """a with values from at on, twice as long if it is full."""
    if at + len(values) > len(a):
        a = np.concatenate([a, np.empty(max(len(a), at + len(values) - len(a)), a.dtype)])
    a[at : at + len(values)] = values
    return a


class Tree:
    """Every occurrence of a piece dealt by itself.

    A node is a piece with the choices made so far (bit t of its mask: the t-th
    candidate was skipped).  It holds the candidates that follow when no other
    one is skipped, the ids that come of it, and by candidate the node to go to
    when that one is the next skipped.  Node 0 stands for pieces that are merged
    one by one and not remembered.
    """

    def __init__(self, path: str, seed: int, rate: float):
        self.model, self.seed = Model(path), seed
        self.pairs, self.below = Pairs(self.model), int(rate * 2.0**53)
        self.forget()

    def forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.piece, self.mask, self.first = [""], [0], [0]
        self.text = np.zeros(1, np.uint64)
        self.start, self.id_start = np.zeros(2, np.int64), np.zeros(2, np.int64)
        self.code, self.child, self.ids = np.zeros(64, np.uint64), np.zeros(64, np.int64), np.zeros(64, "<u4")

    def hashed(self, piece: str) -> int:
        return xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), self.seed)

    def skips(self, salt: int) -> Callable[[int, int, int], bool]:
        """The choices of one occurrence, one at a time."""

        def skip(a: int, m: int, b: int) -> bool:
            h = salt + a * _WIDE[0] + m * _WIDE[1] + b * _WIDE[2] & _ALL
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _ALL
            h = (h ^ h >> 27) * 0x94D049BB133111EB & _ALL
            return (h ^ h >> 31) >> 11 < self.below

        return skip

    def add(self, pieces: list[str], masks: list[int], firsts: list[int], texts: np.ndarray, codes: np.ndarray, n: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> int:
        """Nodes in a row; the number of the first."""
        at = len(self.piece)
        self.piece += pieces
        self.mask += masks
        self.first += firsts
        self.text = _put(self.text, at, texts)
        a, b = int(self.start[at]), int(self.id_start[at])
        self.start = _put(self.start, at + 1, a + np.cumsum(n))
        self.id_start = _put(self.id_start, at + 1, b + np.cumsum(n_ids))
        self.code = _put(self.code, a, codes)
        self.child = _put(self.child, a, np.full(len(codes), -1, np.int64))
        self.ids = _put(self.ids, b, ids)
        return at

    def grow(self, pieces: list[str], masks: list[int], firsts: list[int], texts: np.ndarray) -> np.ndarray:
        """Numbers of the new nodes for pieces of 1 to SHORT characters and masks."""
        out = np.zeros(len(pieces), np.int64)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        for at in range(0, len(order), 4096):
            some = order[at : at + 4096]
            p, mask, first = [pieces[k] for k in some], [masks[k] for k in some], [firsts[k] for k in some]
            bits, steps = np.array(mask, np.uint64), []

            def skip(rows, a, m, b, bits=bits, steps=steps):
                u = [x.astype(np.uint64) * np.uint64(w) for x, w in zip((a, m, b), _WIDE, strict=True)]
                t = len(steps)
                steps.append((rows, u[0] + u[1] + u[2]))
                return (bits[rows] >> np.uint64(t)) & np.uint64(1) > 0 if t <= STEPS else np.zeros(len(rows), bool)

            symbols, n_ids = segment_many(p, self.pairs, skip)
            table = np.zeros((len(p), len(steps)), np.uint64)
            n = np.zeros(len(p), np.int64)
            for t, (rows, code) in enumerate(steps):
                table[rows, t] = code
                n[rows] = t + 1
            begin = np.array(first, np.int64)
            t = np.arange(len(steps))
            codes = table[(t >= begin[:, None]) & (t < n[:, None])]
            odd = (symbols < 0) | (symbols >= self.pairs.pieces)
            if odd.any():  # characters outside the vocabulary become bytes
                ends, whole = np.cumsum(n_ids), []
                strange = set(np.searchsorted(ends, np.flatnonzero(odd), "right").tolist())
                for k, (a, b) in enumerate(zip((ends - n_ids).tolist(), ends.tolist(), strict=True)):
                    whole.append(self.bytewise(p[k], mask[k]) if k in strange else symbols[a:b].astype("<u4"))
                symbols, n_ids = np.concatenate(whole), np.fromiter(map(len, whole), np.int64, len(whole))
            to = self.add(p, mask, first, texts[some], codes, n - begin, symbols.astype("<u4"), n_ids)
            out[some] = to + np.arange(len(p))
        return out

    def bytewise(self, piece: str, mask: int) -> np.ndarray:
        step = iter(range(1 << 30))
        return np.array(self.model.codes(merge(piece, self.model.ranks, lambda a, m, b: mask >> next(step) & 1 > 0)), "<u4")

    def alone(self, piece: str, salt: int) -> int:
        """A node for one occurrence."""
        ids = [self.model.byte_ids[10]] if piece == "\n" else self.model.codes(merge(piece, self.model.ranks, self.skips(salt)))
        none = np.zeros(0, np.uint64)
        return self.add([""], [0], [0], np.zeros(1, np.uint64), none, np.zeros(1, np.int64), np.array(ids, "<u4"), np.array([len(ids)]))

    def known(self, pieces: set[str]) -> None:
        """Have the roots of all pieces."""
        new = [p for p in pieces if p not in self.roots and len(p) <= SHORT]
        if "\n" in new:
            self.roots["\n"] = self.alone("\n", 0)
        new = [p for p in new if p != "\n"]
        if new:
            texts = np.fromiter(map(self.hashed, new), np.uint64, len(new))
            self.roots |= zip(new, self.grow(new, [0] * len(new), [0] * len(new), texts).tolist(), strict=True)

    def follow(self, at: np.ndarray, parent: np.ndarray) -> None:
        """Have the nodes behind these candidates of these nodes."""
        step = np.fromiter((self.first[k] for k in parent.tolist()), np.int64, len(parent)) + at - self.start[parent]
        self.child[at[step > STEPS]] = 0
        at, parent, step = (x[step <= STEPS] for x in (at, parent, step))
        if len(at):
            masks = [self.mask[k] | 1 << t for k, t in zip(parent.tolist(), step.tolist(), strict=True)]
            self.child[at] = self.grow([self.piece[k] for k in parent.tolist()], masks, (step + 1).tolist(), self.text[parent])

    def encode_all(self, doc_ids: list[int | None], texts: list[str | None], first: int = 0) -> list[bytes]:
        """Ids of texts; first: the number of their first piece."""
        if len(self.piece) > NODES:
            self.forget()
        cut = [_CUT.findall(" " + t) if t else [] for t in texts]
        flat = [p for pieces in cut for p in pieces]
        self.known(set(flat))
        numbers = [np.zeros(0, np.uint64)]
        for d, pieces in zip(doc_ids, cut, strict=True):
            key = np.uint64(xxhash.xxh64_intdigest((d or 0).to_bytes(8, "little", signed=True), self.seed))
            numbers.append(key + np.arange(first, first + len(pieces), dtype=np.uint64))
        salt = tb.mix64(np.concatenate(numbers))
        node = np.fromiter((self.roots.get(p, 0) for p in flat), np.int64, len(flat))
        salt += self.text[node]
        for k in np.flatnonzero(node == 0).tolist():
            node[k] = self.alone(flat[k], int(salt[k]) + self.hashed(flat[k]) & _ALL)
        active = np.arange(len(flat))
        while len(active):
            begin = self.start[node[active]]
            n = self.start[node[active] + 1] - begin
            row = np.repeat(np.arange(len(active)), n)
            at = np.arange(len(row)) + (begin - np.cumsum(n) + n)[row]
            hit = np.flatnonzero((tb.mix64(salt[active][row] + self.code[at]) >> np.uint64(11)) < np.uint64(self.below))
            row, at = row[hit], at[hit]
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            active, at = active[row[first]], at[first]
            new = np.flatnonzero(self.child[at] < 0)
            if len(new):
                some, index = np.unique(at[new], return_index=True)
                self.follow(some, node[active[new[index]]])
            node[active] = self.child[at]
            single = node[active] == 0
            for k in active[single].tolist():
                node[k] = self.alone(flat[k], int(salt[k]))
            active = active[~single]
        begin = self.id_start[node]
        n = self.id_start[node + 1] - begin
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)].tobytes()
        bounds = (4 * ends[np.cumsum([0, *map(len, cut)])]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, doc_id: int | None, text: str) -> bytes:
        """One text of any length, in pieces."""
        out, at, number = [], 0, 0
        while at < len(text):
            to = cut_after(text, at + tb.PIECE)
            part = text[at + (at > 0) : to]  # a later part's space is the one that encode_all puts before a text
            out += self.encode_all([doc_id], [part], number)
            number += len(_CUT.findall(" " + part)) if to < len(text) else 0
            at = to
        return b"".join(out)


def encode(docs: DataFrame, path: str, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """docs with ids (little-endian unsigned 32-bit) and n_ids."""
    state: dict[str, Tree] = {}

    def run(part: pa.RecordBatch) -> list:
        if "e" not in state:
            state["e"] = Tree(path, seed, rate)
        doc, text = (part.column(part.schema.get_field_index(x)) for x in ("doc_id", "text"))
        doc, texts = doc.to_pylist(), text.to_pylist()
        ids = [state["e"].encode(doc[0], texts[0] or "")] if len(texts) == 1 else state["e"].encode_all(doc, texts)
        ids = [x if t is not None else None for x, t in zip(ids, texts, strict=True)]
        return [pa.array(ids, pa.binary()), pa.array([len(x or b"") // 4 for x in ids], pa.int64())]

    return tb.with_columns(docs, [("ids", "binary"), ("n_ids", "long")], run)


def decode(encoded: DataFrame, path: str, to: str = "decoded") -> DataFrame:
    """encoded (with a column ids) and the text that its ids stand for."""
    state: dict[str, list[bytes]] = {}

    def run(part: pa.RecordBatch) -> list:
        if "b" not in state:
            state["b"] = Model(path).bytes
        table = state["b"].__getitem__
        out = []
        for x in part.column(part.schema.get_field_index("ids")):
            raw = b"".join(map(table, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else None
            out.append(raw[1:].decode() if raw is not None else None)  # without the space prefix
        return [pa.array(out, pa.string())]

    return tb.with_columns(encoded, [(to, "string")], run)
