"""Levenshtein distances of many pairs of texts at once, inside a task: bounds by letters, then Myers' bit-parallel columns over all pairs left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Classes of letters and counts of each in a signature; pairs of values that are looked at together, pairs whose letters are compared together, and pairs of columns (they fit a cache); entries of a table of masks.
CLASSES, COUNTED, AT_ONCE, DENSE, COLUMNS, MASKS = 32, 4, 1 << 18, 1 << 16, 1 << 15, 1 << 22
#: Counts of a class in the signature of a beginning or an end; lengths of texts that share their cuts; bits in common that are counted.
TWICE, LENGTHS, FULL = 2, 3, 127
#: Where texts are cut in two, as shares of the shorter length.
CUTS = (1 / 2, 1 / 3, 2 / 3)
#: Characters of a pattern in one word, and the words.
WORD, WORDS = 64, {32: np.uint32, 64: np.uint64}


class Texts:
    """Code points of texts one after the other, their places and lengths, and signatures of their letters."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(len(texts)), self.length)
        counts = np.bincount(row * CLASSES + self.flat % CLASSES, minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
        counts = np.minimum(counts, COUNTED).astype(np.uint64)
        self.letters = counts.sum(axis=1).astype(np.int16)
        place = np.arange(CLASSES // 2, dtype=np.uint64) * np.uint64(COUNTED)
        unary = ((np.uint64(1) << counts) - np.uint64(1)).reshape(-1, 2, CLASSES // 2) << place
        self.marks = np.ascontiguousarray(unary.sum(axis=2, dtype=np.uint64).T)  # two words of 16 classes
        self.ends: dict[bool, list[np.ndarray]] = {}
        self.seen: dict[bool, np.ndarray] = {}

    def part(self, n: int, last: bool) -> np.ndarray:
        """Signatures of the first (last) n letters of each text, WORD at most, or of all where it has fewer."""
        if last not in self.ends:
            self.ends[last], self.seen[last] = [np.zeros(len(self.texts), np.uint64)], np.zeros((len(self.texts), CLASSES), np.uint64)
        found, seen = self.ends[last], self.seen[last]
        while len(found) <= n:
            k = len(found)
            rows = np.flatnonzero(self.length >= k)
            kind = self.flat[self.start[rows] + (self.length[rows] - k if last else k - 1)] % CLASSES
            count, marks = seen[rows, kind], found[-1].copy()
            few = count < TWICE
            marks[rows[few]] |= np.uint64(1) << (kind[few].astype(np.uint64) * np.uint64(TWICE) + count[few])
            seen[rows, kind] = count + np.uint64(1)
            found.append(marks)
        return found[n]


def masks(flat: np.ndarray, start: np.ndarray, length: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """For each text, of WORD characters at most, and each letter the places where it stands; one more letter stands nowhere."""
    word = WORDS[32 if length.max(initial=0) <= 32 else 64]
    out = np.zeros((len(start), len(alphabet) + 1), word)
    for i in range(int(length.max(initial=0))):
        rows = np.flatnonzero(length > i)
        out[rows, np.searchsorted(alphabet, flat[start[rows] + i])] |= word(1 << i)
    return out


def columns(table: np.ndarray, ia: np.ndarray, la: np.ndarray, letters: np.ndarray, start: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distances of pairs: row ia of the table of masks, of la characters (1 to WORD), and lb letters from start on."""
    order = np.argsort(-lb.astype(np.int16) if lb.max(initial=0) < 1 << 15 else -lb, kind="stable")
    ia, place, la = ia[order], start[order], la[order]
    ending, word, flat = np.sort(lb), table.dtype.type, table.reshape(-1)
    one, at, to = word(1), ia * table.shape[1], np.empty(len(ia), np.int64)
    pv, mv = np.full(len(ia), ~word(0)), np.zeros(len(ia), word)
    eq, xh, ph = (np.empty(len(ia), word) for _ in range(3))
    for j in range(int(lb.max(initial=0))):
        m = len(ending) - int(np.searchsorted(ending, j, "right"))  # texts with a letter at j come first
        e, x, h, p, n = eq[:m], xh[:m], ph[:m], pv[:m], mv[:m]
        np.take(letters, place[:m], out=to[:m], mode="clip")
        to[:m] += at[:m]
        np.take(flat, to[:m], out=e, mode="clip")
        place += 1
        np.bitwise_and(e, p, out=x)  # xh = (((eq & pv) + pv) ^ pv) | eq
        x += p
        x ^= p
        x |= e
        e |= n  # xv
        np.bitwise_or(x, p, out=h)  # ph = ((mv | ~(xh | pv)) << 1) | 1
        np.invert(h, out=h)
        h |= n
        h <<= one
        h |= one
        x &= p  # mh
        x <<= one
        np.bitwise_and(h, e, out=n)
        e |= h
        np.invert(e, out=e)
        np.bitwise_or(x, e, out=p)
    # the last column begins at lb, and each bit is a step down it
    own = ~word(0) >> (word(8 * table.itemsize) - la.astype(word))
    out = np.empty(len(order), np.int64)
    out[order] = lb[order] + np.bitwise_count(pv & own) - np.bitwise_count(mv & own)
    return out


def long_distance(a: str, b: str) -> int:
    """The same for one pair of any length, the column in one integer."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for y in b:
        eq = places.get(y, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return score


def allowed(share: float, longest: np.ndarray) -> np.ndarray:
    """Edits that texts may differ in, of so many characters of the longer one."""
    return np.floor(share * longest + 1e-6).astype(np.int64)


def _likely(a: Texts, rows: np.ndarray, b: Texts, shares: np.ndarray, by_length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in rows of a, and rows of b, of the pairs that letters and lengths don't keep apart; by_length: rows of b in the order of length.

    An edit changes one letter, so texts in reach have most letters in common.  As it is
    in one place, the letters that the first p and the last q of both don't have in common
    count together, where p + q is at most the shorter length; see CUTS.
    """
    length, lengths, waiting, size = b.length[by_length], a.length[rows], [], 0
    buffers = [np.empty(max(DENSE, len(by_length)), k) for k in (np.uint64, np.uint8, np.uint8, bool, bool)]
    group = np.lexsort((lengths, shares))
    new = np.r_[True, (np.diff(lengths[group]) != 0) | (np.diff(shares[group]) != 0)] if len(group) else np.zeros(0, bool)
    for places in np.split(group, np.flatnonzero(new)[1:]):
        n, share = int(lengths[places[0]]), float(shares[places[0]])
        most = allowed(share, np.maximum(length, n))
        near = np.flatnonzero(np.abs(length - n) <= most)
        if not len(near):
            continue
        low, high = int(near[0]), int(near[-1]) + 1  # the others between them only cost time
        ends = [low, *np.searchsorted(length[low:high], range(max(0, n - 60), n + 1, LENGTHS) if n % LENGTHS == 0 else [*range(max(0, n - 60), n, LENGTHS), n]) + low, high]
        for first, last in zip(ends, ends[1:], strict=False):
            if first >= last:
                continue
            theirs, room = by_length[first:last], most[first:last]
            shorter, filters = min(n, int(length[first])), [(a.marks[:, rows[places]], b.marks[:, theirs])]
            for at in CUTS:
                p = int(shorter * at)
                cut = (min(p, WORD), min(shorter - p, WORD))
                filters.append([np.stack([t.part(k, end)[own] for k, end in zip(cut, (False, True), strict=True)]) for t, own in ((a, rows[places]), (b, theirs))])
            # as bytes: nothing is kept apart by more than FULL, which with as much room stays below 256
            room = np.minimum(room, FULL).astype(np.uint8)
            counts = [[np.minimum(np.bitwise_count(w).sum(axis=0, dtype=np.int64), FULL).astype(np.uint8) for w in f] for f in filters]
            for i in range(0, len(places), step := max(1, DENSE // len(theirs))):
                some = slice(i, i + step)
                x, y = np.divmod(np.flatnonzero(_enough(filters, counts, some, room, buffers)), len(theirs))
                waiting.append((places[some][x], theirs[y]))
                size += len(x)
                if size >= COLUMNS:
                    yield tuple(np.concatenate(k) for k in zip(*waiting, strict=True))
                    waiting, size = [], 0
    if size:
        yield tuple(np.concatenate(k) for k in zip(*waiting, strict=True))


def _enough(filters: list, counts: list, some: slice, room: np.ndarray, buffers: list[np.ndarray]) -> np.ndarray:
    """Have the rows `some` of the left and all of the right all bits of either in common, but as many as there is room for, by each filter?"""
    kept, size = None, (len(counts[0][0][some]), len(room))
    both, common, more, now, first = (x[: size[0] * size[1]].reshape(size) for x in buffers)
    for (mine, theirs), (own, other) in zip(filters, counts, strict=True):
        np.bitwise_count(np.bitwise_and(mine[0, some, None], theirs[0], out=both), out=common)
        common += np.bitwise_count(np.bitwise_and(mine[1, some, None], theirs[1], out=both), out=more)
        np.minimum(common, FULL, out=common)
        common += room
        out = first if kept is None else now
        np.greater_equal(common, np.maximum(other, own[some, None], out=more), out=out)
        kept = out if kept is None else np.logical_and(kept, out, out=kept)
    return kept


def near(left: list[str], right: list[str], shares: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of left, row of right, distance) of the pairs whose distance is at most the left row's share of the longer length."""
    a, b = Texts(left), Texts(right)
    by_length = np.argsort(b.length, kind="stable")
    short = np.flatnonzero((a.length > 0) & (a.length <= WORD))
    alphabet = np.unique(a.flat)
    letters = np.searchsorted(alphabet, b.flat)
    letters[np.r_[alphabet, -1][letters] != b.flat] = len(alphabet)
    size, halves = max(1, MASKS // (len(alphabet) + 1)), [short[a.length[short] <= 32], short[a.length[short] > 32]]
    for rows in [x for half in halves if len(half) for x in np.split(half, range(size, len(half), size))]:
        table = masks(a.flat, a.start[rows], a.length[rows], alphabet)
        length = a.length[rows]
        for i, j in _likely(a, rows, b, shares[rows], by_length):
            for k in range(0, len(i), COLUMNS):
                x, y = i[k : k + COLUMNS], j[k : k + COLUMNS]
                d = columns(table, x, length[x], letters, b.start[y], b.length[y])
                yield _kept(rows[x], y, d, length[x], b.length[y], shares[rows[x]])
    rest = np.flatnonzero((a.length == 0) | (a.length > WORD))
    for i, j in _likely(a, rest, b, shares[rest], by_length) if len(rest) else ():
        d = np.fromiter((long_distance(left[x], right[y]) for x, y in zip(rest[i], j, strict=True)), np.int64, len(i))
        yield _kept(rest[i], j, d, a.length[rest[i]], b.length[j], shares[rest[i]])


def _kept(i: np.ndarray, j: np.ndarray, d: np.ndarray, la: np.ndarray, lb: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    close = d <= np.floor(shares * np.maximum(la, lb) + 1e-6)
    return i[close], j[close], d[close]


class Distances:
    """Distances of pairs of rows of two Texts, asked for in parts."""

    def __init__(self, a: Texts, b: Texts):
        self.a, self.b, self.alphabet = a, b, np.unique(a.flat)
        self.letters = np.searchsorted(self.alphabet, b.flat)
        self.letters[np.r_[self.alphabet, -1][self.letters] != b.flat] = len(self.alphabet)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b, la = self.a, self.b, self.a.length[i]
        out, size = np.zeros(len(i), np.int64), max(1, MASKS // (len(self.alphabet) + 1))
        for low, high in ((0, 32), (32, WORD)):
            some = np.flatnonzero((la > low) & (la <= high))
            some = some[np.argsort(i[some], kind="stable")]
            rows, first = np.unique(i[some], return_index=True)
            for k in range(0, len(rows), size):
                own, mine = rows[k : k + size], some[first[k] : first[k + size] if k + size < len(rows) else len(some)]
                table = masks(a.flat, a.start[own], a.length[own], self.alphabet)
                for c in range(0, len(mine), COLUMNS):
                    m = mine[c : c + COLUMNS]
                    out[m] = columns(table, np.searchsorted(own, i[m]), la[m], self.letters, b.start[j[m]], b.length[j[m]])
        for m in np.flatnonzero((la == 0) | (la > WORD)):
            out[m] = long_distance(a.texts[i[m]], b.texts[j[m]])
        return out


class Values:
    """Distinct values of a field, and which of them each record has: text, mark of its exact form, weight (0: empty), and what two such values may add to a score."""

    def __init__(self, texts: list[str], marks: list[int], weights: list[float], ups: list[float]):
        places: dict[tuple, int] = {}
        self.row = np.fromiter((places.setdefault(v, len(places)) for v in zip(texts, marks, weights, ups, strict=True)), np.int64, len(texts))
        each = list(zip(*places, strict=True)) or [()] * 4
        self.texts, self.mark = Texts(list(each[0])), np.array(each[1], np.int64)
        self.weight, self.up = (np.array(x, np.float32) for x in each[2:])
        # in few bytes, as they are read for every pair; lengths above 30,000 differ by less then, which keeps more pairs
        self.size, self.short = np.maximum(self.texts.length, 1).astype(np.float32), np.minimum(self.texts.length, 30_000).astype(np.int16)

    def __len__(self) -> int:
        return len(self.mark)

    def top(self, other: Values, i: np.ndarray, j: np.ndarray, edits: np.ndarray, loss: float) -> tuple[np.ndarray, np.ndarray]:
        """What values i of these and j of the other can score at most at so many edits, and their weight; i and j as numpy broadcasts them."""
        score = np.float32(-100 * loss) / np.maximum(self.size[i], other.size[j])
        score *= edits.astype(np.float32)
        score += 100
        if self.up.any() and other.up.any():
            score = score + np.minimum(self.up[i], other.up[j])
        return np.where(self.mark[i] == other.mark[j], np.float32(100), score), np.minimum(self.weight[i], other.weight[j])

    def fewest(self, other: Values, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edits between values i of these and j of the other at least, by letters and lengths."""
        a, b = self.texts, other.texts
        common = np.bitwise_count(a.marks[0][i] & b.marks[0][j]) + np.bitwise_count(a.marks[1][i] & b.marks[1][j])
        return np.maximum(np.maximum(a.letters[i], b.letters[j]) - common, np.abs(self.short[i] - other.short[j]))


#: Pairs of records whose bounds are worked out together: their arrays fit a cache.
STRIP = 1 << 16


def reaching(left: list[Values], right: list[Values], loss: float, least: float, boost: float, matched: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of left, row of right) of the records whose confidence can reach least, by the distances of their fields.

    A field gives 100 - 100 * loss * distance / longest length at most, 100 where marks
    are equal; the confidence is their weighted mean and boost for each that gives
    matched or more.  Fields of few values are compared value by value, the others by
    their letters first, and by distances where those leave a pair.
    """
    n, m = len(left[0].row), len(right[0].row)
    asked = [Distances(x.texts, y.texts) for x, y in zip(left, right, strict=True)]
    few = []
    for x, y, d in zip(left, right, asked, strict=True):
        i, j = (k.reshape(-1) for k in np.indices((len(x), len(y)))) if len(x) * len(y) <= min(AT_ONCE, n * m // 4) else (None, None)
        few.append(None if i is None else tuple(v.reshape(len(x), len(y)) for v in x.top(y, i, j, d.of(i, j), loss)))

    def enough(scores: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total, weights, raised = np.float32(0), np.float32(0), np.float32(0)
        for top, w in scores:
            total, weights = total + np.maximum(top, 0) * w, weights + w
            raised = raised + ((top >= matched - 1e-3) & (w > 0)) * np.float32(boost)
        return (weights > 0) & (total >= (np.float32(least - 1e-3) - raised) * weights)

    def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = []
        for x, y, d, known in zip(left, right, asked, few, strict=True):
            u, v = x.row[i], y.row[j]
            scores.append(x.top(y, u, v, d.of(u, v), loss) if known is None else (known[0][u, v], known[1][u, v]))
        kept = enough(scores)
        return i[kept], j[kept]

    waiting, size = [], 0
    for start in range(0, n, step := max(1, STRIP // max(1, m))):
        scores = []
        for x, y, known in zip(left, right, few, strict=True):
            u = x.row[start : start + step]
            if known is None:
                i, j = u[:, None], y.row[None, :]
                scores.append(x.top(y, i, j, x.fewest(y, i, j), loss))
            else:
                scores.append(tuple(np.take(k[u], y.row, axis=1) for k in known))
        i, j = np.divmod(np.flatnonzero(enough(scores)), m)
        waiting.append((i + start, j))
        size += len(i)
        if size >= AT_ONCE:
            yield exact(*(np.concatenate(k) for k in zip(*waiting, strict=True)))
            waiting, size = [], 0
    if size:
        yield exact(*(np.concatenate(k) for k in zip(*waiting, strict=True)))
