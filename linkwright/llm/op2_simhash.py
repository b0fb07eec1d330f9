"""SimHash near duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits: the majority, bit by bit, of the XXH64
hashes of its word shingles.  Fingerprints at most four bits apart are linked.

Search.  A fingerprint is cut into segments of 23, 23 and 18 bits (the last one
padded).  The binary Golay code of length 23 is perfect, so every segment lies
within three bits of just one codeword.  K(s) is that codeword and, where it is
three bits away, the five that are four bits away.  Two segments up to two bits
apart share a codeword of K: the codeword nearest to a word halfway between
them is within four bits of both.  Four errors in three segments leave either
a segment without errors, and then one of the others has two at most, or two
segments with one error each.  The keys follow these cases: (exact segment,
K of another) for the six ordered pairs, and for the three pairs
(K of one, nearest codeword of the other) both ways round, since a segment one
bit away has the nearest codeword of this one in its K.

Equal fingerprints are merged before the search.  Rows are shuffled and sorted
by key, into as many parts as their number asks for; in a key's rows the true
links (checked on all 64 bits) are found by numpy and only a spanning forest of
them is emitted, so a group of copies of any size gives fewer edges than it has
rows.  A key with more than HOT fingerprints is cut into blocks, and every two
blocks of it are compared in a row of their own, so no key lands in one task.

Cost: about 64 keys for a distinct fingerprint, in proportion to the input.
Random fingerprints meet by chance in 1 of 2**24 keys, so the comparisons (a few
instructions each) grow with the square of the distinct fingerprints at that rate.

Defined results.  A null or blank text has fingerprint zero and is linked like
any other.  A null doc_id gets its fingerprint but neither names nor loses a
component: component_id is the smallest id of the others, or null.  Equal
doc_ids are one node for each fingerprint; repeated rows get equal results.
Extra columns are ignored, whatever their names.  An empty table has no rows.
A very long text is read whole, in pieces, with its lower-case
copy beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import components
from .shared import forget, shuffle_partitions, stored

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14
#: A key's rows up to which all pairs are compared in one step.
SMALL = 8
#: Fingerprints of one key that a task compares by itself; more are cut into blocks of so many.
HOT = 1 << 13
#: Key rows for a task, and links a task remembers to leave out those that follow from others.
TASK_ROWS, PARENTS = 1 << 22, 1 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    ones, n, words, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest

    def add(words: list[bytes], size: int) -> int:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        count = len(words) - size + 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:count]
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
        for at in range(0, count, BLOCK):
            ones[:] += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return count

    for more in tb.word_lists((text or b"").lower()):  # of bytes: A-Z only
        words += more
        if len(words) >= shingle:
            n += add(words, shingle)
            words = words[len(words) - shingle + 1 :]
    if not n and words:
        n = add(words, len(words))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as a long, and text_key (XXH64 of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
            fps = pa.array([fingerprint(x) for x in texts], pa.int64())
            text_keys = np.array([xxhash.xxh64_intdigest(x, SEED) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), fps, pa.array(text_keys)], names=["doc_id", "fp", "text_key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tb.tidy(run), "doc_id long, fp long, text_key long")


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high bits of a word, error patterns by syndrome, and for each
    syndrome the five codewords that lead from the nearest codeword to those four bits away."""
    generator = 0b110001110101  # x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1
    words = np.arange(1 << 23, dtype=np.uint32)
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (generator << (bit - 11)), words).astype(np.uint32)
    low, high = words[: 1 << 12].copy(), words[np.arange(1 << 11) << 12].copy()
    weight = np.bitwise_count(np.arange(1 << 23, dtype=np.uint32))
    light = np.flatnonzero(weight <= 3).astype(np.uint32)
    errors = np.zeros(1 << 11, np.uint32)
    errors[words[light]] = light
    sevens = np.flatnonzero((words == 0) & (weight == 7)).astype(np.uint32)
    further = np.zeros((1 << 11, 5), np.uint32)
    for s in np.flatnonzero(np.bitwise_count(errors) == 3):
        further[s] = sevens[(sevens & errors[s]) == errors[s]]
    return np.stack([low[: 1 << 11], low[1 << 11 : 1 << 12], high]), errors, further


def near_codewords(seg: np.ndarray) -> np.ndarray:
    """Indices (n, 6) of the codewords K of each 23-bit segment; the nearest one first, repeated in place of missing ones."""
    parts, errors, further = golay()
    low = np.concatenate([parts[0], parts[1]])
    syndrome = low[seg & 0xFFF] ^ parts[2][seg >> 12]
    nearest = seg ^ errors[syndrome]
    return np.concatenate([nearest[:, None], nearest[:, None] ^ further[syndrome]], axis=1) >> 11


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in fp and the keys of each fingerprint, without repeats."""
    u = fp.view(np.uint64)
    segs = [(u & np.uint64(0x7FFFFF)).astype(np.uint32), (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.uint32), (u >> np.uint64(46)).astype(np.uint32)]
    near = [near_codewords(s).astype(np.int64) for s in segs]
    everyone = np.arange(len(u))
    #: The rows for which the k-th codeword isn't the nearest one again.
    fresh = [[everyone] + [np.flatnonzero(x[:, k] != x[:, 0]) for k in range(1, 6)] for x in near]
    at, out = [], []

    def add(kind: int, rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        at.append(rows)
        out.append(kind << 44 | first[rows] << 12 | second[rows])

    for i in range(3):
        for j in range(3):
            for k in range(6):
                if i != j:  # no error in i, two at most in j
                    add(3 * i + j, fresh[j][k], segs[i].astype(np.int64), near[j][:, k])
                if i < j:  # an error in either
                    add(16 + 3 * i + j, fresh[i][k], near[i][:, k], near[j][:, 0])
                    if k:
                        add(16 + 3 * i + j, fresh[j][k], near[i][:, 0], near[j][:, k])
    return np.concatenate(at), np.concatenate(out)


def _links(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among one key's distinct fingerprints."""
    left, out = fp, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count(left ^ x) <= max_bits
            if close.any():
                found = left[close]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~close]
    return out


class Forest:
    """Leaves out links that follow from earlier ones, as far as it remembers them."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (y := parent.get(x, x)) != x:
            parent[x] = parent.get(y, y)
            x = y
        return x

    def new(self, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if len(self.parent) > PARENTS:
            self.parent.clear()
        kept = []
        for a, b in found:
            if (x := self.root(a)) != (y := self.root(b)):
                self.parent[x] = y
                kept.append((a, b))
        return kept


def _edges(pairs: list[tuple[int, int]]) -> list[pa.Array]:
    both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def meet(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each key of rows (key, fp) in the order of the keys.

    A key with more than HOT rows comes out as blocks of rows instead, however
    many there are: a task holds HOT rows of a key and a batch at most.
    """
    names, forest = ["a", "b", "key", "part", "block"], Forest()

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(edge)
        found: list[tuple[int, int]] = []
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, SMALL):
            same = np.flatnonzero(small[:-d] & (key[d:] == key[:-d])) if d < len(key) else []
            if not len(same):
                break
            same = same[np.bitwise_count(fp[same] ^ fp[same + d]) <= max_bits]
            found += zip(fp[same].tolist(), fp[same + d].tolist(), strict=True)
        for k in np.flatnonzero(sizes > SMALL):
            found += _links(fp[edge[k] : edge[k + 1]], max_bits)
        a, b = _edges(forest.new(found))
        none = pa.nulls(len(a))
        return pa.RecordBatch.from_arrays([a, b, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)

    def block(key: int, part: int, fp: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([key], pa.int64()), pa.array([part], pa.int32()), pa.array([fp.tobytes()], pa.binary())], names=names)

    open_key, parts, left = None, 0, np.zeros(0, np.uint64)  # the last key, its blocks so far, and its rows after them
    for batch in batches:
        key, fp = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(key):
            continue
        if open_key is not None:
            n = int(np.searchsorted(key, open_key, "right"))
            left, key, fp = np.concatenate([left, fp[:n]]), key[n:], fp[n:]
            if len(key) and parts:
                yield block(open_key, parts, left)
                parts, left = 0, left[:0]
            elif len(key):
                key, fp = np.concatenate([np.full(len(left), open_key), key]), np.concatenate([left, fp])
        if len(key):
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if whole > 1:
                yield linked(key[:whole], fp[:whole])
            open_key, parts, left = int(key[-1]), 0, fp[whole:]
        while len(left) > HOT:
            yield block(open_key, parts, left[:HOT])
            parts, left = parts + 1, left[HOT:]
    if parts:
        yield block(open_key, parts, left)
    elif len(left) > 1:
        yield linked(np.full(len(left), open_key), left)


def across(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of one key (columns x and y), or within one where they are the same."""
    for batch in batches:
        for same, x, y in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if same:
                found = _links(u, max_bits)
            else:
                found, forest = [], Forest()
                for one in u:
                    found += forest.new([(int(one), int(z)) for z in v[np.bitwise_count(v ^ one) <= max_bits]])
            yield pa.RecordBatch.from_arrays(_edges(found), names=["a", "b"])


def links(groups: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp of a stored table) that connect all that are linked."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                fp = batch.column(0).slice(at, 1 << 12).to_numpy(zero_copy_only=False)
                rows, key = keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows])], names=["key", "fp"])

    tasks = max(shuffle_partitions(groups.sparkSession), -(-64 * groups.count() // TASK_ROWS))
    # a fingerprint makes 64 rows: dealt out first, so that no task makes those of a whole large file
    made = groups.select("fp").repartition(tasks).mapInArrow(tb.tidy(make), "key long, fp long").repartition(tasks, "key").sortWithinPartitions("key")
    met = stored(made.mapInArrow(tb.tidy(lambda rows: meet(rows, max_bits)), "a long, b long, key long, part int, block binary"), "met")
    blocks = met.where("block IS NOT NULL").select("key", "part", "block")
    x, y = blocks.toDF("key", "p", "x"), blocks.toDF("key", "q", "y")
    # the numbers of the blocks are paired and dealt out first, then the blocks are brought to them
    numbers = x.drop("x").join(y.drop("y"), "key").where("p <= q").repartition(tasks, "key", "p", "q")
    pairs = numbers.join(x, ["key", "p"]).join(y, ["key", "q"]).select((F.col("p") == F.col("q")).alias("same"), "x", "y")
    return met.where("block IS NULL").select("a", "b").unionByName(pairs.mapInArrow(tb.tidy(lambda rows: across(rows, max_bits)), "a long, b long"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_key, fp (long), fingerprint (hex) and component_id of every document."""
    fps = stored(fingerprints(docs), "fingerprints")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    edges = links(groups, max_bits)
    # nodes are fingerprints; labels become the smallest doc_id among a component's fingerprints
    label = components(edges)
    named = label.join(groups, label.node == groups.fp)
    best = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    moved = named.select("fp", "label").join(best, "label").select("fp", "component_id")
    # stored, so that both sides of the last join are plain shuffles and a part with many copies can be split
    own = stored(groups.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "named")
    for done in (label, groups, edges):
        forget(done)
    return fps.join(own, "fp", "left").select("doc_id", "text_key", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay when one of each component does: the row with the smallest doc_id.

    Rows without a doc_id count as greater than all others; among rows of one
    doc_id and fingerprint the least text hash stays, of equal rows one.  A null
    text stays unless an earlier document has no words either.
    """
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("doc_id"), "text")
    near = near_duplicates(rows, max_bits).where("doc_id = component_id")
    chosen = near.groupBy("doc_id", "fp").agg(F.min("text_key").alias("key")).select(F.col("doc_id").alias("id"), "key").distinct()
    whole = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.struct(*whole).alias("row"), F.xxhash64(*[c.cast("string") for c in whole]).alias("rank"))
    kept = keyed.join(chosen, ["id", "key"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id", "key").orderBy("rank"))).where("n = 1")
    return kept.select("row.*")
