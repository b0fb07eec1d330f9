"""Phrase mining by PCY/DHP: candidates are pruned by hashed bucket counts and by Apriori before exact counting.

Texts are cut into pieces and words; a phrase is a run of words of one piece, and
everything is counted per language.  Level k counts phrases of k words exactly, and
in the same pass the phrases of k + 1 words in hashed buckets:

1. Every task gathers chunks of words.  Phrases of k words that pass the pruning are
   counted in the chunk by hash and leave it as (lang, phrase, count); buckets leave
   as packed numbers and counts by bucket range.
2. Counts are summed by phrase, those below the least dropped; bucket counts are
   summed by range, and each range gives a piece of a bitmap: buckets that reach the
   least count.
3. At the next level a phrase is counted only if its bucket is set (PCY) and both its
   parts without one end word are frequent (Apriori); it is counted into the buckets
   of the level after only if both its parts pass, too (DHP).  Frequent phrases are
   known by a second bitmap of hashes.

Only the two bitmaps, of at most 2**MOST bits each, pass through the driver and are
sent to all tasks; both only ever let too much through, so counts are exact whatever
their size.  The words' own level is counted without pruning.  A phrase is compared
by its 64-bit hash within a chunk, and by its text beyond.

Scores are joins of candidates with the counts of their parts, in decimals of 38
digits.  A candidate inside a longer one of the same count goes: it is enough to look
at candidates one word longer, as the counts between lie between.  The best of each
language are taken in two steps, so no task sorts all candidates of a language.

Defined results.  A null text has no words.  A null language is `und`, one with it
where that is a value.  doc_id isn't read, so null ones and repeated rows count as
they come.  Ties are broken as the order says, down to the phrase itself.  Extra
columns aren't read.  An empty table has no phrases.  A very long text is cut behind
a separator of pieces; a piece is read whole, at about a hundred bytes for each of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import forget, input_bytes, scratch, shuffle_partitions, small_batches, stored

#: Fixed values of the method's parameters.
LEAST, LONGEST, TOP = 100, 5, 2000
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Words of a chunk.
CHUNK = 1 << 21
#: Bits of a bitmap, as powers of two: least, most; and of the part of it that one range holds.
FEWEST, MOST, PART = 20, 27, 16
#: Input bytes (as stored) for a bucket; frequent phrases have so many bits each.
BUCKET_BYTES, SPARSE = 32, 32
UND = "und"

_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_GAP, _JOINT = tb.table((0x20, 0x20), (0x09, 0x09)), tb.table(*[(c, c) for c in BREAKS])
_ROWS = "lang string, phrase string, n long, part int, data binary"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
_NAMES = ["lang", "phrase", "n", "part", "data"]


class Bits:
    """A bitmap of 2**size bits that is asked by the top bits of hashes."""

    def __init__(self, size: int, data: bytes):
        self.size, self.data = size, np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.size)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS, strict=True)], names=_NAMES)


def phrase_hashes(words: np.ndarray, lang: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of size words from each of the words begin on; lang: a number for each of them."""
    out = lang.copy()
    for k in range(size):
        out = tb.mix64(out * np.uint64(tb.WORD_BASE) + words[begin + k] + np.uint64(k + 1))
    return out


def lang_hash(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 11)


def pieces_of(data: bytes) -> Iterator[bytes]:
    """A text in parts of about PIECE bytes that end behind a separator of pieces."""
    at = 0
    while at < len(data):
        end = _BREAK.search(data, at + tb.PIECE)
        to = end.end() if end else len(data)
        yield data[at:to]
        at = to


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes in lower case, offsets and languages of rows (or of parts of a long row)."""
    for part in tb.slices(batches):
        langs = [x if x is not None else UND for x in part.column(1).to_pylist()]
        buf, offsets = tb.text_bytes(part.column(0))
        buf = tb.lower_ascii(buf)
        if len(langs) > 1 or len(buf) <= 2 * tb.PIECE:
            yield buf, offsets, langs
        else:
            for x in pieces_of(buf.tobytes()):
                yield np.frombuffer(x, np.uint8), np.array([0, len(x)]), langs


class Counter:
    """A chunk: hashes and places of phrases, and buckets of longer ones."""

    def __init__(self, level: int, size: int, bucket: Bits | None, frequent: Bits | None):
        self.level, self.size, self.bucket, self.frequent = level, size, bucket, frequent
        self.clear()

    def clear(self) -> None:
        self.n, self.n_rows, self.texts, self.places, self.hashes, self.buckets = 0, 0, [], [], [], []
        self.langs: dict[str, int] = {}

    def passing(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which phrases of this level are counted; ends: hashes of both their parts."""
        ok = self.frequent.has(ends[0]) & self.frequent.has(ends[1])
        return ok & self.bucket.has(h) if self.bucket is not None else ok

    def add(self, buf: np.ndarray, offsets: np.ndarray, langs: list[str]) -> None:
        w = tb.Words(buf, offsets, ~(_GAP | _JOINT))
        self.n += len(w) + 1
        for lang, n in zip(langs, w.counts.tolist(), strict=True):
            self.langs[lang] = self.langs.get(lang, 0) + n
        if not len(w):
            return
        joints = np.r_[0, np.cumsum(tb.look(_JOINT, buf), dtype=np.int32)]
        before, row = joints[w.starts], w.rows()
        piece = np.cumsum(np.r_[True, (before[1:] != before[:-1]) | (row[1:] != row[:-1])])
        hashes, lang = w.hashes(), np.array([lang_hash(x) for x in langs], np.uint64)[row]
        run = lambda size: np.flatnonzero(piece[: len(w) - size + 1] == piece[size - 1 :]) if len(w) >= size else np.zeros(0, np.int64)
        k, begin = self.level, run(self.level)
        h = phrase_hashes(hashes, lang[begin], begin, k)
        counted = np.zeros(len(w) + 1, bool)
        if k == 1:
            counted[begin] = True
        else:
            parts = [phrase_hashes(hashes, lang[b], b, k - 1) for b in (begin, begin + 1)]
            ok = self.passing(h, parts)
            begin, h = begin[ok], h[ok]
            counted[begin] = True
        if len(begin):
            self.places.append(np.stack([np.full(len(begin), len(self.texts)), w.starts[begin], w.ends[begin + k - 1], row[begin]]).astype(np.int32))
            self.hashes.append(h)
            self.texts.append((buf.tobytes(), langs))
        if k < LONGEST:
            longer = run(k + 1)
            longer = longer[counted[longer] & counted[longer + 1]]
            self.buckets.append((phrase_hashes(hashes, lang[longer], longer, k + 1) >> np.uint64(64 - self.size)).astype(np.uint32))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What the chunk sends: words by language (no phrase), phrases, buckets by range."""
        if self.langs and self.level == 1:
            yield _batch([list(self.langs), [None] * len(self.langs), list(self.langs.values()), [None] * len(self.langs), [None] * len(self.langs)])
        if self.hashes:
            _, first, n = np.unique(np.concatenate(self.hashes), return_index=True, return_counts=True)
            places = np.concatenate(self.places, axis=1)[:, first]
            for at in range(0, len(first), 1 << 14):
                langs, phrases = [], []
                for t, a, b, row in places[:, at : at + (1 << 14)].T.tolist():
                    text, of = self.texts[t]
                    phrases.append(b" ".join(text[a:b].split()).decode())
                    langs.append(of[row])
                yield _batch([langs, phrases, n[at : at + (1 << 14)], [None] * len(langs), [None] * len(langs)])
        if self.buckets:
            at, n = np.unique(np.concatenate(self.buckets), return_counts=True)
            part = at >> np.uint32(PART)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(at) else np.zeros(1, np.int64)
            for lo in range(0, len(cuts) - 1, 64):
                each = list(zip(cuts[lo : lo + 64].tolist(), cuts[lo + 1 : lo + 65].tolist(), strict=False))
                yield _batch([[None] * len(each), [None] * len(each), [None] * len(each), [int(part[a]) for a, _ in each], [packed(at[a:b], n[a:b]) for a, b in each]])


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted places within a part, and their counts (those above 2**16 - 1 in several rounds)."""
    low, rest, parts = (at & np.uint32((1 << PART) - 1)).astype(np.uint16), n.astype(np.int64), []
    while len(low):
        now = np.minimum(rest, 65535).astype(np.uint16)
        parts.append(len(low).to_bytes(4, "little") + low.tobytes() + now.tobytes())
        low, rest = low[rest > 65535], rest[rest > 65535] - 65535
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes, into: np.ndarray) -> None:
    """Add packed counts."""
    raw, at = zstandard.ZstdDecompressor().decompress(data), 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        low, more = (np.frombuffer(raw, np.uint16, n, at + 4 + 2 * n * k) for k in (0, 1))
        into[low] += more
        at += 4 + 4 * n


def counts_of(texts: DataFrame, level: int, size: int, bucket: Bits | None, frequent: Bits | None) -> DataFrame:
    """The chunks' rows of a level."""
    context = texts.sparkSession.sparkContext
    sent = [context.broadcast((x.size, x.data.tobytes())) if x is not None else None for x in (bucket, frequent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Counter(level, size, *[Bits(*x.value) if x is not None else None for x in sent])
        for part in slices(batches):
            chunk.add(*part)
            if chunk.n >= CHUNK:
                yield from chunk.rows()
                chunk.clear()
        yield from chunk.rows()

    return texts.mapInArrow(tb.tidy(run), _ROWS)


def _parts(rows: DataFrame, data: str, size: int, make) -> Bits:
    """A bitmap put together of ranges: make(range's rows of data) gives its 2**PART booleans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for part, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if held is not None:
                        done.append((now, np.packbits(held >= LEAST if make is unpacked else held > 0, bitorder="little").tobytes()))
                    now, held = part, np.zeros(1 << PART, np.int64)
                make(x, held)
        if held is not None:
            done.append((now, np.packbits(held >= LEAST if make is unpacked else held > 0, bitorder="little").tobytes()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())], names=["part", "bits"])

    spread = rows.select("part", data).repartition(shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part")
    found = spread.mapInArrow(tb.tidy(run), "part int, bits binary").collect()  # 2**size bits at most
    out = bytearray((1 << size) // 8)
    for r in found:
        at = r["part"] << PART - 3
        out[at : at + len(r["bits"])] = r["bits"]
    return Bits(size, bytes(out))


def bucket_bits(rows: DataFrame, size: int) -> Bits:
    """Buckets that are counted LEAST times or more."""
    return _parts(rows.where("part IS NOT NULL"), "data", size, unpacked)


def _set(data: bytes, into: np.ndarray) -> None:
    into[np.frombuffer(data, np.uint16)] = 1


def frequent_bits(frequent: DataFrame, level: int) -> Bits:
    """The hashes of frequent phrases of a level."""
    n = frequent.count()
    size = min(MOST, max(FEWEST, (SPARSE * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = tb.Words(*tb.text_bytes(batch.column(1)), ~_GAP)
            lang = np.array([lang_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            at = np.sort(phrase_hashes(w.hashes(), lang, w.first[:-1], level) >> np.uint64(64 - size)).astype(np.uint32)
            part = at >> np.uint32(PART)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            low = (at & np.uint32((1 << PART) - 1)).astype(np.uint16)
            each = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in each], pa.int32()), pa.array([low[a:b].tobytes() for a, b in each], pa.binary())], names=["part", "data"])

    rows = frequent.select("lang", "phrase").mapInArrow(tb.tidy(run), "part int, data binary")
    return _parts(rows, "data", size, _set)


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, n) words of each language, and (lang, size, phrase, f) of all phrases counted LEAST times or more."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("text", "lang")
    size = min(MOST, max(FEWEST, (input_bytes(texts) // BUCKET_BYTES).bit_length()))
    bucket, frequent, levels, words = None, None, [], None
    for level in range(1, LONGEST + 1):
        rows = stored(counts_of(texts, level, size, bucket, frequent), "counts")
        summed = rows.where("part IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if level == 1:
            words = stored(summed.where("phrase IS NULL").select("lang", F.col("f").alias("n")), "words")
        found = stored(summed.where(f"phrase IS NOT NULL AND f >= {LEAST}").select("lang", F.lit(level).alias("size"), "phrase", "f"), "frequent")
        levels.append(found)
        if level < LONGEST:
            bucket, frequent = bucket_bits(rows, size), frequent_bits(found, level)
        forget(rows)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return words, out


def scored(words: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one replaces."""
    candidates = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(words, "lang")
    score = F.expr("cast(cast(1000 AS decimal(4,0)) * cast(a AS decimal(16,0)) * cast(n AS decimal(18,0)) AS decimal(38,0)) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    lowest = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    inside = candidates.where("size > 2").select("lang", "a", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * best.a")
    return kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first of each language by score, count and phrase, with their rank: first within parts, then of what they leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(8, shuffle_partitions(rows.sparkSession))
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    some = ranked(rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))), "lang", "part")
    return ranked(some.drop("rank", "part"), "lang").withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    spark: SparkSession = docs.sparkSession
    with scratch(spark):
        words, counts = frequent_phrases(docs)
        out = stored(best(scored(words, counts), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases", keep=True)
    return out
