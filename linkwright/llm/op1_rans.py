"""Token ids in a binary file format: static range asymmetric numeral system (rANS).

encode_documents() tokenizes whole texts in doc_id order and writes blocks of
about BLOCK tokens; read_documents() reads them back.  One frequency table,
counted over the whole corpus and scaled to 2**SCALE, serves all blocks, which
are otherwise independent.  In a block token i belongs to lane i mod LANES; all
lanes advance together as one numpy vector with 64-bit states that spill 32-bit
words into one stream.  Every CHECKPOINT steps the block records all states and
the place in the stream, so segments decode side by side; a CRC-32 covers the
block's bytes, another one its decoded ids.

A file is a Parquet part written by Spark (so that a lost or repeated task
leaves no half-written file, in any store) whose rows are the binary blocks.

The place of a file's first id among all ids comes from sums by file and by GROUP
files; only tables of that size are joined, none is collected.

Defined results.  A null text is empty and yields the end id alone.  Null
doc_ids come first; rows with equal doc_ids are ordered by their text's hash,
repeated rows are encoded one by one.  Extra columns are ignored, whatever their
names.  An empty table gives an empty file set.  A very long text is encoded in
pieces cut at white space and makes one document of one block, as long as it is.
More than 2**SCALE different ids raise an error, as does a damaged block.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbatch as tb
from .op7_substrings import delta, pack, unpack
from .shared import forget, input_bytes, shared_dir, stored

SCALE, LANES, CHECKPOINT, BLOCK = 20, 2048, 128, 1 << 18
#: Stored bytes of input for a file; words that a worker remembers, and their greatest length.
FILE_BYTES, CACHE, LONG = 16 << 20, 500_000, 64
#: Blocks in a file of the intermediate table.
RAW = 8
#: Files whose ids are added up together, and files whose places are sent to all executors.
GROUP, FEW = 4096, 1 << 16
_MAGIC, _LOW = b"RANS0001", np.uint64(1 << 31)
_HEAD = struct.Struct("<8sIIQQIIIQQ")  # magic, crc of the rest, crc of the table, tokens, documents, lanes, checkpoint steps, crc of ids, words, index bytes


# ---- tokens

#: Latin letters, whose lower case and NFC form are plain, and then signs other than letters and apostrophes.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-@\[-`{-~]*)")
_ODD, _BLANK = "\x1c\x1d\x1e\x1f", re.compile(r"\s")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(other)) for b in range(256)]


def _latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens(dict):
    """word -> its ids as little-endian bytes, for a tokenizer that drops white space and never looks across it.

    Every id comes from the tokenizers library.  Its pre-tokenizer cuts between
    letters and other characters, so a word of Latin letters with trailing signs
    is two pre-tokens: the lower-cased letters go straight to the library's BPE
    model, the signs and all other words through the whole tokenizer.  Words are
    encoded when they are first looked up; long ones aren't remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, dict(enumerate(byte_letters()))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def core(self, word: str) -> bytes:
        """Ids of one pre-token of lower-case Latin letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        code = self.code
        return b"".join([code[t.id] for t in self.model.tokenize(word)])

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONG:
            return self.ids(word)
        if len(self) > CACHE:
            self.clear()
        match = None if word.isascii() and word.isalpha() else _PLAIN.fullmatch(word)
        if match is not None and match[2]:
            code = self[match[1].lower()] + self[match[2]]
        elif match is not None or (word.isascii() and word.isalpha()):
            low = word.lower()
            code = self.core(word) if low == word else self[low]
        else:
            code = self.ids(word)
        self[word] = code
        return code

    def encode(self, text: str) -> bytes:
        """Ids of a text; a very long one goes by pieces cut at white space."""
        # str.split() takes four control characters for white space that the tokenizer doesn't
        if any(c in text for c in _ODD):
            return self.ids(text)
        if text.isascii() or _latin(text):
            text = text.lower()  # as the tokenizer does with such letters; fewer words to remember
        if len(text) <= tb.PIECE:
            return b"".join(map(self.__getitem__, text.split()))
        out, at = [], 0
        while at < len(text):
            blank = _BLANK.search(text, at + tb.PIECE)
            to = blank.start() if blank else len(text)
            out.append(b"".join(map(self.__getitem__, text[at:to].split())))
            at = to + 1
        return b"".join(out)


def _tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of raw ids in doc_id order: file, first token in its file, packed documents."""
    # as many as the size asks for; the order of doc_ids, and of hashes where one has many rows, decides which file a row is in
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(docs) // FILE_BYTES))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id", key).sortWithinPartitions("doc_id", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, cache = TaskContext.get().partitionId(), WordTokens(path)
        end, size = np.array([end_id], cache.kind).tobytes(), cache.kind.itemsize
        ids, known, codes, first, n = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            counts = np.array([len(x) // size for x in codes], np.int64)
            tokens = np.frombuffer(b"".join(codes), cache.kind)
            index = [pack(np.array(ids, np.int64)), pack(np.array(known, np.int64)), pack(counts)]
            names = ["file", "first", "n", "width", "ids", "known", "counts", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, first, len(tokens), size, *index, pack(tokens))], names=names)

        for part in tb.slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids.append(doc_id or 0)
                known.append(doc_id is not None)
                codes.append(cache.encode(text.as_py() or "") + end)
                n += len(codes[-1]) // size
                if n >= BLOCK:
                    yield block()
                    first, n, ids, known, codes = first + n, 0, [], [], []
        if codes:
            yield block()

    return rows.mapInArrow(tb.tidy(run), "file long, first long, n long, width long, ids binary, known binary, counts binary, tokens binary")


def _ids(width: int, data: bytes) -> np.ndarray:
    return unpack(data, np.uint16 if width == 2 else np.uint32)


def token_counts(raw: DataFrame) -> dict[int, int]:
    """How often each id occurs; as many entries as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.bincount(_ids(width, data))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    return dict(raw.select("width", "tokens").mapInArrow(tb.tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect())


# ---- rANS


class Frequencies:
    """Counts scaled to a sum of 2**SCALE, one at least for every id that occurs."""

    def __init__(self, counts: dict[int, int]):
        self.symbols = np.array(sorted(counts), np.int64)
        n = np.array([counts[x] for x in self.symbols.tolist()], np.float64)
        total = 1 << SCALE
        if len(n) > total:
            raise ValueError(f"{len(n)} different ids don't fit a table of 2**{SCALE}")
        f = np.maximum(1, np.floor(n * (total / max(1.0, n.sum())))).astype(np.int64)
        if len(f):
            spare = total - int(f.sum())
            order = np.argsort(-n, kind="stable")
            if spare >= 0:
                f[order[0]] += spare
            while spare < 0:  # rounding up rare ids took too much: take it from the frequent ones
                take = np.minimum(f[order] - 1, -(-(-spare) // 64))
                take = np.where(np.cumsum(take) <= -spare, take, np.maximum(0, -spare - (np.cumsum(take) - take)))
                f[order] -= take
                spare += int(take.sum())
        start = np.cumsum(f) - f
        size = int(self.symbols[-1]) + 1 if len(f) else 1
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[self.symbols], self.start[self.symbols] = f.astype(np.uint64), start.astype(np.uint64)
        self.slots = np.repeat(self.symbols, f).astype(np.uint32)
        self.crc = zlib.crc32(self.freq.tobytes())


def encode_block(tokens: np.ndarray, freq: Frequencies, index: bytes, documents: int, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    n = len(tokens)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    grid = np.zeros(steps * lanes, np.int64)
    grid[:n] = tokens
    grid = grid.reshape(steps, lanes)
    live = n - (steps - 1) * lanes  # lanes of the last step
    state, words, marks = np.full(lanes, _LOW, np.uint64), [], []
    written, scale = 0, np.uint64(SCALE)
    for t in range(steps - 1, -1, -1):
        width = live if t == steps - 1 else lanes
        symbol, x = grid[t, :width], state[:width]
        f = freq.freq[symbol]
        full = x >= f << np.uint64(63 - SCALE)
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        words.append(out)
        written += len(out)
        quotient = x // f
        state[:width] = (quotient << scale) + (x - quotient * f) + freq.start[symbol]
        if t % every == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    marks = marks[::-1]
    at = np.array([written - w for w, _ in marks], np.uint64)
    body = b"".join([index, at.tobytes(), *(s.tobytes() for _, s in marks), words.tobytes()])
    ids = zlib.crc32(tokens.astype("<u4").tobytes())
    rest = _HEAD.pack(_MAGIC, 0, freq.crc, n, documents, lanes, every, ids, len(words), len(index))[12:] + body
    return _MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def decode_block(block: bytes, freq: Frequencies) -> tuple[np.ndarray, bytes]:
    """The ids of a block and its index; all segments between checkpoints advance side by side."""
    magic, crc, table, n, _, lanes, every, ids_crc, n_words, index_bytes = _HEAD.unpack_from(block)
    if magic != _MAGIC or zlib.crc32(block[12:]) != crc or table != freq.crc:
        raise ValueError("damaged block, or one of another frequency table")
    at = _HEAD.size
    index = block[at : at + index_bytes]
    at += index_bytes
    steps = -(-n // lanes)
    segments = -(-steps // every)
    place = np.frombuffer(block, np.uint64, segments, at).astype(np.int64)
    at += 8 * segments
    state = np.frombuffer(block, np.uint64, segments * lanes, at).reshape(segments, lanes).copy()
    at += 8 * segments * lanes
    words = np.append(np.frombuffer(block, np.uint32, n_words, at), np.zeros(1, np.uint32))
    out = np.zeros((segments, every, lanes), np.uint32)
    live, mask, scale = n - (steps - 1) * lanes, np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for t in range(min(every, steps)):
        k = segments if (segments - 1) * every + t < steps else segments - 1
        x = state[:k]
        slot = x & mask
        symbol = freq.slots[slot.astype(np.int64)]
        out[:k, t] = symbol
        new = freq.freq[symbol] * (x >> scale) + slot - freq.start[symbol]
        if (k - 1) * every + t == steps - 1 and live < lanes:
            new[k - 1, live:] = x[k - 1, live:]
        low = new < _LOW
        rank = np.cumsum(low, axis=1)
        source = place[:k, None] + rank - 1
        new[low] = (new[low] << np.uint64(32)) | words[source[low]]
        place[:k] += rank[:, -1]
        state[:k] = new
    ids = out.reshape(segments * every, lanes)[:steps].ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids differ from its checksum")
    return ids, index


# ---- files


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, to: str | None = None) -> str:
    """Write the token files of docs (doc_id, text) and return their folder: blocks/ and table/."""
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    raw = stored(_tokenized(docs, tokenizer, end_id), "raw-tokens", rows=RAW)  # Spark's reader holds a file's rows at once
    counts = token_counts(raw)
    spark.createDataFrame(sorted(counts.items()), "id long, n long").coalesce(1).write.parquet(f"{to}/table")
    table = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = Frequencies(table.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                parts = [row["ids"], row["known"], row["counts"]]
                index = b"".join(struct.pack("<Q", len(x)) + x for x in parts)
                block = encode_block(_ids(row["width"], row["tokens"]), freq, index, len(unpack(row["counts"], np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (row["file"], row["first"], row["n"], block)], names=["file", "first", "n", "block"])

    raw.mapInArrow(tb.tidy(run), "file long, first long, n long, block binary").write.parquet(f"{to}/blocks")
    forget(raw)
    return to


def _bases(blocks: DataFrame) -> DataFrame:
    """file and base: the number of ids in all files before it."""
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).withColumn("group", F.floor(F.col("file") / GROUP))
    groups = files.groupBy("group").agg(F.sum("n").alias("n"))
    earlier = groups.alias("a").join(groups.alias("b"), F.col("b.group") < F.col("a.group"), "left").groupBy("a.group").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    order = Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    inside = files.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return inside.join(earlier, "group").select("file", (F.col("inside") + F.col("before")).alias("base"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) from the token files."""
    counts = {r["id"]: r["n"] for r in spark.read.parquet(f"{folder}/table").collect()}
    blocks = spark.read.schema("file long, first long, n long, block binary").parquet(f"{folder}/blocks")
    sent = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        freq = Frequencies(counts)
        for batch in batches:
            for first, block in zip(*(batch.column(k) for k in range(2)), strict=True):
                ids, index = decode_block(block.as_buffer().to_pybytes(), freq)
                parts, at = [], 0
                while at < len(index):
                    (size,) = struct.unpack_from("<Q", index, at)
                    parts.append(unpack(index[at + 8 : at + 8 + size], np.int64))
                    at += 8 + size
                doc_ids, known, n = parts
                ends = np.cumsum(n)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int64)), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())
                start = first.as_py() + ends - n
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=known == 0), pa.array(start), pa.array(n), data], names=["doc_id", "start", "n_tokens", "ids"])

    bases = _bases(blocks)
    if blocks.select("file").distinct().count() <= FEW:  # 16 bytes each: send them; else the blocks are shuffled
        bases = F.broadcast(bases)
    placed = blocks.join(bases, "file").select((F.col("base") + F.col("first")).alias("first"), "block")
    return placed.mapInArrow(tb.tidy(run), "doc_id long, start long, n_tokens long, ids binary")
