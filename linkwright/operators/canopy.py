"""Canopies: overlapping groups of records around centres, by a cheap similarity of their grams.

Every record is in a canopy.  Records are taken in the order of a keyed hash: one
that no earlier centre resembles by `tight` or more is a centre itself, and its
canopy are all records that resemble it by `loose` or more.  Similarity is the share
of common grams of two sets among all of both (Jaccard).

Records of equal grams are one class, so copies cost nothing.  Classes meet in an
inverted index of their rarest grams only: sets that share enough of them share one
of so many rare ones (prefix filter), and are compared in the tasks where they meet, by
hashed bits first, once for each pair: only similar ones leave them.  Centres are found in rounds, each of which decides all classes at once that
come before every undecided class they resemble; with hashed order a few rounds do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import scratch, stored
from . import blocking
from .ordering import numbered


def classes_of(df: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, class) of every record, and (class, grams, n) of every class: records with the same grams, named by the smallest id.

    Records without grams (null or empty texts) are one class.
    """
    sets = stored(df.select(F.col(id_column).alias("id"), F.array_sort(F.coalesce(blocking.ngram_keys(F.col(text).cast("string")), F.array().cast("array<string>"))).alias("grams")), "sets")
    classes = stored(sets.groupBy("grams").agg(F.min("id").alias("class")).select("class", "grams", F.size("grams").alias("n")), "classes")
    return stored(sets.join(classes, "grams").select("id", "class"), "members"), classes


def similar_sets(classes: DataFrame, least: float) -> DataFrame:
    """(c1, c2, similarity) of the pairs of classes c1 < c2 whose sets are alike by least (above 0) or more."""
    if not 0 < least <= 1:
        raise ValueError("the similarity lies above 0 and not above 1")
    if isinstance(classes.schema["class"].dataType, StructType):  # cells go by plain ids
        numbers = stored(classes.withColumn("number", F.monotonically_increasing_id()), "numbers")
        name = lambda k: numbers.select(F.col("number").alias(f"c{k}"), F.col("class").alias(f"class{k}"))
        found = similar_sets(numbers.drop("class").withColumnRenamed("number", "class"), least).join(name(1), "c1").join(name(2), "c2")
        both = lambda f: f(F.col("class1"), F.col("class2"))
        return found.select(both(F.least).alias("c1"), both(F.greatest).alias("c2"), "similarity")
    each = classes.select("class", F.explode("grams").alias("g"))
    ranks = stored(numbered(each.groupBy("g").agg(F.count("*").alias("k")), ["k", "g"], "r").select("g", F.col("r").cast("int").alias("r")), "ranks")
    ordered = stored(each.join(ranks, "g").groupBy("class").agg(F.array_sort(F.collect_list("r")).alias("s")), "ordered")
    length = F.size("s") - F.ceil(F.size("s") * F.lit(least - 1e-9)) + 1
    prefix = F.posexplode(F.slice("s", F.lit(1), F.greatest(length.cast("int"), F.lit(1)))).alias("i", "key")
    rows = ordered.select(F.lit("").alias("strategy"), F.col("class").alias("id"), "s", prefix)
    one, two = blocking.cells(rows, rows, None, blocking.NEAR_PAIRS, True)
    kind = classes.schema["class"].dataType.simpleString()

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = list(_alike(*(_Sets(x[f"s{k}"], x[f"i{k}"]) for k, x in ((1, a), (2, b))), least)) if len(a) and len(b) else []
        i, j, similarity = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        out = pa.table({"c1": a["id1"].combine_chunks().take(pa.array(i)), "c2": b["id2"].combine_chunks().take(pa.array(j)), "similarity": similarity})
        x, y = out["c1"], out["c2"]
        if len(a) and len(b) and a["part1"][0] == a["part2"][0]:  # a part with itself makes both
            return out.filter(pc.less(x, y))
        ordered = pc.less(x, y)
        return out.set_column(0, "c1", pc.if_else(ordered, x, y)).set_column(1, "c2", pc.if_else(ordered, y, x))

    return blocking.in_cells(one, two, found, f"c1 {kind}, c2 {kind}, similarity double")


#: Words of 64 hashed bits of a set; pairs whose bits are compared together, and those that are compared gram by gram.
BITS, STRIP, AT_ONCE = 4, 1 << 16, 1 << 18


class _Sets:
    """Sets of ranks in ascending order, the place of the one that they meet at, and hashed bits."""

    def __init__(self, lists: pa.ChunkedArray, place: pa.ChunkedArray):
        lists = lists.combine_chunks()
        self.n, self.place = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), place.to_numpy().astype(np.int64)
        self.flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        bit = (self.flat * 2654435761 >> 7) % (64 * BITS)
        self.bits = np.zeros((BITS, len(self.n)), np.uint64)
        np.bitwise_or.at(self.bits, (bit // 64, self.row), np.uint64(1) << (bit % 64).astype(np.uint64))


def _alike(a: _Sets, b: _Sets, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, similarity) of sets alike by least or more whose first common rank is that which they meet at."""
    words = np.unique(b.flat)
    width = len(words) + 1
    has = np.zeros((len(b.n), width), bool)
    has[b.row, np.searchsorted(words, b.flat)] = True
    own = np.searchsorted(words, a.flat)
    own[np.r_[words, -1][own] != a.flat] = len(words)  # in none of b

    def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        common, first = np.zeros(len(i), np.int64), np.full(len(i), -1)
        for k in range(int(a.n[i].max(initial=0))):
            some = np.flatnonzero(a.n[i] > k)
            hit = some[has[j[some], own[a.start[i[some]] + k]]]
            first[hit[common[hit] == 0]] = k
            common[hit] += 1
        similarity = common / (a.n[i] + b.n[j] - common)
        kept = (similarity >= least) & (first == a.place[i])
        return i[kept], j[kept], similarity[kept]

    waiting, size, n = [], 0, b.n.astype(np.float32)
    for start in range(0, len(a.n), step := max(1, STRIP // len(b.n))):
        rows = slice(start, start + step)
        lack = sum(np.bitwise_count(x[rows, None] & ~y[None, :]) for x, y in zip(a.bits, b.bits, strict=True))
        most, total = a.n[rows, None].astype(np.float32) - lack, a.n[rows, None].astype(np.float32) + n[None, :]
        i, j = np.nonzero(most * np.float32(1 + least) >= total * np.float32(least) - np.float32(1e-3))
        waiting.append((i + start, j))
        size += len(i)
        if size >= AT_ONCE:
            yield exact(*(np.concatenate(k) for k in zip(*waiting, strict=True)))
            waiting, size = [], 0
    if size:
        yield exact(*(np.concatenate(k) for k in zip(*waiting, strict=True)))


def centres(classes: DataFrame, links: DataFrame, seed: int = 0) -> DataFrame:
    """(class): in the order of a keyed hash, those without a link (c1, c2) to an earlier one of them."""
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)), F.col(c))
    both = links.select("c1", "c2").unionByName(links.select(F.col("c2").alias("c1"), F.col("c1").alias("c2")))
    edges = stored(both.select("c1", "c2", (order("c2") < order("c1")).alias("after")), "links")
    nodes, found = classes.select("class"), []
    undecided = stored(nodes, "undecided")
    while True:
        ahead = undecided.join(edges.where("after").select(F.col("c1").alias("class")).distinct(), "class", "left_anti")
        now = stored(ahead, "centres")
        found.append(now)
        if edges.isEmpty():
            break
        near = edges.join(now.withColumnRenamed("class", "c1"), "c1", "left_semi").select(F.col("c2").alias("class")).distinct()
        gone = near.union(now)
        undecided = stored(undecided.join(gone, "class", "left_anti"), "undecided")
        left = undecided.withColumnRenamed("class", "c1")
        edges = stored(edges.join(left, "c1", "left_semi").join(left.withColumnRenamed("c1", "c2"), "c2", "left_semi"), "links")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def canopies(df: DataFrame, id_column: str, text: str, loose: float = 0.4, tight: float = 0.6, seed: int = 0) -> DataFrame:
    """(canopy, id, similarity): every record with each canopy that it is in; a canopy is named by the smallest id of its centre's class."""
    if not 0 < loose <= tight <= 1:
        raise ValueError("loose lies above 0, and tight between loose and 1")
    with scratch(df.sparkSession):
        members, classes = classes_of(df, id_column, text)
        links = stored(similar_sets(classes, loose), "similar")
        chosen = stored(centres(classes, links.where(F.col("similarity") >= tight), seed), "chosen")
        both = links.unionByName(links.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"), "similarity"))
        around = both.join(chosen.withColumnRenamed("class", "c1"), "c1", "left_semi").select(F.col("c1").alias("canopy"), F.col("c2").alias("class"), "similarity")
        whole = chosen.select(F.col("class").alias("canopy"), "class", F.lit(1.0).alias("similarity")).unionByName(around)
        return stored(whole.join(members, "class").select("canopy", "id", "similarity"), "canopies", keep=True)


def canopy_pairs(d1: DataFrame, d2: DataFrame, id1: str, id2: str, field1: str, field2: str, loose: float = 0.4, tight: float = 0.6) -> DataFrame:
    """Distinct (id1, id2) of two tables with a canopy in common."""
    name = lambda df, i, f, side: df.select(F.struct(F.lit(side).alias("side"), F.col(i).cast("string").alias("id")).alias("id"), F.col(f).cast("string").alias("text"))
    found = canopies(name(d1, id1, field1, 1).unionByName(name(d2, id2, field2, 2)), "id", "text", loose, tight)
    rows = found.select(F.lit("canopy").alias("strategy"), F.to_json("canopy").alias("key"), F.col("id.id").alias("id"), F.col("id.side").alias("side"))
    sides = [rows.where(f"side = {k}").select("strategy", "key", F.col("id").cast(df.schema[i].dataType).alias("id")) for k, df, i in ((1, d1, id1), (2, d2, id2))]
    return blocking.candidate_pairs(*sides)
