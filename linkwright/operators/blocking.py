"""Blocking: keys of records, the index, candidate pairs, and block statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance
from ..functions import text as T
from ..functions.similarity import soundex_code
from ..storage import plan_bytes, stored
from .ordering import numbered

PREFIXES, NGRAM = (2, 3, 4), 3
#: Expected records a key, by strategy, for the selectivity estimate.
DIVISOR = {"exact_prefix": 10.0, "phonetic_key": 15.0, "ngram": 8.0}
NGRAM_FROM, FEW_FROM, UZBEK_HEAD = 1000, 10_000, 100


def prefix_keys(c: Column, lengths: tuple[int, ...] = PREFIXES, case_sensitive: bool = False) -> Column:
    t = T.trimmed(c) if case_sensitive else F.lower(T.trimmed(c))
    return F.array_compact(F.array(*[F.when(F.length(t) >= n, F.substring(t, 1, n)) for n in lengths]))


def phonetic_keys(c: Column, compose: bool = True) -> Column:
    t = T.trimmed(c)
    key = T.phonetic_key(t, compose)
    return F.array_distinct(F.array_compact(F.array(F.when(T.is_uzbek(t) & (key != ""), key), F.when(t != "", soundex_code(t)))))


def _skipping(t: Column, n: int, k: int):
    """A gram of n characters from i on with k left out before the last."""
    return lambda i: F.concat(F.substring(t, i, F.lit(n - 1)), F.substring(t, i + (n - 1 + k), F.lit(1)))


def _tagged(name: str):
    return lambda k: F.struct(F.lit(name).alias("strategy"), k.alias("key"))


def ngram_keys(c: Column, n: int = NGRAM, skips: int = 0, keep_empty: bool = False) -> Column:
    """Distinct n-grams; a shorter text is its own key.  skips: also grams with 1..skips characters left out before the last."""
    t = T.trimmed(T.squeezed(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
    for k in range(1, skips + 1):
        more = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1) - k), _skipping(t, n, k))
        grams = F.when(F.length(t) >= n + k, F.concat(grams, more)).otherwise(grams)
    short = F.array(t) if keep_empty else F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(t) >= n, F.array_distinct(grams)).otherwise(short)


def whole_key(c: Column) -> Column:
    """The value itself, in lower case."""
    t = F.lower(T.trimmed(c))
    return F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


STRATEGIES = {"exact_prefix": prefix_keys, "phonetic_key": phonetic_keys, "ngram": ngram_keys, "whole": whole_key}
#: Fewer keys that bring the same records together: who shares a longer prefix shares the shortest.
PAIRING = {"exact_prefix": lambda c: prefix_keys(c, (min(PREFIXES),))}


def register(name: str, keys) -> None:
    """Add a blocking strategy: keys(column) returns an array of key texts."""
    STRATEGIES[name] = keys


def index(df: DataFrame, id_column: str, fields: list[str], strategies: list[str], pairing: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct (strategy, key, id) rows.  Keys of all fields share one space, so fields can meet.

    pairing: without keys that others imply, which makes the same pairs of fewer rows,
    and with rest, all keys of a record that has several: a pair is made at the first
    key in common alone.  keep: columns that go along, where ids are unique.
    """
    parts, makers = [], STRATEGIES | PAIRING if pairing else STRATEGIES
    for field in fields:
        for name in strategies:
            keys = F.transform(makers[name](F.col(f"`{field}`").cast("string")), _tagged(name))
            parts.append(F.when(F.col(f"`{field}`").isNotNull(), keys).otherwise(F.array().cast("array<struct<strategy:string,key:string>>")))
    rows = df.select(F.col(id_column).alias("id"), *keep, F.array_distinct(F.flatten(F.array(*parts))).alias("keys"))
    if not pairing:
        return rows.select("id", F.explode("keys").alias("k")).select("k.strategy", "k.key", "id")
    if not keep:
        rows = rows.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    rest = F.when(F.size("keys") > 1, F.array_sort(F.transform("keys", lambda k: _whole(k["strategy"], k["key"]))))
    return rows.select("id", *keep, rest.alias("rest"), F.explode("keys").alias("k")).select("k.strategy", "k.key", "id", "rest", *keep)


def _whole(strategy: Column | str, key: Column | str) -> Column:
    return F.concat_ws("\x01", strategy, key)


def characteristics(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """One row a field: filled and distinct values, uniqueness, mean length, Uzbek text among the first values."""
    counts = df.agg(*[x for i, f in enumerate(fields) for x in (F.count(f).alias(f"n{i}"), F.countDistinct(f).alias(f"d{i}"), F.avg(F.length(F.col(f).cast("string"))).alias(f"l{i}"))])
    head = df.orderBy(order).limit(UZBEK_HEAD).agg(*[F.coalesce(F.max(T.is_uzbek(F.col(f).cast("string"))), F.lit(False)).alias(f"u{i}") for i, f in enumerate(fields)])
    row = counts.crossJoin(F.broadcast(head))  # one row each
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("non_null"), F.col(f"d{i}").alias("distinct_values"), F.when(F.col(f"n{i}") == 0, 0.0).otherwise(F.col(f"d{i}") / F.col(f"n{i}")).alias("uniqueness"), F.coalesce(f"l{i}", F.lit(0.0)).alias("avg_length"), F.col(f"u{i}").alias("has_uzbek")) for i, f in enumerate(fields)])
    return row.select(F.explode(each).alias("c")).select("c.*")


def select_strategies(df: DataFrame, fields: list[str], order: str, strict: bool = True) -> list[str]:
    """Prefixes always; phonetic keys for Uzbek text; n-grams from NGRAM_FROM rows; two at most from FEW_FROM rows.

    Without strict no strategy is left out, whatever the size or the first values.
    """
    if not strict:
        return ["exact_prefix", "phonetic_key", "ngram"]
    n = df.count()
    head = df.orderBy(order).limit(UZBEK_HEAD).agg(F.max(F.greatest(*[T.is_uzbek(F.col(f).cast("string")).cast("int") for f in fields], F.lit(0))).alias("u")).first()
    chosen = ["exact_prefix"] + ["phonetic_key"] * bool(head["u"]) + ["ngram"] * (n > NGRAM_FROM)
    return chosen[:2] if n > FEW_FROM else chosen


def selected(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """The strategies that select_strategies chooses by size and first values, a row each."""
    return df.sparkSession.createDataFrame([(k, name) for k, name in enumerate(select_strategies(df, fields, order))], "place int, strategy string")


def candidate_pairs(left: DataFrame, right: DataFrame, max_block: int | None = None) -> DataFrame:
    """Distinct (id1, id2) of two indexes whose records share a key, by adaptive_pairs.

    max_block leaves out keys with more left records than that, an opt-in that loses pairs.
    """
    if max_block is None:
        return adaptive_pairs(left, right)
    small = left.groupBy("strategy", "key").agg(F.count("*").alias("n")).where(F.col("n") <= max_block).drop("n")
    left = left.join(small, ["strategy", "key"], "left_semi")
    pairs = left.withColumnRenamed("id", "id1").join(right.withColumnRenamed("id", "id2"), ["strategy", "key"])
    return pairs.select("id1", "id2").distinct()


#: Rows of one side that a part of a block has at least, and parts of pairs that all blocks are cut into, about; pairs that a task makes at least, and tasks at most; bytes of a table that is sent to all.
PART_ROWS, CELLS, TASK_PAIRS, TASKS, SENT = 2_000, 400, 4_000_000, 2_000, 8 << 20


def cells(left: DataFrame, right: DataFrame, part_rows: int | None = None, task_pairs: int = TASK_PAIRS, half: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of two indexes by strategy, key, part1 and part2, in tasks of like size; columns that both have get the number of their side.

    A block with more rows of a side than part_rows is cut into parts of that side by
    a hash of the id; each part of the left meets each part of the right, so no pair
    is lost and a row is sent once for each part of the other side.  Parts grow with
    the pairs, so their number, and with it the copies of a row, doesn't.  Parts are dealt
    out over as many tasks as their pairs need, which Spark doesn't merge again: it
    would go by their bytes, which say nothing of the pairs.  half, of an index with
    itself: of two parts' meetings one alone.
    """
    shared = (set(left.columns) & set(right.columns)) - {"strategy", "key"}
    same, left = left is right, stored(left, "index")
    right = left if same else stored(right, "index")
    sent, tasks = _parts(left, right, part_rows, task_pairs)

    def cut(rows: DataFrame, own: int, other: int) -> DataFrame:
        """Every row in its part of its block, once for each part of the other side."""
        rows = rows.withColumnsRenamed({c: f"{c}{own}" for c in shared}).join(sent, ["strategy", "key"], "left")
        mine = F.pmod(F.xxhash64(f"id{own}"), F.coalesce(F.col(f"parts{own}"), F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"parts{other}"), F.lit(1)) - 1))
        rows = rows.select(*[c for c in rows.columns if not c.startswith("parts")], mine.alias(f"part{own}"), theirs.alias(f"part{other}"))
        return (rows.where("part1 <= part2") if half else rows).repartition(tasks, *CELL)

    return cut(left, 1, 2), cut(right, 2, 1)


def _parts(left: DataFrame, right: DataFrame, part_rows: int | None, task_pairs: int) -> tuple[DataFrame, int]:
    """Of the blocks that are cut strategy, key and how many parts each side gets, and the number of tasks."""
    count = lambda rows, n: rows.groupBy("strategy", "key").agg(F.count("*").alias(n))
    parts = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    sizes = stored(count(left, "n1").join(count(right, "n2"), ["strategy", "key"]).select("strategy", "key", "n1", "n2"), "blocks")
    total = sizes.agg(F.sum(F.col("n1").cast("double") * F.col("n2"))).first()[0] or 0.0
    part_rows = part_rows or max(PART_ROWS, math.isqrt(int(total) // CELLS))
    tasks = int(max(1, -(-total // max(task_pairs, total // TASKS)), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    large = sizes.where((F.col("n1") > part_rows) | (F.col("n2") > part_rows)).select("strategy", "key", parts("n1").alias("parts1"), parts("n2").alias("parts2"))
    large = stored(large, "large")  # few: each holds more than part_rows rows
    return F.broadcast(large) if plan_bytes(large) <= SENT else large, tasks


CELL = ["strategy", "key", "part1", "part2"]


def meet(left: DataFrame, right: DataFrame, condition: Column | None = None, part_rows: int | None = None, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Rows of two indexes that share a key and meet the condition, by cells().

    Where both have rest, a pair is made once; no pair is stored or shuffled.
    """
    one, two = cells(left, right, part_rows, task_pairs)
    met = one.join(two.hint("shuffle_hash"), CELL)
    met = met.where(condition) if condition is not None else met
    return met.where(first_in_common()).drop("part1", "part2") if once(left, right) else met.drop("part1", "part2")


#: Pairs that a task of near_pairs() looks at, at least.
NEAR_PAIRS = 20_000_000


def near_pairs(left: DataFrame, right: DataFrame, half: bool = False) -> DataFrame:
    """(id1, id2, distance) of rows of two indexes that share a key and whose texts are near, or whose marks are equal; once for each common key.

    The indexes have text and share: texts are near whose Levenshtein distance is at
    most the left row's share of the longer length.  mark (a long, null for none): rows
    of equal marks are a pair too, with distance -1 where the texts aren't near.  half,
    of an index with itself: of a pair and its mirror image that with id1 <= id2, by the share of either row.
    Cells are sent to tasks as they are, and only what is near comes back.
    """
    marked = "mark" in left.columns
    columns = ["strategy", "key", "id", "text", "share", *["mark"] * marked]
    left = left.select(*columns)
    one, two = cells(left, left if half else right.select(*columns), None, NEAR_PAIRS, half)
    kind = one.schema["id1"].dataType.simpleString()

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, got = (a["id1"].combine_chunks(), b["id2"].combine_chunks()), []
        if len(a) and len(b):
            texts = [x.to_pylist() for x in (a["text1"], b["text2"])]
            for i, j, d in distance.near(*texts, a["share1"].to_numpy()):
                got.append((i, j, d))
            if marked:
                got.append(_alike(a["mark1"], b["mark2"], got))
        i, j, d = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
        x, y = ids[0].take(pa.array(i)), ids[1].take(pa.array(j))
        return _ordered(pa.table({"id1": x, "id2": y, "distance": pa.array(d, pa.int32())}), a, b, half)

    return in_cells(one, two, found, f"id1 {kind}, id2 {kind}, distance int")


def in_cells(one: DataFrame, two: DataFrame, found, schema: str) -> DataFrame:
    """What found() makes of the two tables of each cell."""
    two = two.withColumnsRenamed({c: f"{c}_" for c in CELL})  # both sides may be of one table
    return one.groupBy(*CELL).cogroup(two.groupBy(*[f"{c}_" for c in CELL])).applyInArrow(found, schema)


def _ordered(out: pa.Table, a: pa.Table, b: pa.Table, half: bool) -> pa.Table:
    """The pairs of a cell; half: those with id1 <= id2."""
    if not half or not len(a) or not len(b):
        return out
    x, y = out["id1"], out["id2"]
    ordered = pc.less_equal(x, y)
    if a["part1"][0] == a["part2"][0]:  # a part with itself makes both, two parts make one of them
        return out.filter(ordered)
    return out.set_column(0, "id1", pc.if_else(ordered, x, y)).set_column(1, "id2", pc.if_else(ordered, y, x))


def reaching_pairs(left: DataFrame, right: DataFrame, weights: list[float], loss: float, least: float, boost: float, matched: float, half: bool = False) -> DataFrame:
    """(id1, id2) of rows of two indexes that share a key and whose confidence can reach least by distance.reaching(); once for each common key.

    Of each field number k the indexes have text{k}_, mark{k}_ (a long), filled{k}_ and
    up{k}_ (what two values may add).  Cells are sent to tasks as they are, and only
    pairs that can be matches come back.  half: see near_pairs().
    """
    fields = [[f"{c}{k}_" for c in ("text", "mark", "filled", "up")] for k in range(len(weights))]
    columns = ["strategy", "key", "id", *[c for f in fields for c in f]]
    left = left.select(*columns)
    one, two = cells(left, left if half else right.select(*columns), None, NEAR_PAIRS, half)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((one, "id1"), (two, "id2"))]

    def values(rows: pa.Table, side: int) -> list[distance.Values]:
        out = []
        for (text, mark, filled, up), w in zip(fields, weights, strict=True):
            get = lambda c: rows[f"{c}{side}"].to_pylist()
            out.append(distance.Values(get(text), get(mark), [w if x else 0.0 for x in get(filled)], get(up)))
        return out

    def found(a: pa.Table, b: pa.Table) -> pa.Table:
        got = list(distance.reaching(values(a, 1), values(b, 2), loss, least, boost, matched)) if len(a) and len(b) else []
        i, j = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
        out = pa.table({"id1": a["id1"].combine_chunks().take(pa.array(i)), "id2": b["id2"].combine_chunks().take(pa.array(j))})
        return _ordered(out, a, b, half)

    return in_cells(one, two, found, f"id1 {kinds[0]}, id2 {kinds[1]}")


def _alike(a: pa.ChunkedArray, b: pa.ChunkedArray, known: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows of equal marks that aren't among the known pairs."""
    x, y = (pd.DataFrame({"m": c.to_pandas(integer_object_nulls=True), "r": np.arange(len(c))}).dropna() for c in (a, b))
    met = x.merge(y, on="m")
    pairs = met["r_x"].to_numpy(np.int64) * len(b) + met["r_y"].to_numpy(np.int64)
    seen = np.concatenate([i * len(b) + j for i, j, _ in known]) if known else np.zeros(0, np.int64)
    pairs = np.setdiff1d(pairs, seen)
    return pairs // len(b), pairs % len(b), np.full(len(pairs), -1)


def once(left: DataFrame, right: DataFrame) -> bool:
    """Do both indexes tell which key of a pair is the first in common?"""
    return "rest" in left.columns and "rest" in right.columns


def first_in_common() -> Column:
    return F.col("rest1").isNull() | F.col("rest2").isNull() | (F.element_at(F.array_intersect("rest1", "rest2"), 1) == _whole("strategy", "key"))


def adaptive_pairs(left: DataFrame, right: DataFrame, part_rows: int | None = None, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Distinct (id1, id2) of two indexes whose records share a key, in tasks of like size; see meet() and listed_pairs()."""
    if not once(left, right):
        return meet(left, right, None, part_rows, task_pairs).select("id1", "id2").distinct()
    same, left = left is right, stored(left, "index")
    right = left if same else stored(right, "index")
    if any(x.where("rest IS NOT NULL").isEmpty() for x in ([left] if same else [left, right])):
        return listed_pairs(left, right, part_rows, task_pairs)
    return meet(left, right, None, part_rows, task_pairs).select("id1", "id2")


#: Ids of a run of the left and of the right: each left id of one is put out with all right ids of another, which then come again and again at short distance.
RUNS = (16, 256)


def listed_pairs(left: DataFrame, right: DataFrame, part_rows: int | None = None, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(id1, id2) of two stored indexes whose records share a key, once for each key in common.

    The ids of a part of a block travel as one list, and lists meet in the cells of
    cells().  There they are cut into runs; a short run of right ids comes again for
    each left id of a run, which makes small files of the many pairs.
    """
    sent, tasks = _parts(left, right, part_rows, task_pairs)

    def lists(rows: DataFrame, own: int) -> DataFrame:
        rows = rows.select("strategy", "key", "id").join(sent, ["strategy", "key"], "left")
        many = [F.coalesce(F.col(f"parts{k}"), F.lit(1)).alias(f"parts{k}") for k in (1, 2)]
        mine = F.pmod(F.xxhash64("id"), F.coalesce(F.col(f"parts{own}"), F.lit(1))).cast("int").alias("part")
        return stored(rows.select("strategy", "key", "id", *many, mine).groupBy("strategy", "key", "parts1", "parts2", "part").agg(F.collect_list("id").alias("ids")), "lists")

    def sent_out(rows: DataFrame, own: int, other: int) -> DataFrame:
        """Every list once for each part of the other side."""
        theirs = F.explode(F.sequence(F.lit(0), F.col(f"parts{other}") - 1)).alias(f"part{other}")
        return rows.select("strategy", "key", F.col("part").alias(f"part{own}"), F.col("ids").alias(f"ids{own}"), theirs).repartition(tasks, *CELL)

    one = lists(left, 1)
    two = one if left is right else lists(right, 2)
    met = sent_out(one, 1, 2).join(sent_out(two, 2, 1).hint("shuffle_hash"), CELL)
    runs = lambda k: F.explode(F.transform(F.sequence(F.lit(1), F.size(f"ids{k}"), F.lit(RUNS[k - 1])), lambda i: F.slice(f"ids{k}", i, F.lit(RUNS[k - 1])))).alias(f"run{k}")
    cut = met.select("ids1", runs(2)).select(runs(1), "run2")
    # as many partitions as before, but a step of its own: in one step Spark would hold all pairs of a cell at once
    return cut.coalesce(tasks).select(F.explode("run1").alias("id1"), "run2").select("id1", F.explode("run2").alias("id2"))


def count_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n, the distinct pairs of records that adaptive_pairs makes of two indexes with rest, rows standing for __n records each.

    Records of the same keys are counted together, so no pair is made for it.
    """
    alike = lambda rows, k: rows.groupBy("strategy", "key", F.col("rest").alias(f"rest{k}")).agg(F.sum("__n").alias(f"n{k}"))
    met = alike(left, 1).join(alike(right, 2), ["strategy", "key"]).where(first_in_common())
    return met.agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("n"))


def block_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("strategy", "key").agg(F.countDistinct("id").alias("size"))


def statistics(rows: DataFrame, n_records: int) -> DataFrame:
    """Blocks, average, largest and smallest size, and the share of comparisons saved."""
    n_pairs = n_records * (n_records - 1) // 2
    sizes = block_sizes(rows)
    inside = F.sum(F.expr("size * (size - 1) div 2"))
    saved = F.greatest(F.lit(0.0), (F.lit(1.0) - inside / F.lit(float(max(1, n_pairs)))) * 100.0) if n_pairs else F.lit(0.0)
    return sizes.agg(F.count("*").alias("blocks"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"), saved.alias("reduction_ratio"))


def distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("strategy").agg(F.countDistinct("key").alias("blocks"))


def block_info(rows: DataFrame) -> DataFrame:
    """By strategy: blocks, memberships, and how many blocks there are of each size."""
    by_size = block_sizes(rows).groupBy("strategy", "size").agg(F.count("*").alias("n"))
    return by_size.groupBy("strategy").agg(F.sum("n").alias("blocks"), F.sum(F.col("n") * F.col("size")).alias("memberships"), F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))


def split_blocks(rows: DataFrame, max_size: int) -> DataFrame:
    """Keys of large blocks get the number of their part, parts of max_size in the order of the ids.

    Rows are numbered over the whole index in ranges, so a large block isn't sorted
    by one task; a block's first number makes them numbers of its own.
    """
    placed = numbered(rows.select("strategy", "key", "id"), ["strategy", "key", "id"])
    blocks = placed.groupBy("strategy", "key").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    part = F.floor((F.col("place") - F.col("first")) / max_size).cast("string")
    return placed.join(blocks, ["strategy", "key"]).select("strategy", F.when(F.col("n") > max_size, F.concat_ws("_", "key", part)).otherwise(F.col("key")).alias("key"), "id")


def selectivity(values: DataFrame, column: str, strategy: str) -> DataFrame:
    """min(1, 1 / (records a key / the strategy's divisor)); 1 without keys."""
    keys = values.select(F.explode(STRATEGIES[strategy](F.col(column).cast("string"))).alias("key")).agg(F.countDistinct("key").alias("keys"))
    both = values.agg(F.count(column).alias("records")).crossJoin(F.broadcast(keys))  # one row each
    ratio = F.col("records") / F.col("keys") / F.lit(DIVISOR[strategy])
    return both.select("records", "keys", F.when((F.col("keys") == 0) | (F.col("records") == 0), 1.0).otherwise(F.least(F.lit(1.0), 1.0 / ratio)).alias("selectivity"))


def reduction_ratio(pairs: Column, n1: Column, n2: Column) -> Column:
    return F.when((n1 == 0) | (n2 == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (1.0 - pairs / (n1.cast("double") * n2)) * 100.0))
