"""Linking two tables: candidates, scores, threshold, unmatched records, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import plan_bytes, scratch, stored
from . import blocking
from .canopy import canopy_pairs
from .ordering import neighbour_pairs
from .scoring import BOOST, MATCHED, ORDER, Algorithm, FieldMapping, loss, prepared, prepared_columns, scored

CARDINALITIES = ("many_to_many", "one_to_one", "one_to_many", "many_to_one", "stable_one_to_one")
#: The sides whose records keep only their best partner.
BEST = {"many_to_one": (0,), "one_to_many": (1,), "one_to_one": (0, 1)}
METHODS = ("keys", "adaptive", "sorted_neighbourhood", "canopy")
HIGH = 85.0
#: Bytes of stored normal forms that are sent to all executors; pairs that a task scores at least, and tasks at most; members of a class in a list, and of those that are put out at once.
SENT, PAIRS, TASKS, LISTED, RUN = 16 << 20, 50_000, 20_000, 500, 16


@dataclass(frozen=True)
class LinkageConfig:
    """What to compare, how, and what counts as a match.

    strict reproduces odd cases (null compared as text, digits alike in sound,
    unmatched by value, match counts as comparison counts, blocking strategies
    by size where none are named); the default doesn't.
    """

    mappings: tuple[FieldMapping, ...]
    algorithms: tuple[Algorithm, ...] = ()
    threshold: float = 75.0
    use_blocking: bool = True
    strategies: tuple[str, ...] | None = None
    cardinality: str = "many_to_many"
    strict: bool = False
    max_block: int | None = None
    #: Pairs of fields that the blocking keys are made of, instead of those that are compared.
    block_on: tuple[tuple[str, str], ...] | None = None
    #: How candidates are found: keys in common; the same in tasks of like size; places in sorted orders; canopies in common.
    method: str = "keys"
    #: Places of the sorted neighbourhood; loose and tight similarity of canopies.
    window: int = 10
    canopy: tuple[float, float] = (0.4, 0.6)

    def __post_init__(self):
        if not self.mappings:
            raise ValueError("at least one field mapping is needed")
        if not 0 <= self.threshold <= 100:
            raise ValueError("the threshold lies between 0 and 100")
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"cardinality is one of {CARDINALITIES}")
        if self.method not in METHODS:
            raise ValueError(f"method is one of {METHODS}")
        if self.max_block is not None and self.method != "keys":
            raise ValueError("max_block goes with keys alone")

    def enabled(self) -> list[Algorithm]:
        """Enabled algorithms, the fixed order first; all three if none is configured."""
        on = [a for a in self.algorithms if a.enabled] or [Algorithm(k) for k in ORDER]
        return sorted(on, key=lambda a: ORDER.index(a.kind) if a.kind in ORDER else len(ORDER))


@dataclass
class LinkageResult:
    matched: DataFrame
    unmatched_1: DataFrame
    unmatched_2: DataFrame
    statistics: DataFrame
    metadata: dict = field(default_factory=dict)
    #: expanded() of what a function makes of the stored matches of classes; None: of a result that was read or put together.
    expand: Callable | None = None

    def scores(self, columns: dict[str, Column], of: Callable[[DataFrame], DataFrame] = lambda m: m) -> DataFrame:
        """id1, id2 and columns of matched (of what `of` makes of it) without its records, worked out once for each pair of classes instead of each pair of records."""
        if self.expand is None:
            return of(self.matched).select("id1", "id2", *[c.alias(k) for k, c in columns.items()])
        return self.expand(lambda m: of(m).select("number1", "number2", "n1", "n2", *[c.alias(k) for k, c in columns.items()]))


def candidates(d1: DataFrame, d2: DataFrame, id1: str, id2: str, config: LinkageConfig) -> DataFrame:
    """(id1, id2) to compare: blocked, or all (the opt-in without blocking)."""
    if not config.use_blocking:
        return d1.select(F.col(id1).alias("id1")).crossJoin(d2.select(F.col(id2).alias("id2")))
    on = config.block_on or [(m.source, m.target) for m in config.mappings]
    if config.method == "sorted_neighbourhood":
        key = lambda f: F.lower(T.trimmed(F.col(f"`{f}`").cast("string")))
        return neighbour_pairs(d1, d2, id1, id2, [(key(a), key(b)) for a, b in on], config.window)
    if config.method == "canopy":
        found = [canopy_pairs(d1, d2, id1, id2, a, b, *config.canopy) for a, b in on]
        return reduce(DataFrame.union, found).distinct()
    fields1, fields2 = map(list, zip(*on, strict=True))
    strategies = list(config.strategies or blocking.select_strategies(d1, fields1, id1, config.strict))
    fewer = config.max_block is None  # a bound on blocks is meant for all keys
    left, right = blocking.index(d1, id1, fields1, strategies, fewer), blocking.index(d2, id2, fields2, strategies, fewer)
    return blocking.candidate_pairs(left, right, config.max_block)


def _ready(df: DataFrame, side: str, config: LinkageConfig) -> tuple[DataFrame, list[str]]:
    """df with the normal forms of its mapped fields, worked out once a record, and the names of those that a pair needs."""
    algorithms = config.enabled()
    fields = [m.source if side == "a" else m.target for m in config.mappings]
    return prepared(df, side, fields, algorithms, config.strict), [c for i in range(len(fields)) for c in prepared_columns(side, i, algorithms)]


def score_pairs(pairs: DataFrame, d1: DataFrame, d2: DataFrame, id1: str, id2: str, config: LinkageConfig) -> DataFrame:
    """id1, id2, similarity, confidence, matched_fields, algorithm, field_results of every pair that reaches the threshold.

    Normal forms are worked out once a record and stored, before pairing.  They are
    sent to the pairs while their files stay below SENT; above that both are
    shuffled.  Only what is compared travels with a pair; the records join again
    after the threshold.
    """
    both = pairs
    for side, df, key, name in (("a", d1, id1, "id1"), ("b", d2, id2, "id2")):
        fields = [m.source if side == "a" else m.target for m in config.mappings]
        ready, columns = _ready(df.select(F.col(key).alias(name), *dict.fromkeys(fields)), side, config)
        ready = stored(ready.select(name, *columns), "ready")
        both = both.join(F.broadcast(ready) if plan_bytes(ready) <= SENT else ready.hint("merge"), name)
    return scored(both, list(config.mappings), config.enabled(), config.strict, config.threshold)


def near_share(config: LinkageConfig) -> float | None:
    """The share of the longer text in which two fuzzy forms may differ in a match, where one field is compared by exact and Levenshtein scores alone; else None."""
    kinds = {a.kind: a.params for a in config.enabled()}
    if len(config.mappings) > 1 or set(kinds) - {"exact", "fuzzy"} or kinds.get("fuzzy", {"method": "levenshtein"}).get("method") != "levenshtein":
        return None
    share = (100.0 + BOOST - config.threshold) / 100.0 if "fuzzy" in kinds else 0.0
    return share if share < 1 else None


def score_near(k1: DataFrame, k2: DataFrame, config: LinkageConfig, strategies: list[str]) -> DataFrame:
    """The scores of score_blocks where near_share() or loss() bound them: only pairs with near fuzzy forms or equal exact forms, of several fields those whose distances can reach the threshold, leave the tasks that look at them."""
    algorithms, sides, same, share = config.enabled(), [], k1 is k2, near_share(config)
    on = config.block_on or [(m.source, m.target) for m in config.mappings]
    spoken = any(a.kind == "fuzzy" and a.params.get("normalize_uzbek", True) for a in algorithms)
    parts = int(k1.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side, df in (("a", k1), ("b", k2))[: 1 if same else 2]:
        # a few files, but much work for each row
        ready, columns = _ready(df.repartition(parts), side, config)
        more, filled = {}, F.lit(False)
        for i in range(len(config.mappings)):
            form = {c: F.col(f"{side}{c}{i}") if f"{side}{c}{i}" in columns else F.lit(None).cast("string") for c in ("fz", "ex", "uz")}
            text, up = F.coalesce(form["fz" if f"{side}fz{i}" in columns else "ex"], F.lit("")), F.when(form["uz"].cast("boolean"), 15.0 * spoken).otherwise(0.0)
            mark, full = F.xxhash64(F.coalesce(form["ex"], F.lit(""))), F.coalesce(F.col(f"{side}raw{i}") != "", F.lit(False))
            if f"{side}ex{i}" not in columns:
                mark = F.xxhash64(text)
            if share is None:
                more |= {f"text{i}_": text, f"mark{i}_": mark, f"filled{i}_": full, f"up{i}_": up}
            else:
                more |= {"text": F.coalesce(form["fz"], F.lit("")), "share": F.least(F.lit(share) + up / 100.0, F.lit(1.0)), "mark": mark}
            filled = filled | full
        ready = stored(ready.withColumns(more).where(filled), "ready")
        sides.append((ready, columns, list(more)))
    indexes = [blocking.index(ready, "__number", [f[k] for f in on], strategies, True, more) for k, (ready, _, more) in enumerate(sides)]
    best = BEST.get(config.cardinality, ()) if share is not None else ()
    if best:
        pairs = best_near(sides, indexes, on, strategies, best)
    elif share is None:
        pairs = blocking.reaching_pairs(indexes[0], indexes[-1], [m.weight for m in config.mappings], loss(algorithms), config.threshold, BOOST, MATCHED, same)
    else:
        pairs = blocking.near_pairs(indexes[0], indexes[-1], same).select("id1", "id2")
    pairs = pairs if not best and len(on) == 1 and strategies == ["exact_prefix"] else pairs.distinct()
    if same and not best:
        turned = F.struct(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
        pairs = pairs.select(F.explode(F.when(F.col("id1") == F.col("id2"), F.array(turned)).otherwise(F.array(F.struct("id1", "id2"), turned))).alias("p")).select("p.*")
    both = stored(pairs, "pairs")
    for side, name, (ready, columns, _) in (("a", "id1", sides[0]), ("b", "id2", sides[-1])):
        own = ready.select(F.col("__number").alias(name), *[F.col(f"{'a' if same else side}{c[1:]}").alias(f"{side}{c[1:]}") for c in columns])
        both = both.join(F.broadcast(own) if plan_bytes(own) <= SENT else own.hint("merge"), name)
    return scored(both, list(config.mappings), algorithms, config.strict, config.threshold)


def best_near(sides: list[tuple], indexes: list[DataFrame], on: list[tuple[str, str]], strategies: list[str], best: tuple[int, ...]) -> DataFrame:
    """Pairs (id1, id2) of one field among which is the best of each record of the sides in best.

    Equal exact or fuzzy forms score 100, and nothing else does: a record with such a
    partner has its best in the one with the smallest id, found by grouping.  Only
    records without one are compared with all others of their keys.
    """
    forms = []
    for k, (ready, columns, _) in enumerate((sides[0], sides[-1])):
        side = "a" if len(sides) == 1 or not k else "b"
        known = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c[1:-1]).alias("kind"), F.col(c).alias("form"))) for c in columns if c[1:] in ("ex0", "fz0")]
        kept = ready.withColumn("form_", F.array_compact(F.array(*known)))
        rows = blocking.index(kept, "__number", [f[k] for f in on], strategies, True, ["__id", "form_"])
        forms.append(rows.select("strategy", "key", F.explode("form_").alias("form"), F.struct("__id", "id").alias("own")))
    found, indexes = [], [indexes[0], indexes[-1]]
    for k in best:
        first = forms[1 - k].groupBy("strategy", "key", "form").agg(F.min("own").alias("other"))
        met = forms[k].join(first, ["strategy", "key", "form"]).groupBy(F.col("own.id").alias("mine")).agg(F.min("other").alias("other"))
        full = stored(met.select("mine", F.col("other.id").alias("theirs")), "full")
        found.append(full.select(F.col("mine").alias(f"id{k + 1}"), F.col("theirs").alias(f"id{2 - k}")).select("id1", "id2"))
        left = stored(indexes[k].join(full.select(F.col("mine").alias("id")), "id", "left_anti"), "rest")
        if not left.isEmpty():
            found.append(blocking.near_pairs(*((left, indexes[1]) if k == 0 else (indexes[0], left))).select("id1", "id2"))
    return reduce(DataFrame.union, found)


def score_blocks(d1: DataFrame, d2: DataFrame, config: LinkageConfig, strategies: list[str]) -> tuple[DataFrame, DataFrame]:
    """The scores of score_pairs for classes of records that share a key; and how many pairs of records have a key in common (one row: n)."""
    on = config.block_on or [(m.source, m.target) for m in config.mappings]
    parts = int(d1.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a few files, but much work for each row
    counted = [blocking.index(df.repartition(parts), "__number", [f[k] for f in on], strategies, True, ["__n"]) for k, df in enumerate((d1, d2))]
    n_compared = blocking.count_pairs(*counted)
    if near_share(config) is not None or loss(config.enabled()) is not None:
        return score_near(d1, d2, config, strategies), n_compared
    sides = []
    for side, df in (("a", d1), ("b", d2)):
        ready, columns = _ready(df.repartition(parts), side, config)
        sides.append(blocking.index(ready, "__number", [f[side == "b"] for f in on], strategies, True, columns))
    return scored(blocking.meet(*sides), list(config.mappings), config.enabled(), config.strict, config.threshold), n_compared


def with_cardinality(matches: DataFrame, cardinality: str) -> DataFrame:
    """many_to_one keeps the best of each id1, one_to_many of each id2, one_to_one the mutually best; for stable_one_to_one see stable_pairs."""
    if cardinality == "stable_one_to_one":
        return stable_pairs(matches)
    out = matches
    for key, other, kinds in (("id1", "id2", ("many_to_one", "one_to_one")), ("id2", "id1", ("one_to_many", "one_to_one"))):
        if cardinality in kinds:
            order = Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc("similarity"), other)
            out = out.withColumn(f"__{key}", F.row_number().over(order))
    for c in [c for c in out.columns if c in ("__id1", "__id2")]:
        out = out.where(F.col(c) == 1)
    return out.select(*matches.columns)


def stable_pairs(matches: DataFrame, seed: int = 0) -> DataFrame:
    """One-to-one matches of which none that is left out could be added or put in place of worse ones.

    In rounds, mutually best pairs are taken and all others of their records removed,
    until none is left: the same as taking all pairs in their order, the best first,
    where both records are free.  Order: confidence, similarity (both
    to nine digits), a keyed hash of the pair, ids.  The hash lets groups of equal records pair off in a few rounds; by ids
    alone each round would settle one pair of a group.
    """
    score = lambda c: (-F.round(c, 9)).alias(c)
    place = F.struct(score("confidence"), score("similarity"), F.md5(F.concat_ws(":", F.lit(str(seed)), "id1", "id2").cast("binary")).alias("hash"), "id1", "id2")
    left, chosen = stored(matches.select("id1", "id2", place.alias("o")), "pairs"), []
    while not left.isEmpty():
        first = lambda c: F.min("o").over(Window.partitionBy(c))
        ranked = left.withColumn("b1", first("id1")).withColumn("b2", first("id2"))
        best = stored(ranked.where("o = b1 AND o = b2").select("id1", "id2"), "best")
        chosen.append(best)
        left = stored(left.join(best.select("id1"), "id1", "left_anti").join(best.select("id2"), "id2", "left_anti").select("id1", "id2", "o"), "pairs")
    return matches.join(reduce(DataFrame.union, chosen), ["id1", "id2"], "left_semi") if chosen else matches


def unmatched(df: DataFrame, id_column: str, matched_ids: DataFrame, by_value: bool = False) -> DataFrame:
    """Records without a match: by id, or (strict) also without an equal record that has one."""
    ids = matched_ids.distinct()
    if not by_value:
        return df.join(ids, df[id_column] == ids[ids.columns[0]], "left_anti")
    hit = df.join(ids, df[id_column] == ids[ids.columns[0]], "left_semi").alias("h")
    same = [F.col(f"d.`{c}`").eqNullSafe(F.col(f"h.`{c}`")) for c in df.columns if c != id_column]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return df.alias("d").join(hit, condition, "left_anti")


def statistics(matches: DataFrame, n1: int, n2: int, n_compared: DataFrame | int, strict: bool = False) -> DataFrame:
    """Of matches of classes with n1 and n2 records, which are counted as the matches of all their records."""
    n, weight = F.coalesce(F.sum("n"), F.lit(0)), F.col("n1") * F.col("n2")
    matches = matches.withColumn("n", weight)
    seen = lambda k: matches.select(f"number{k}", f"n{k}").distinct().agg(F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"ids{k}"))
    rate = lambda size: F.lit(0.0) if not size else F.col("n") * 100.0 / size
    rest = lambda size, k: F.greatest(F.lit(0), F.lit(size) - F.col("n" if strict else f"ids{k}"))
    mean = F.coalesce(F.sum(F.col("confidence") * F.col("n")) / F.sum("n"), F.lit(0.0))
    sums = matches.agg(n.alias("n"), F.coalesce(F.sum(F.when(F.col("confidence") >= HIGH, F.col("n"))), F.lit(0)).alias("high"), mean.alias("mean"))
    row = sums.crossJoin(F.broadcast(seen(1))).crossJoin(F.broadcast(seen(2)))  # one row each
    compared = n_compared.select(F.col("n").alias("compared")) if isinstance(n_compared, DataFrame) else matches.sparkSession.range(1).select(F.lit(n_compared).alias("compared"))
    row = row.crossJoin(F.broadcast(compared))
    return row.select(
        F.lit(n1).cast("long").alias("total_1"), F.lit(n2).cast("long").alias("total_2"), F.col("n").alias("matches"), F.col("high").alias("high_confidence"), (F.col("n") - F.col("high")).alias("low_confidence"),
        rest(n1, 1).cast("long").alias("unmatched_1"), rest(n2, 2).cast("long").alias("unmatched_2"), F.col("mean").alias("avg_confidence"),
        F.col("n" if strict else "compared").cast("long").alias("total_comparisons"), rate(n1).alias("match_rate_1"), rate(n2).alias("match_rate_2"),
    )


def classes(df: DataFrame, id_column: str, fields: list[str], alike: bool) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal fields: __number, __id (the smallest), __n and the fields; and number, id, first (whether it is the smallest) and record of every record.

    Not alike: every record is a class.
    """
    names = [f"__f{k}" for k in range(len(fields))]
    values = [F.col(f"`{f}`").cast("string").alias(c) for f, c in zip(fields, names, strict=True)]
    rows = stored(df.select(F.col(id_column).alias("__id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), *values, F.monotonically_increasing_id().alias("__number")), "records", keep=True)
    if alike:
        found = stored(rows.groupBy(*names).agg(F.min("__id").alias("__id"), F.count("*").alias("__n")).withColumn("__number", F.monotonically_increasing_id()), "classes", keep=True)
        same = reduce(Column.__and__, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in names])
        members = rows.drop("__number").alias("r").join(found.alias("c"), same).select(F.col("__number").alias("number"), F.col("r.__id").alias("id"), F.col("r.__id").eqNullSafe(F.col("c.__id")).alias("first"), "record")
    else:
        found = rows.withColumn("__n", F.lit(1).cast("long"))
        members = rows.select(F.col("__number").alias("number"), F.col("__id").alias("id"), F.lit(True).alias("first"), "record")
    return found.select("__number", "__id", "__n", *[F.col(c).alias(f) for c, f in zip(names, fields, strict=True)]), members


def expanded(matches: DataFrame, members1: DataFrame, members2: DataFrame, records: bool = True) -> DataFrame:
    """Matches of classes (number1, number2, n1, n2, ...) as those of their records: id2, id1, the other columns and, with records, record1 and record2.

    Members travel in lists of some hundreds, and each pair of lists is put out by one
    task: all pairs of records are made where they are put out, and none is shuffled.
    """
    total = matches.agg(F.sum(F.col("n1").cast("double") * F.col("n2"))).first()[0] or 0.0
    spread = int(max(1, -(-total // max(PAIRS * 20, total // TASKS))))
    member = F.struct("id", "record") if records else F.struct("id")
    scores = [c for c in matches.columns if c not in ("number1", "number2", "n1", "n2", "id1", "id2")]

    def lists(members: DataFrame, k: int) -> DataFrame:
        sizes = members.groupBy("number").agg(F.count("*").alias("__n"))
        many = sizes.where(F.col("__n") > LISTED)
        part = F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("__n") / LISTED), F.lit(1)))
        placed = members.join(many, "number", "left").withColumn("__part", part)
        return placed.groupBy(F.col("number").alias(f"number{k}"), F.col("__part").alias(f"part{k}")).agg(F.collect_list(member).alias(f"m{k}"))

    both = matches.join(lists(members1, 1), "number1").join(lists(members2, 2), "number2")
    if spread > 1:
        runs = F.transform(F.sequence(F.lit(1), F.size("m1"), F.lit(RUN)), lambda i: F.slice("m1", i, F.lit(RUN)))
        cut = both.repartition(spread, "number1", "part1", "number2", "part2").select(F.explode(runs).alias("m1"), "m2", *scores)
        both = cut.coalesce(spread)  # a step of its own: in one step Spark would hold all pairs of two lists at once
    one = both.select(F.explode("m1").alias("a"), "m2", *scores)
    out = [F.col("b.id").alias("id2"), F.col("a.id").alias("id1"), *scores, *[F.col(f"{x}.record").alias(f"record{k}") for x, k in (("a", 1), ("b", 2)) if records]]
    return one.select("a", F.explode("m2").alias("b"), *scores).select(*out)


def find_matches(d1: DataFrame, d2: DataFrame, id1: str, id2: str, config: LinkageConfig) -> LinkageResult:
    """The whole linkage.  matched has id1, id2, record1, record2 and the best algorithm's score.

    Records with equal fields are linked as one class where candidates depend on the
    fields alone; the matches of classes are stored, and all results are read from them.
    """
    if d1 is None or d2 is None:
        raise ValueError("two tables are needed")
    n1, n2 = d1.count(), d2.count()
    on = config.block_on or [(m.source, m.target) for m in config.mappings]
    by_keys = config.use_blocking and config.method in ("keys", "adaptive") and config.max_block is None
    alike = (by_keys or not config.use_blocking) and config.cardinality != "stable_one_to_one"
    strategies = list(config.strategies or (blocking.select_strategies(d1, [a for a, _ in on], id1, config.strict) if by_keys else ()))
    fields = [list(dict.fromkeys([*[getattr(m, k) for m in config.mappings], *[f[side] for f in on]])) for side, k in enumerate(("source", "target"))]
    with scratch(d1.sparkSession):  # candidates and normal forms go when the matches are stored
        k1, members1 = classes(d1, id1, fields[0], alike)
        same = d1 is d2 and (id1, fields[0]) == (id2, fields[1])
        k2, members2 = (k1, members1) if same else classes(d2, id2, fields[1], alike)
        if by_keys:
            found, n_compared = score_blocks(k1, k2, config, strategies)
        else:
            pairs, n_compared = candidates(k1, k2, "__number", "__number", config), n1 * n2
            if config.use_blocking:
                pairs = stored(pairs, "pairs")
                n_compared = pairs.count()
                # few bytes but much work each: dealt out by number, not by size
                pairs = pairs.repartition(max(1, -(-n_compared // max(PAIRS, n_compared // TASKS))))
            found = score_pairs(pairs, k1, k2, "__number", "__number", config)
        if config.cardinality == "stable_one_to_one":
            found = stored(found, "found")  # read in every round
        ids = lambda k, df: df.select(F.col("__number").alias(f"number{k}"), F.col("__id").alias(f"id{k}"), F.col("__n").alias(f"n{k}"))
        found = found.withColumnsRenamed({"id1": "number1", "id2": "number2"}).join(ids(1, k1), "number1").join(ids(2, k2), "number2")
        matches = with_cardinality(found, config.cardinality)
        # of a class whose partner takes one record, that is the one with the smallest id
        single = {k: config.cardinality in kinds for k, kinds in ((1, ("one_to_one", "one_to_many", "stable_one_to_one")), (2, ("one_to_one", "many_to_one", "stable_one_to_one")))}
        matches = stored(matches.withColumns({f"n{k}": F.lit(1).cast("long") for k in (1, 2) if single[k]}), "matches", keep=True)
    members1, members2 = (m.where("first") if single[k] else m for k, m in ((1, members1), (2, members2)))
    hit = lambda m, k: m.join(matches.select(F.col(f"number{k}").alias("number")).distinct(), "number", "left_semi").select(F.col("id").alias("__m"))
    full = expanded(matches, members1, members2)
    few = lambda made: expanded(made(matches), members1, members2, records=False)
    stats = statistics(matches, n1, n2, n_compared, config.strict)
    left, right = unmatched(d1, id1, hit(members1, 1), config.strict), unmatched(d2, id2, hit(members2, 2), config.strict)
    return LinkageResult(full, left, right, stats, {"threshold": config.threshold, "algorithms": [a.kind for a in config.enabled()]}, few)
