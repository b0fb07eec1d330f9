"""Scores of record pairs: fields, weights, the boost, and the best algorithm."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

#: Confidence from which a field or a record counts as matched; boost a matched field, and its limit.
MATCHED, BOOST, MAX_BOOST = 50.0, 10.0, 30.0
PENALTY = {"exact": 0.0, "fuzzy": 5.0, "phonetic": 10.0}
#: The order that decides ties.
ORDER = ("exact", "fuzzy", "phonetic")


@dataclass(frozen=True)
class FieldMapping:
    source: str
    target: str
    weight: float = 1.0

    def __post_init__(self):
        if not 0.1 <= self.weight <= 1.0:
            raise ValueError("a weight lies between 0.1 and 1.0")


@dataclass(frozen=True)
class Algorithm:
    kind: str
    params: dict = field(default_factory=dict)
    enabled: bool = True

    def __post_init__(self):
        if self.kind not in ORDER and self.kind not in REGISTRY:
            raise ValueError(f"no algorithm {self.kind}")


#: Plugged-in algorithms: name -> function of (text, text, params) that gives (form a, form b, similarity).
REGISTRY: dict = {}


def register(name: str, score) -> None:
    """Add an algorithm; score(a, b, params) returns a similarity Column on raw trimmed texts."""
    REGISTRY[name] = score


def cell(c: Column, strict: bool) -> Column:
    """A cell as text; strict compares null as the text nan."""
    out = T.trimmed(c.cast("string"))
    return F.coalesce(out, F.lit("nan")) if strict else out


def prepared(df: DataFrame, side: str, fields: list[str], algorithms: list[Algorithm], strict: bool = False) -> DataFrame:
    """df with what the algorithms compare, once a record: columns side + name + number of the field.

    raw text, uz (Uzbek or not), sk (spoken key of the raw text), ex, fz and ph
    (exact, fuzzy and phonetic form) and pk (spoken key of ph).  Later steps read
    columns of earlier ones, so no normal form is worked out twice.
    """
    kinds = {a.kind: a.params for a in algorithms}
    compose = all(p.get("compose", True) for p in kinds.values())
    name = lambda k, i: f"{side}{k}{i}"
    numbered = range(len(fields))
    out = df.withColumns({name("raw", i): cell(F.col(f"`{f}`"), strict) for i, f in enumerate(fields)})
    steps = {}
    for i in numbered:
        raw = F.col(name("raw", i))
        steps |= {name("uz", i): T.is_uzbek(raw), name("na", i): T.normalized(raw, True, compose), name("ng", i): T.normalized(raw, False, compose)}
    out = out.withColumns(steps)
    steps = {}
    for i in numbered:
        raw, uz, hard, soft = (F.col(name(k, i)) for k in ("raw", "uz", "na", "ng"))
        steps[name("sk", i)] = T.collapsed(hard)
        if "exact" in kinds:
            steps[name("ex", i)] = _form(T.exact_form, raw, kinds["exact"], uz, soft, compose)
        if "fuzzy" in kinds:
            steps[name("fz", i)] = _form(T.fuzzy_form, raw, kinds["fuzzy"], uz, hard, compose)
        if "phonetic" in kinds:
            steps[name("ph", i)] = _form(T.phonetic_form, raw, kinds["phonetic"], uz, hard, compose)
    out = out.withColumns(steps)
    return out.withColumns({name("pk", i): T.phonetic_key(F.col(name("ph", i)), False) for i in numbered}) if "phonetic" in kinds else out


def _form(form, raw: Column, params: dict, uzbek: Column, normal: Column, compose: bool) -> Column:
    more = {} if form is T.phonetic_form else {"case_sensitive": params.get("case_sensitive", False)}
    return form(raw, normalize=params.get("normalize_uzbek", True), compose=compose, known=(uzbek, normal), **more)


def prepared_columns(side: str, i: int, algorithms: list[Algorithm]) -> list[str]:
    """The columns of prepared() that a pair needs."""
    kinds = {a.kind for a in algorithms}
    wanted = ["raw"] + ["uz", "sk", "fz"] * ("fuzzy" in kinds) + ["ex"] * ("exact" in kinds) + ["ph", "pk"] * ("phonetic" in kinds)
    return [f"{side}{k}{i}" for k in wanted]


def loss(algorithms: list[Algorithm]) -> float | None:
    """The share of its score that a field loses at least with all its characters different, where only exact and Levenshtein scores (also combined ones) are compared; else None."""
    kinds = {a.kind: a.params for a in algorithms}
    if set(kinds) - {"exact", "fuzzy"} or kinds.get("fuzzy", {}).get("method", "combined") not in ("levenshtein", "combined"):
        return None
    return 0.4 if kinds.get("fuzzy", {"method": "levenshtein"}).get("method") != "levenshtein" else 1.0


def scored(pairs: DataFrame, mappings: list[FieldMapping], algorithms: list[Algorithm], strict: bool = False, least: float = 0.0) -> DataFrame:
    """Pairs of prepared records (sides a and b) with the best algorithm's similarity, confidence, matched_fields, algorithm and field_results.

    Of the algorithms with a similarity above 0 the highest one is best, the earlier
    of equals.  Numbers come first; names and results by field are put together
    only for pairs whose confidence reaches least.  Of one field, combined scores are
    worked out only where they can be the best and reach it.
    """
    fields = range(len(mappings))
    both = lambda k, i: (F.col(f"a{k}{i}"), F.col(f"b{k}{i}"))
    first, spoken, asked, last, record = {}, {}, {}, {}, {}
    for k, a in enumerate(algorithms):
        p = a.params
        for i in fields:
            c = f"f{k}_{i}"
            if a.kind == "exact":
                x, y = both("ex", i)
                first[c] = S.empty_cases(x, y, S.exact(x, y))
            elif a.kind == "fuzzy":
                x, y = both("fz", i)
                method = p.get("method") if p.get("method") in S.FUZZY_METHODS else "combined"
                d, uzbek = F.col(f"d{k}_{i}"), p.get("normalize_uzbek", True)
                if method == "combined" and len(mappings) == 1:
                    others = [F.coalesce(f"f{n}_{i}", F.lit(0.0)) for n in range(len(algorithms)) if n != k]
                    asked[c] = S.combined(x, y, F.greatest(F.lit(least - BOOST), F.lit(0.0), *others), d if uzbek else None)
                else:
                    first[c] = getattr(S, method)(x, y)
                if uzbek:
                    u, v = both("uz", i)
                    spoken[f"d{k}_{i}"] = F.when(u & v, 100.0 - S.key_distance(*both("sk", i)) * 100.0)
                    last[c] = F.when(d > F.col(c), F.least(F.col(c) + F.least((d - F.col(c)) * 0.3, F.lit(15.0)), F.lit(100.0))).otherwise(F.col(c))
            elif a.kind == "phonetic":
                x, y = both("ph", i)
                method = p.get("method") if p.get("method") in S.PHONETIC_METHODS else "uzbek_phonetic"
                if method == "uzbek_phonetic":
                    score = S.uzbek_phonetic(x, y, keys=both("pk", i)) if p.get("normalize_uzbek", True) else S.word_rule(x, y)
                else:
                    score = getattr(S, method)(x, y)
                score = S.empty_cases(x, y, score)
                first[c] = score if strict else F.when((x != "") | (y != ""), score)
            else:
                first[c] = REGISTRY[a.kind](*both("raw", i), p)
    out = pairs.withColumns(first)
    out = out.withColumns(spoken) if spoken else out
    out = out.withColumns(asked) if asked else out
    out = out.withColumns(last) if last else out
    for k, a in enumerate(algorithms):
        for i in fields:
            x, y = both("raw", i)
            record[f"f{k}_{i}"] = F.when((x != "") & (y != ""), F.col(f"f{k}_{i}"))
    out = out.withColumns(record)
    out = out.withColumns({n: c for k, a in enumerate(algorithms) for n, c in zip((f"sim{k}", f"con{k}"), _totals(k, a.kind, mappings), strict=True)})
    top = F.greatest(*[F.col(f"sim{k}") for k in range(len(algorithms))], F.lit(0.0))
    pick = lambda values, by: _chain([(by == k, v) for k, v in enumerate(values)])
    out = out.withColumn("best", _chain([(F.col(f"sim{k}") == top, F.lit(k)) for k in range(len(algorithms))]))
    numbers = F.struct(top.alias("similarity"), pick([F.col(f"con{k}") for k in range(len(algorithms))], F.col("best")).alias("confidence"), "best", *[pick([F.col(f"f{k}_{i}") for k in range(len(algorithms))], F.col("best")).alias(f"f{i}") for i in fields])
    # the one-element array keeps the filters above the numbers: pushed below, they would repeat every step's expressions
    kept = out.select("id1", "id2", F.explode(F.array(numbers)).alias("m")).where((F.col("m.similarity") > 0) & (F.col("m.confidence") >= least))
    kinds = [a.kind for a in algorithms]
    own = [(m.source, F.col(f"m.f{i}"), pick([S.confidence(F.col(f"m.f{i}"), PENALTY.get(kind, 0.0)) for kind in kinds], F.col("m.best")), float(m.weight)) for i, m in enumerate(mappings)]
    matched = F.array_compact(F.array(*[F.when(c >= MATCHED, F.lit(name)) for name, _, c, _ in own]))
    last = {name: F.when(f.isNotNull(), F.struct(F.lit(name).alias("key"), F.struct(f.alias("similarity"), c.alias("confidence"), F.lit(w).alias("weight"), (f * w).alias("weighted_score")).alias("value"))) for name, f, c, w in own}
    results = F.map_from_entries(F.array_compact(F.array(*last.values())))  # a field mapped twice keeps the later result
    return kept.select("id1", "id2", "m.similarity", "m.confidence", matched.alias("matched_fields"), pick([F.lit(kind) for kind in kinds], F.col("m.best")).alias("algorithm"), results.alias("field_results"))


def _chain(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds."""
    out = F.when(*cases[0])
    for holds, value in cases[1:]:
        out = out.when(holds, value)
    return out


def _totals(k: int, kind: str, mappings: list[FieldMapping]) -> tuple[Column, Column]:
    """Similarity and confidence of an algorithm: the weighted mean over filled fields, raised for each matched one."""
    each = [(F.col(f"f{k}_{i}"), S.confidence(F.col(f"f{k}_{i}"), PENALTY.get(kind, 0.0)), float(m.weight)) for i, m in enumerate(mappings)]
    weights = sum(F.when(s.isNotNull(), w).otherwise(0.0) for s, _, w in each)
    total = sum(F.coalesce(s * w, F.lit(0.0)) for s, _, w in each)
    similarity = F.when(weights > 0, total / weights).otherwise(0.0)
    n = sum(F.when(c >= MATCHED, 1.0).otherwise(0.0) for _, c, _ in each)
    return similarity, F.when(weights > 0, F.least(similarity + F.least(F.lit(BOOST) * n, F.lit(MAX_BOOST)), F.lit(100.0))).otherwise(0.0)
