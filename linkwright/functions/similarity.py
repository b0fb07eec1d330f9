"""Similarity of two texts on a scale of 0 to 100.

All but Jaro-Winkler and the sequence ratio are native; those two have no
built-in with the wanted definition and run as one Arrow UDF over both.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as T

SOUNDEX_FROM, SOUNDEX_TO = "BFPVCGJKQSXZDTLMNR", "111122222222334556"
# Endings that variants of a word may have, taken off in this order.
ENDINGS = ["LAR", "LAR", "DA", "TA", "NI", "GA", "DAN", "TAN"]
FUZZY_METHODS = ("levenshtein", "jaro_winkler", "sequence", "combined")
PHONETIC_METHODS = ("soundex", "metaphone", "uzbek_phonetic")


def empty_cases(a: Column, b: Column, otherwise: Column) -> Column:
    """100 for two empty texts, 0 for one."""
    return F.when((a == "") & (b == ""), 100.0).when((a == "") | (b == ""), 0.0).otherwise(otherwise)


def exact(a: Column, b: Column) -> Column:
    return F.when(a == b, 100.0).otherwise(0.0)


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return empty_cases(a, b, (F.lit(1.0) - F.levenshtein(a, b) / longest) * 100.0)


def matrix_similarity(a: Column, b: Column) -> Column:
    """0 to 1 as a float: 1 - distance / longest length."""
    return (F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))).cast("float")


#: Letters that are counted, up to so many of each.
LETTERS, COUNTED = ("etaoinshrdlucm", " fgypbvkjxqzw"), 4


def signature(c: Column) -> list[Column]:
    """Four longs of a text for fewest_edits(): counts of letters in unary, and its bigrams as 128 hashed bits."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    text, out = F.coalesce(c, F.lit("")), []
    for letters in LETTERS:
        counts = [F.least(F.length(text) - F.length(F.replace(text, F.lit(x), F.lit(""))), F.lit(COUNTED)) for x in letters]
        out.append(sum((bit(n) - 1) * (1 << (COUNTED * k)) for k, n in enumerate(counts)))
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    hashed = F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(2))), F.lit(128)))
    for k in range(2):
        found = F.aggregate(F.transform(F.filter(hashed, _half(k)), lambda v: bit(v % 64)), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
        out.append(F.when(F.length(text) > 1, found).otherwise(F.lit(0).cast("long")))
    return out


def _half(k: int):
    return lambda v: F.floor(v / 64) == k


def missing(a: list[Column], b: list[Column]) -> Column:
    """Bits of a that b lacks."""
    return sum(F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in zip(a, b, strict=True))


def fewest_edits(a: list[Column], b: list[Column], lengths: tuple[Column, Column]) -> Column:
    """A lower bound of the Levenshtein distance by signatures: an edit takes one letter of either text at most, and two bigrams."""
    letters = F.greatest(missing(a[:2], b[:2]), missing(b[:2], a[:2]))
    grams = F.greatest(missing(a[2:], b[2:]), missing(b[2:], a[2:]))
    return F.greatest(letters, F.ceil(grams / 2).cast("int"), F.abs(lengths[0] - lengths[1]))


def jaro_value(a: str, b: str) -> float:
    """Jaro similarity, 0 to 1, with half transpositions counted as halves."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left: list[str] = []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == x), None)
        if j is not None:
            free[j] = False
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, unused in zip(b, free, strict=True) if not unused]
    m, out_of_order = len(left), sum(x != y for x, y in zip(left, right, strict=True))
    return (m / len(a) + m / len(b) + (m - out_of_order / 2) / m) / 3


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro with the prefix bonus at every level of similarity."""
    j, prefix = jaro_value(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return j + 0.1 * prefix * (1 - j)


def sequence_value(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(StructType([StructField("jaro_winkler", DoubleType()), StructField("sequence", DoubleType())]))
def _slow(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = [(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)]
    seen: dict = {None: (None, None)}  # equal pairs are scored once a batch
    for p in pairs:
        if p not in seen:
            seen[p] = (100 * jaro_winkler_value(*p), 100 * sequence_value(*p))
    return pd.DataFrame([seen[p] for p in pairs], columns=["jaro_winkler", "sequence"], dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    return empty_cases(a, b, _slow(a, b)["jaro_winkler"])


def sequence(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio; the order of the arguments matters."""
    return empty_cases(a, b, _slow(a, b)["sequence"])


def combined(a: Column, b: Column, least: float | Column | None = None, spoken: Column | None = None) -> Column:
    """0.4 Levenshtein + 0.4 Jaro-Winkler + 0.2 sequence.

    least: scores that cannot reach it may come out lower, as their bound
    0.4 Levenshtein - then only pairs that can reach it are sent to Python; with
    spoken, those that can reach it when raised toward that (null: not raised).
    """
    lev = levenshtein(a, b)
    if least is None:
        slow = _slow(a, b)
        return empty_cases(a, b, 0.4 * lev + 0.4 * slow["jaro_winkler"] + 0.2 * slow["sequence"])
    most = most_combined(a, b, lev)
    if spoken is not None:
        most += F.coalesce(F.greatest(F.least((spoken - most) * 0.3, F.lit(15.0)), F.lit(0.0)), F.lit(0.0))
    able = F.coalesce((most >= least - 1e-6) & (a != b), F.lit(False))
    slow = _slow(F.when(able, a), F.when(able, b))
    rest = F.when(a == b, 60.0).otherwise(F.coalesce(0.4 * slow["jaro_winkler"] + 0.2 * slow["sequence"], F.lit(0.0)))
    return empty_cases(a, b, 0.4 * lev + rest)


def most_combined(a: Column, b: Column, lev: Column) -> Column:
    """What the combined score is at most, by the Levenshtein one and the letters of both.

    Jaro matches no more letters than either text has of those in the other one; the
    sequence ratio's blocks are a common subsequence, which leaves out half the edits
    of both lengths at least.
    """
    la, lb = (F.greatest(F.length(t), F.lit(1)) for t in (a, b))
    edits = (F.lit(100.0) - lev) / 100.0 * F.greatest(la, lb)
    found = F.least(*[F.length(t) - F.length(F.call_function("translate", t, letters, F.lit(""))) for t, letters in ((a, b), (b, a))])
    jaro = (found / la + found / lb + 1.0) / 3.0
    same = sum(F.when(F.substring(a, 1, n) == F.substring(b, 1, n), 0.1).otherwise(0.0) for n in range(1, 5))
    return 0.4 * lev + 40.0 * (jaro + same * (1.0 - jaro)) + 20.0 * (1.0 - edits / (la + lb))


def key_distance(x: Column, y: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty keys, 1 for one."""
    return F.when((x == "") & (y == ""), 0.0).when((x == "") | (y == ""), 1.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def soundex_code(c: Column) -> Column:
    """First character kept, then digits; other characters don't part equal digits.  Empty text: 0000."""
    u = F.upper(T.trimmed(c))
    tail = F.regexp_replace(F.regexp_replace(u, "(?s)^.", ""), f"[^{SOUNDEX_FROM}]", "")
    code = F.regexp_replace(F.concat(F.substring(u, 1, 1), F.translate(tail, SOUNDEX_FROM, SOUNDEX_TO)), r"(\d)\1+", "$1")
    return F.substring(F.concat(code, F.lit("0000")), 1, 4)


def soundex(a: Column, b: Column) -> Column:
    x, y = soundex_code(a), soundex_code(b)
    return sum(F.when(F.substring(x, i, 1) == F.substring(y, i, 1), 25.0).otherwise(0.0) for i in range(1, 5))


def metaphone_code(c: Column) -> Column:
    u = F.upper(c)
    first = F.regexp_extract(u, "^[AEIOUY]", 0)
    marked = F.replace(F.regexp_replace(u, "C(?=[HI])", "#"), F.lit("X"), F.lit("KS"))
    return F.concat(first, F.translate(F.regexp_replace(marked, "[^BCDFGJKLMNPQRSTVZ#]", ""), "CDVGQNZ#", "KTFJKMSX"))


def metaphone(a: Column, b: Column) -> Column:
    return levenshtein(metaphone_code(a), metaphone_code(b))


def _root(c: Column) -> Column:
    for ending in ENDINGS:
        c = F.regexp_replace(c, ending + "$", "")
    return c


def word_rule(a: Column, b: Column) -> Column:
    """90 for variants of one root, else the Levenshtein similarity."""
    x, y = _root(a), _root(b)
    variant = (x != "") & (y != "") & (levenshtein(x, y) >= 80)
    return F.when(variant, 90.0).otherwise(levenshtein(a, b))


def uzbek_phonetic(a: Column, b: Column, compose: bool = True, keys: tuple[Column, Column] | None = None) -> Column:
    """Of phonetic forms: 100 for equal keys, else the better of key distance and the word rule.  keys: their phonetic keys, where they are columns already."""
    u, v = keys or (T.phonetic_key(a, compose), T.phonetic_key(b, compose))
    return F.when(u == v, 100.0).otherwise(F.greatest((F.lit(1.0) - key_distance(u, v)) * 100.0, word_rule(a, b)))


def boosted(score: Column, a: Column, b: Column, compose: bool = True) -> Column:
    """A fuzzy score raised toward the phonetic one where both raw texts are Uzbek."""
    spoken = (F.lit(1.0) - T.phonetic_distance(a, b, compose)) * 100.0
    up = F.least(score + F.least((spoken - score) * 0.3, F.lit(15.0)), F.lit(100.0))
    return F.when(T.is_uzbek(a) & T.is_uzbek(b) & (spoken > score), up).otherwise(score)


def confidence(score: Column, penalty: float) -> Column:
    """The score, less a penalty unless it is full."""
    return F.when(score == 100.0, 100.0).otherwise(F.greatest(score - penalty, F.lit(0.0))) if penalty else score
