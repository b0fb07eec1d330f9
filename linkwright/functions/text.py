"""Uzbek Cyrillic/Latin text normalization as native column expressions.

Every function takes and returns a Column; only nfc() leaves the JVM, and only
for values with a character outside ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The letters, digraphs and Latin rules of the transliteration.
CYRILLIC = "абвгдежзийклмнопрстуфхыэқҳъь"
LATIN = "abvgdejziyklmnoprstufxieqh"
DIGRAPHS = [("ё", "yo"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya"), ("ў", "o'"), ("ғ", "g'")]
LATIN_RULES = [("o'", "o"), ("g'", "g"), ("tosh", "tash"), ("kh", "x"), ("ts", "c"), ("iy", "i"), ("ey", "e")]
ADMIN_WORDS = ["мчж", "mchj", "махалла", "mahalla", "туман", "tuman", "район", "rayon", "вилоят", "viloyat", "область", "oblast"]
PLACES = ["tashkent", "toshkent", "ташкент", "samarkand", "самарканд", "bukhara", "бухара", "andijan", "андижан", "namangan", "наманган"]
# Characters that sound alike; a character's variations are these and the Cyrillic letters that map to it.
SIMILAR = {
    "i": ["i", "y", "ы"], "y": ["y", "i", "ы"], "ы": ["ы", "i", "y"], "o": ["o", "u", "ў"], "u": ["u", "o", "ў"], "ў": ["ў", "o", "u"],
    "k": ["k", "q", "қ"], "q": ["q", "k", "қ"], "қ": ["қ", "k", "q"], "g": ["g", "ғ"], "ғ": ["ғ", "g"], "h": ["h", "ҳ", "x"],
    "ҳ": ["ҳ", "h", "x"], "x": ["x", "h", "ҳ"], "s": ["s", "z"], "z": ["z", "s"], "b": ["b", "p"], "p": ["p", "b"],
    "d": ["d", "t"], "t": ["t", "d"], "v": ["v", "w"], "w": ["w", "v"],
}


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """Canonical composition.  ASCII values are returned as they are; only the others are sent to Python."""
    wide = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfc(wide), c)


def is_uzbek(c: Column) -> Column:
    """Any mapped Cyrillic letter or apostrophe, an administrative word, or a place name."""
    low = F.lower(c)
    words = r"(?U)(^|\s)(" + "|".join(ADMIN_WORDS) + r")(\s|$)"
    return F.coalesce(c.rlike("[А-Яа-яЁёЎўҚқҒғҲҳ']") | low.rlike(words) | low.rlike("|".join(PLACES)), F.lit(False))


def cyrillic_to_latin(c: Column) -> Column:
    """Of lower-case text; the hard and the soft sign disappear."""
    out = F.translate(c, CYRILLIC, LATIN)
    for a, b in DIGRAPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def latin_rules(c: Column) -> Column:
    for a, b in LATIN_RULES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalized(c: Column, aggressive: bool = False, compose: bool = True) -> Column:
    """The normal form; aggressive drops punctuation, else it becomes a space."""
    low = F.lower(trimmed(c))
    low = nfc(low) if compose else low
    out = F.regexp_replace(latin_rules(cyrillic_to_latin(low)), r"(?U)[^\w\s]", "" if aggressive else " ")
    return trimmed(squeezed(out))


def collapsed(c: Column) -> Column:
    """Equal characters in a row become one."""
    return F.regexp_replace(c, r"(?s)(.)\1+", "$1")


def phonetic_key(c: Column, compose: bool = True) -> Column:
    return collapsed(normalized(c, aggressive=True, compose=compose))


def phonetic_distance(a: Column, b: Column, compose: bool = True) -> Column:
    """Levenshtein distance of the phonetic keys over the longer one's length."""
    from .similarity import key_distance

    return key_distance(phonetic_key(a, compose), phonetic_key(b, compose))


def character_variations(c: Column) -> Column:
    """Characters that may stand for a character, sorted."""
    reverse: dict[str, list[str]] = {}
    for a, b in [*zip(CYRILLIC, LATIN, strict=False), *DIGRAPHS]:
        reverse.setdefault(b, []).append(a)
    low = F.lower(c)
    names = sorted(SIMILAR.keys() | {k for k in reverse if len(k) == 1})
    entries = {k: sorted({k, *SIMILAR.get(k, k), *reverse.get(k, [])}) for k in names}
    table = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, low), F.array(low))


#: (is_uzbek, normalized) of the same text, where they are known already.
Known = tuple[Column, Column]


def exact_form(c: Column, case_sensitive: bool = False, normalize: bool = True, compose: bool = True, known: Known | None = None) -> Column:
    """What the exact matcher compares."""
    plain = trimmed(c)
    if not normalize:
        return F.lower(plain)
    uzbek, normal = known or (is_uzbek(plain), normalized(plain, compose=compose))
    other = squeezed(nfc(plain) if compose else plain)
    return F.when(uzbek, normal).otherwise(other if case_sensitive else F.lower(other))


def fuzzy_form(c: Column, case_sensitive: bool = False, normalize: bool = True, compose: bool = True, known: Known | None = None) -> Column:
    """What the fuzzy matcher compares."""
    plain = trimmed(c)
    plain = plain if case_sensitive and normalize else F.lower(plain)
    if not normalize:
        return plain
    uzbek, normal = known or (is_uzbek(plain), normalized(plain, aggressive=True, compose=compose))
    other = squeezed(F.regexp_replace(nfc(plain) if compose else plain, r"(?U)[^\w\s]", " "))
    return trimmed(F.when(uzbek, normal).otherwise(other))


def phonetic_form(c: Column, normalize: bool = True, compose: bool = True, known: Known | None = None) -> Column:
    """What the phonetic matcher compares: upper-case letters only."""
    up = F.upper(trimmed(c))
    text = nfc(up) if compose else up
    if normalize:
        uzbek, normal = known or (is_uzbek(up), normalized(up, aggressive=True, compose=compose))
        text = F.when(uzbek, F.upper(normal)).otherwise(text)
    return F.regexp_replace(text, "[^A-ZА-ЯЎҒҚҲ]", "")
