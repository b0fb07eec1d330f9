"""Text functions and similarities against fixed values, a plain version, and general properties."""

import difflib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkwright.functions import similarity as S
from linkwright.functions import text as T

C = F.col


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *columns).collect())]


def test_transliteration(spark):
    got = values(spark, ["Ташкент", "Toshkent", "центр", "Ўзбекистон", "ҚЎҚОН шаҳри", "объект", "o'g'il", "  A,b  c! "], T.normalized(C("t"), aggressive=True))
    assert [g[0] for g in got] == ["tashkent", "tashkent", "centr", "ozbekiston", "qoqon shahri", "obekt", "ogil", "ab c"]
    assert values(spark, ["a-b,c"], T.normalized(C("t")))[0][0] == "a b c"


def test_composition_only_where_needed(spark):
    got = values(spark, ["plain", "é", None, "й"], T.nfc(C("t")))
    assert [g[0] for g in got] == ["plain", unicodedata.normalize("NFC", "é"), None, "й"]


def test_uzbek_detection(spark):
    texts = ["John", "O'Brien", "мир", "tuman 5", "Samarkand city", "", None, "tumanly"]
    assert [v[0] for v in values(spark, texts, T.is_uzbek(C("t")))] == [False, True, True, True, True, False, False, False]


@pytest.mark.parametrize(("text", "code"), [("Pfister", "P123"), ("Tymczak", "T520"), ("Ashcraft", "A261"), ("1BOB", "1000"), ("", "0000")])
def test_soundex(spark, text, code):
    assert values(spark, [text], S.soundex_code(C("t"))) == [(code,)]


def test_metaphone_and_keys(spark):
    assert [v[0] for v in values(spark, ["CHICAGO", "XENON", "APPLE", "PHONE", "yes"], S.metaphone_code(C("t")))] == ["XKJ", "KSMM", "APPL", "PM", "YS"]
    assert values(spark, ["Muhammad"], T.phonetic_key(C("t")))[0][0] == "muhamad"


def jaro(a, b):
    """The textbook procedure, without rounding transpositions down."""
    if a == b:
        return 1.0
    window, ma, mb = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(i + window + 1, len(b))):
            if not mb[j] and b[j] == x:
                ma[i] = mb[j] = True
                break
    m = sum(ma)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip([x for x, k in zip(a, ma, strict=True) if k], [y for y, k in zip(b, mb, strict=True) if k], strict=True))
    return (m / len(a) + m / len(b) + (m - t / 2) / m) / 3


words = st.text(alphabet="abcdeй'", min_size=1, max_size=12)


@given(words, words)
@settings(max_examples=300, deadline=None)
def test_jaro_winkler_properties(a, b):
    assert S.jaro_value(a, b) == pytest.approx(jaro(a, b))
    assert 0 <= S.jaro_winkler_value(a, b) <= 1 + 1e-9 and S.jaro_winkler_value(a, a) == 1
    assert S.sequence_value(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_jaro_winkler_values():
    assert S.jaro_value("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert S.jaro_winkler_value("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_value("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)


def test_scores_lie_between_bounds(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abdoш'у ") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    df = spark.createDataFrame(list(zip(texts, reversed(texts), strict=True)), "a string, b string")
    kinds = [S.levenshtein, S.jaro_winkler, S.sequence, S.combined, S.soundex, S.metaphone, S.uzbek_phonetic, S.exact]
    for f in kinds:
        row = df.agg(F.min(f(C("a"), C("b"))), F.max(f(C("a"), C("b"))), F.min(f(C("a"), C("a")))).first()
        assert 0 <= row[0] and row[1] <= 100.000001 and row[2] == pytest.approx(100), f.__name__
    both = df.select(S.combined(C("a"), C("b")).alias("x"), S.combined(C("a"), C("b"), least=70.0).alias("y"))
    assert both.where("x >= 70 AND abs(x - y) > 1e-9").count() == 0 and both.where("y > x + 1e-9").count() == 0


def test_boost_is_limited(spark):
    df = spark.createDataFrame([("Тошкент шаҳри", "Toshkent shahri'")], "a string, b string")
    raw, up = df.select(F.lit(20.0).alias("r"), S.boosted(F.lit(20.0), C("a"), C("b")).alias("u")).first()
    assert raw < up <= raw + 15


def test_character_variations(spark):
    got = dict(zip("ohz7", [v[0] for v in values(spark, list("ohz7"), T.character_variations(C("t")))], strict=True))
    assert set(got["o"]) >= {"o", "u", "ў", "о"} and got["7"] == ["7"] and set(got["h"]) >= {"h", "ҳ", "x"}
