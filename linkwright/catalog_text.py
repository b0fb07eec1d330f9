"""Queries over text functions: normal forms, keys, codes, similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import similarity as S
from .functions import text as T
from .registry import query, table

#: Latin letters with marks, and the plain ones that stand for them in titles.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜàáâãäåçèéêëìíîïñòóôõöùúûüß"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUaaaaaaceeeeiiiinooooouuuus"
#: A Cyrillic spelling of the titles.
TO, FROM = "абцдегҳиклмнопрстуз", "abcdeghiklmnoprstuz"


def title(text):
    """The first four words of a text, letters without marks."""
    # five pieces hold them, six after white space at the beginning: the rest stays whole
    words = F.filter(F.split(text, r"\s+", 6), lambda w: w != "")
    return F.translate(F.array_join(F.slice(words, 1, 4), " "), MARKED, PLAIN)


def sql_title(text: str = "text") -> str:
    return rf"translate(array_to_string(list_slice([x for x in regexp_split_to_array({text}, '\s+') if x <> ''], 1, 4), ' '), '{MARKED}', '{PLAIN}')"


def titles(spark, sf_dir):
    """doc_id and title of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", title(F.col("text")).alias("title"))


TITLES = f"(SELECT doc_id, {sql_title()} AS title FROM documents)"


def names(spark, sf_dir):
    """The titles of all documents: plain, in Cyrillic, and with signs."""
    odd = F.concat(F.lit(" O'"), F.upper("title"), F.lit(",  g'oz 12 "))
    return titles(spark, sf_dir).select("doc_id", "title", F.translate(F.lower("title"), FROM, TO).alias("cyr"), odd.alias("odd"))


NAMES = f"(SELECT doc_id, title, translate(lower(title), '{FROM}', '{TO}') AS cyr, concat(' O''', upper(title), ',  g''oz 12 ') AS odd FROM {TITLES}) n"


# ---- the SQL of the functions


def sql_normal(x: str, aggressive: bool = False) -> str:
    e = f"translate(nfc_normalize(lower(trim({x}))), '{T.CYRILLIC}', '{T.LATIN}')"
    for a, b in [*T.DIGRAPHS, *T.LATIN_RULES]:
        e = f"replace({e}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace(chr(39), chr(39) * 2)}')"
    rep = "" if aggressive else " "
    return rf"trim(regexp_replace(regexp_replace({e}, '[^\p{{L}}\p{{N}}_\s]', '{rep}', 'g'), '\s+', ' ', 'g'))"


def sql_uzbek(x: str) -> str:
    return f"(regexp_matches({x}, '[А-Яа-яЁёЎўҚқҒғҲҳ'']') OR regexp_matches(lower({x}), '(^|\\s)({'|'.join(T.ADMIN_WORDS)})(\\s|$)') OR regexp_matches(lower({x}), '{'|'.join(T.PLACES)}'))"


def sql_collapsed(x: str) -> str:
    return f"array_to_string([CASE WHEN i = 1 OR ({x})[i] <> ({x})[i - 1] THEN ({x})[i] ELSE '' END for i in range(1, length({x}) + 1)], '')"


def sql_soundex(x: str) -> str:
    u = f"upper(trim({x}))"
    raw = f"concat({u}[1], translate(regexp_replace(substring({u}, 2), '[^{S.SOUNDEX_FROM}]', '', 'g'), '{S.SOUNDEX_FROM}', '{S.SOUNDEX_TO}'))"
    same = f"({raw})[i] = ({raw})[i - 1] AND regexp_matches(({raw})[i], '[0-9]')"
    return f"substring(concat(array_to_string([CASE WHEN i > 1 AND {same} THEN '' ELSE ({raw})[i] END for i in range(1, length({raw}) + 1)], ''), '0000'), 1, 4)"


def sql_metaphone(x: str) -> str:
    u = f"upper({x})"
    marked = f"replace(regexp_replace({u}, 'C([HI])', '#\\1', 'g'), 'X', 'KS')"
    return f"concat(regexp_extract({u}, '^[AEIOUY]'), translate(regexp_replace({marked}, '[^BCDFGJKLMNPQRSTVZ#]', '', 'g'), 'CDVGQNZ#', 'KTFJKMSX'))"


def sql_levenshtein(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE (1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) * 100.0::DOUBLE END"


def sql_phonetic_form(x: str) -> str:
    u = f"upper(trim({x}))"
    return f"regexp_replace(CASE WHEN {sql_uzbek(u)} THEN upper({sql_normal(u, True)}) ELSE nfc_normalize({u}) END, '[^A-ZА-ЯЎҒҚҲ]', '', 'g')"


def sql_fuzzy_form(x: str) -> str:
    low = f"lower(trim({x}))"
    other = rf"regexp_replace(regexp_replace(nfc_normalize({low}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')"
    return f"trim(CASE WHEN {sql_uzbek(low)} THEN {sql_normal(low, True)} ELSE {other} END)"


def sql_exact_form(x: str) -> str:
    t = f"trim({x})"
    return rf"CASE WHEN {sql_uzbek(t)} THEN {sql_normal(t)} ELSE lower(regexp_replace(nfc_normalize({t}), '\s+', ' ', 'g')) END"


def long_form(df, **columns):
    """(doc_id, kind, value...) rows, one for each spelling."""
    return df.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("t")) for k in ("title", "cyr", "odd")])).alias("s")).select("doc_id", "s.kind", *[f(F.col("s.t")).alias(n) for n, f in columns.items()])


def sql_long(**columns) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {', '.join(f'{f(k)} AS {n}' for n, f in columns.items())} FROM {NAMES}" for k in ("title", "cyr", "odd"))


@query(sql_long(is_uzbek=sql_uzbek))
def text_is_uzbek(spark, sf_dir):
    return long_form(names(spark, sf_dir), is_uzbek=T.is_uzbek)


@query(sql_long(gentle=sql_normal, aggressive=lambda x: sql_normal(x, True)))
def text_normalize(spark, sf_dir):
    return long_form(names(spark, sf_dir), gentle=T.normalized, aggressive=lambda c: T.normalized(c, aggressive=True))


@query(f"SELECT doc_id, kind, {sql_collapsed('a')} AS phonetic_key FROM ({sql_long(a=lambda x: sql_normal(x, True))})")
def text_phonetic_key(spark, sf_dir):
    return long_form(names(spark, sf_dir), phonetic_key=T.phonetic_key)


@query(sql_long(exact_form=sql_exact_form, fuzzy_form=sql_fuzzy_form, phonetic_form=sql_phonetic_form))
def text_matcher_forms(spark, sf_dir):
    return long_form(names(spark, sf_dir), exact_form=T.exact_form, fuzzy_form=T.fuzzy_form, phonetic_form=T.phonetic_form)


@query(sql_long(soundex=sql_soundex, metaphone=sql_metaphone))
def text_codes(spark, sf_dir):
    return long_form(names(spark, sf_dir), soundex=S.soundex_code, metaphone=S.metaphone_code)


_ALIKE = " UNION ALL ".join(f"SELECT '{k}' AS k, '{x}' AS v" for k, xs in T.SIMILAR.items() for x in xs)
_BACK = " UNION ALL ".join(f"SELECT '{b.replace(chr(39), chr(39) * 2)}' AS k, '{a}' AS v" for a, b in [*zip(T.CYRILLIC, T.LATIN, strict=False), *T.DIGRAPHS])


@query(f"""WITH l AS (SELECT DISTINCT unnest(string_split(concat(title, cyr), '')) AS letter FROM {NAMES}), v AS ({_ALIKE} UNION ALL {_BACK})
SELECT letter, list_sort(list_distinct(list_append(coalesce(list(v) FILTER (v IS NOT NULL), []), lower(letter)))) AS variations FROM l LEFT JOIN v ON k = lower(letter) WHERE letter <> '' GROUP BY letter""")
def text_character_variations(spark, sf_dir):
    letters = names(spark, sf_dir).select(F.explode(F.split(F.concat("title", "cyr"), "")).alias("letter")).where("letter != ''").distinct()
    return letters.select("letter", T.character_variations(F.col("letter")).alias("variations"))


def pairs(spark, sf_dir):
    """Every title with the next document's, with a shortened one and with one whose beginning is moved to its end."""
    n = titles(spark, sf_dir)
    following = n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("b"))
    near = F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("b")) for k, b in (("short", F.replace("title", F.lit("th"), F.lit("t"))), ("turned", F.concat(F.expr("substring(title, 3)"), F.substring("title", 1, 2))))])
    rows = n.join(following, "doc_id").select("doc_id", F.lit("next").alias("kind"), F.col("title").alias("a"), "b")
    return rows.unionByName(n.select("doc_id", F.col("title").alias("a"), F.explode(near).alias("s")).select("doc_id", "s.kind", "a", "s.b"))


PAIRS = f"""(SELECT x.doc_id, 'next' AS kind, x.title AS a, y.title AS b FROM {TITLES} x JOIN {TITLES} y ON y.doc_id = x.doc_id + 1
UNION ALL SELECT doc_id, 'short', title, replace(title, 'th', 't') FROM {TITLES} UNION ALL SELECT doc_id, 'turned', title, concat(substr(title, 3), substr(title, 1, 2)) FROM {TITLES}) p"""


@query(f"SELECT doc_id, kind, levenshtein(a, b)::INTEGER AS distance, round({sql_levenshtein('a', 'b')}, 6) AS similarity, round((1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1))::FLOAT::DOUBLE, 5) AS matrix FROM {PAIRS}")
def similarity_levenshtein(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("doc_id", "kind", F.levenshtein(a, b).alias("distance"), F.round(S.levenshtein(a, b), 6).alias("similarity"), F.round(S.matrix_similarity(a, b).cast("double"), 5).alias("matrix"))


_S = f"SELECT doc_id, kind, {sql_soundex('a')} AS x, {sql_soundex('b')} AS y, {sql_metaphone('a')} AS u, {sql_metaphone('b')} AS v FROM {PAIRS}"


@query(f"SELECT doc_id, kind, {' + '.join(f'CASE WHEN x[{i}] = y[{i}] THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END' for i in range(1, 5))} AS soundex, round({sql_levenshtein('u', 'v')}, 6) AS metaphone FROM ({_S})")
def similarity_codes(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("doc_id", "kind", S.soundex(a, b).alias("soundex"), F.round(S.metaphone(a, b), 6).alias("metaphone"))


def _sql_root(x: str) -> str:
    for e in S.ENDINGS:
        x = f"regexp_replace({x}, '{e}$', '')"
    return x


_P1 = f"SELECT doc_id, kind, {sql_phonetic_form('a')} AS x, {sql_phonetic_form('b')} AS y FROM {PAIRS}"
_P2 = f"SELECT *, {sql_normal('x', True)} AS nx, {sql_normal('y', True)} AS ny, {_sql_root('x')} AS rx, {_sql_root('y')} AS ry FROM ({_P1})"
_P3 = f"SELECT *, {sql_collapsed('nx')} AS kx, {sql_collapsed('ny')} AS ky FROM ({_P2})"
_WORD = f"CASE WHEN rx <> '' AND ry <> '' AND {sql_levenshtein('rx', 'ry')} >= 80 THEN 90.0::DOUBLE ELSE {sql_levenshtein('x', 'y')} END"


@query(f"SELECT doc_id, kind, round(CASE WHEN kx = ky THEN 100.0::DOUBLE ELSE greatest((1.0::DOUBLE - levenshtein(kx, ky)::DOUBLE / greatest(length(kx), length(ky))) * 100, {_WORD}) END, 6) AS similarity FROM ({_P3})")
def similarity_uzbek_phonetic(spark, sf_dir):
    forms = pairs(spark, sf_dir).withColumns({"x": T.phonetic_form(F.col("a")), "y": T.phonetic_form(F.col("b"))})
    keyed = forms.withColumns({"u": T.phonetic_key(F.col("x")), "v": T.phonetic_key(F.col("y"))})
    score = S.uzbek_phonetic(F.col("x"), F.col("y"), keys=(F.col("u"), F.col("v")))
    return keyed.select("doc_id", "kind", F.round(score, 6).alias("similarity"))


@query(None)
def similarity_combined(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf_dir).select("doc_id", "kind", "a", "b", *[F.round(f(a, b), 6).alias(f.__name__) for f in (S.jaro_winkler, S.sequence, S.combined)])


_B1 = f"SELECT doc_id, cyr, odd, {sql_fuzzy_form('cyr')} AS x, {sql_fuzzy_form('odd')} AS y, {sql_normal('cyr', True)} AS u, {sql_normal('odd', True)} AS v FROM {NAMES}"
_B2 = f"SELECT *, {sql_levenshtein('x', 'y')} AS fuzzy, {sql_collapsed('u')} AS ku, {sql_collapsed('v')} AS kv FROM ({_B1})"
_B3 = f"SELECT *, {sql_levenshtein('ku', 'kv')} AS spoken FROM ({_B2})"


@query(f"""SELECT doc_id, round(fuzzy, 6) AS fuzzy, round(CASE WHEN {sql_uzbek('cyr')} AND {sql_uzbek('odd')} AND spoken > fuzzy THEN least(fuzzy + least((spoken - fuzzy) * 0.3::DOUBLE, 15.0::DOUBLE), 100.0::DOUBLE) ELSE fuzzy END, 6) AS boosted FROM ({_B3})""")
def similarity_boosted(spark, sf_dir):
    """Cyrillic against odd spellings: the fuzzy score raised toward the phonetic one."""
    n = names(spark, sf_dir)
    x, y = T.fuzzy_form(F.col("cyr")), T.fuzzy_form(F.col("odd"))
    scored = n.withColumn("fuzzy", S.levenshtein(x, y))
    return scored.select("doc_id", F.round("fuzzy", 6).alias("fuzzy"), F.round(S.boosted(F.col("fuzzy"), F.col("cyr"), F.col("odd")), 6).alias("boosted"))


@query("SELECT c_custkey, md5(concat_ws('|', c_name, c_mktsegment)) AS cache_key, sha256(c_name) AS checksum, substr(sha256(concat(c_name, 'default_salt')), 1, 8) AS short_hash FROM customer")
def text_hashes(spark, sf_dir):
    from .operators.privacy import hashed

    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.md5(F.concat_ws("|", "c_name", "c_mktsegment")).alias("cache_key"), F.sha2("c_name", 256).alias("checksum"), hashed(F.col("c_name")).alias("short_hash"))
