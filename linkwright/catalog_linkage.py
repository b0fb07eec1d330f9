"""Queries over blocking, linkage and top-k search, on the titles of all documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .catalog_text import TITLES, names, sql_collapsed, sql_exact_form, sql_fuzzy_form, sql_levenshtein, sql_normal, sql_soundex, sql_title, sql_uzbek, title, titles
from .operators import blocking as B
from .operators import linkage as L
from .operators import topk
from .operators.scoring import Algorithm, FieldMapping
from .registry import query, table


def records(spark, sf_dir):
    """One record for each document: id and title."""
    return titles(spark, sf_dir).withColumnRenamed("doc_id", "id")


RECORDS = f"SELECT doc_id AS id, title FROM {TITLES}"
_PREFIX = "SELECT DISTINCT 'exact_prefix' AS strategy, substr(lower(title), 1, n) AS key, id FROM p, (SELECT unnest([2, 3, 4]) AS n) WHERE length(title) >= n"
_GRAMMED = r"SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM p"
_NGRAM = f"SELECT DISTINCT 'ngram' AS strategy, CASE WHEN length(t) >= 3 THEN substr(t, i, 3) ELSE t END AS key, id FROM (SELECT id, t, unnest(range(1, greatest(2, length(t) - 1))) AS i FROM ({_GRAMMED}) WHERE t <> '')"
INDEX = f"WITH p AS ({RECORDS}), k AS ({_PREFIX} UNION ALL {_NGRAM})"
PREFIX_INDEX = f"WITH p AS ({RECORDS}), k AS ({_PREFIX})"


def title_index(spark, sf_dir, strategies=("exact_prefix", "ngram")):
    return B.index(records(spark, sf_dir), "id", ["title"], list(strategies))


@query(f"{INDEX} SELECT strategy, key, id FROM k")
def blocking_index(spark, sf_dir):
    return title_index(spark, sf_dir)


@query(f"{PREFIX_INDEX} SELECT DISTINCT x.id AS id1, y.id AS id2 FROM k x JOIN k y ON x.strategy = y.strategy AND x.key = y.key")
def blocking_candidate_pairs(spark, sf_dir):
    rows = B.index(records(spark, sf_dir), "id", ["title"], ["exact_prefix"], pairing=True)
    return B.candidate_pairs(rows, rows)


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), title(F.col("text")).alias("title"))


_ITEMS = f"(SELECT item_id AS id, {sql_title()} AS title FROM benchmark)"


@query(f"WITH q AS (WITH p AS (SELECT * FROM {_ITEMS}) {_NGRAM}), d AS (WITH p AS ({RECORDS}) {_NGRAM}) SELECT DISTINCT q.id AS id1, d.id AS id2 FROM q JOIN d ON q.key = d.key")
def blocking_ngram_pairs(spark, sf_dir):
    """Benchmark items and documents that share a trigram of their titles."""
    config = L.LinkageConfig((FieldMapping("title", "title"),), strategies=("ngram",))
    return L.candidates(items(spark, sf_dir), records(spark, sf_dir), "id", "id", config)


_SIZES = "SELECT strategy, key, count(DISTINCT id) AS size FROM k GROUP BY ALL"


@query(f"{INDEX}, s AS ({_SIZES}), n AS (SELECT count(*) AS n FROM p) SELECT count(*) AS blocks, round(avg(size), 6) AS avg_size, max(size) AS max_size, min(size) AS min_size, round(greatest(0.0::DOUBLE, (1 - sum(size * (size - 1) // 2)::DOUBLE / greatest(1, max(n.n * (n.n - 1) // 2))) * 100), 6) AS reduction_ratio FROM s, n")
def blocking_statistics(spark, sf_dir):
    n = records(spark, sf_dir).count()
    s = B.statistics(title_index(spark, sf_dir), n)
    return s.withColumns({c: F.round(c, 6) for c in ("avg_size", "reduction_ratio")})


@query(f"{INDEX} SELECT strategy, count(DISTINCT key) AS blocks FROM k GROUP BY strategy")
def blocking_distribution(spark, sf_dir):
    return B.distribution(title_index(spark, sf_dir))


@query(f"{INDEX}, s AS ({_SIZES}), c AS (SELECT strategy, size, count(*) AS n FROM s GROUP BY ALL) SELECT strategy, sum(n)::BIGINT AS blocks, sum(n * size)::BIGINT AS memberships, string_agg(size || ':' || n, ',' ORDER BY size) AS sizes FROM c GROUP BY strategy")
def blocking_block_info(spark, sf_dir):
    return B.block_info(title_index(spark, sf_dir)).withColumn("sizes", F.array_join(F.transform("sizes", lambda x: F.concat_ws(":", x["size"].cast("string"), x["n"].cast("string"))), ","))


@query(f"{INDEX} SELECT strategy, CASE WHEN count(*) OVER w > 5 THEN key || '_' || ((row_number() OVER (PARTITION BY strategy, key ORDER BY id) - 1) // 5)::VARCHAR ELSE key END AS key, id FROM k WINDOW w AS (PARTITION BY strategy, key)")
def blocking_split(spark, sf_dir):
    return B.split_blocks(title_index(spark, sf_dir), 5)


def _sql_selectivity(keys: str, divisor: float) -> str:
    return f"WITH p AS ({RECORDS}), k AS ({keys}) SELECT (SELECT count(title) FROM p) AS records, count(DISTINCT key) AS keys, round(least(1.0, 1.0 / ((SELECT count(title) FROM p)::DOUBLE / count(DISTINCT key) / {divisor})), 6) AS selectivity FROM k"


@query(_sql_selectivity(_PREFIX, 10.0))
def blocking_selectivity_prefix(spark, sf_dir):
    return B.selectivity(records(spark, sf_dir), "title", "exact_prefix").withColumn("selectivity", F.round("selectivity", 6))


@query(_sql_selectivity(_NGRAM, 8.0))
def blocking_selectivity_ngram(spark, sf_dir):
    return B.selectivity(records(spark, sf_dir), "title", "ngram").withColumn("selectivity", F.round("selectivity", 6))


_SPOKEN = f"SELECT id, title, {sql_normal('title', True)} AS n FROM p WHERE title <> ''"
_PHONETIC = f"SELECT DISTINCT id, key FROM (SELECT id, {sql_soundex('title')} AS key FROM ({_SPOKEN}) UNION ALL SELECT id, {sql_collapsed('n')} FROM ({_SPOKEN}) WHERE {sql_uzbek('title')} AND n <> '')"


@query(_sql_selectivity(_PHONETIC, 15.0))
def blocking_selectivity_phonetic(spark, sf_dir):
    return B.selectivity(records(spark, sf_dir), "title", "phonetic_key").withColumn("selectivity", F.round("selectivity", 6))


@query(f"WITH p AS ({RECORDS}) SELECT id, key FROM ({_PHONETIC})")
def blocking_phonetic_keys(spark, sf_dir):
    return title_index(spark, sf_dir, ("phonetic_key",)).select("id", "key")


@query(f"WITH p AS ({RECORDS}), t AS ({_GRAMMED}) SELECT DISTINCT id, key FROM (SELECT id, CASE WHEN length(t) >= 3 THEN substr(t, i, 3) ELSE t END AS key FROM (SELECT id, t, unnest(range(1, greatest(2, length(t) - 1))) AS i FROM t WHERE t <> '') UNION ALL SELECT id, substr(t, i, 2) || substr(t, i + 3, 1) FROM (SELECT id, t, unnest(range(1, length(t) - 2)) AS i FROM t WHERE length(t) >= 4))")
def blocking_skip_grams(spark, sf_dir):
    """Trigrams, and those with one character left out before the last."""
    return records(spark, sf_dir).select("id", F.explode(B.ngram_keys(F.col("title"), skips=1)).alias("key"))


@query(f"WITH p AS ({RECORDS}), h AS (SELECT * FROM p ORDER BY id LIMIT 100), c AS (SELECT ['exact_prefix'] || CASE WHEN (SELECT bool_or({sql_uzbek('title')}) FROM h) THEN ['phonetic_key'] ELSE [] END || CASE WHEN (SELECT count(*) FROM p) > 1000 THEN ['ngram'] ELSE [] END AS l, (SELECT count(*) FROM p) AS n) SELECT unnest(range(len(s)))::INTEGER AS place, unnest(s) AS strategy FROM (SELECT CASE WHEN n > 10000 THEN l[1:2] ELSE l END AS s FROM c)")
def blocking_strategies(spark, sf_dir):
    """The strategies that strict mode chooses by size and by the first values."""
    return B.selected(records(spark, sf_dir), ["title"], "id")


@query("SELECT 'c_name' AS field, count(c_name) AS non_null, count(DISTINCT c_name) AS distinct_values, count(DISTINCT c_name)::DOUBLE / count(c_name) AS uniqueness, round(avg(length(c_name)), 6) AS avg_length, false AS has_uzbek FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment)::DOUBLE / count(c_mktsegment), round(avg(length(c_mktsegment)), 6), false FROM customer")
def dataset_characteristics(spark, sf_dir):
    return B.characteristics(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], "c_custkey").withColumn("avg_length", F.round("avg_length", 6))


@query("SELECT n_nationkey AS id1, s_suppkey AS id2 FROM nation, supplier")
def cartesian_pairs(spark, sf_dir):
    """The opt-in without blocking, over all rows of two tables."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return L.candidates(n, s, "n_nationkey", "s_suppkey", L.LinkageConfig((FieldMapping("n_name", "s_name"),), use_blocking=False))


CONFIG = L.LinkageConfig((FieldMapping("title", "title"),), (Algorithm("exact"), Algorithm("fuzzy", {"method": "levenshtein", "compose": False})), 75.0, strategies=("exact_prefix",))


def numbers():
    """The algorithm of a match, and its numbers rounded."""
    return {"algorithm": F.col("algorithm"), **{c: F.round(c, 6) for c in ("similarity", "confidence")}}


def title_matches(spark, sf_dir, config=CONFIG):
    """The titles of all documents linked with themselves."""
    p = records(spark, sf_dir)
    return L.find_matches(p, p, "id", "id", config)


MATCHES = f"""{PREFIX_INDEX}, c AS (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM k x JOIN k y ON x.strategy = y.strategy AND x.key = y.key),
f AS (SELECT id, title, {sql_exact_form('title')} AS e, {sql_fuzzy_form('title')} AS f FROM p),
s AS (SELECT id1, id2, CASE WHEN a.title = '' OR b.title = '' THEN NULL WHEN a.e = b.e THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS es, CASE WHEN a.title = '' OR b.title = '' THEN NULL ELSE {sql_levenshtein('a.f', 'b.f')} END AS ls FROM c JOIN f a ON a.id = id1 JOIN f b ON b.id = id2),
u AS (SELECT id1, id2, CASE WHEN es >= ls AND es > 0 THEN 'exact' ELSE 'fuzzy' END AS algorithm, greatest(es, ls) AS similarity, CASE WHEN es >= ls AND es > 0 THEN 100.0::DOUBLE ELSE least(ls + CASE WHEN ls >= 55 THEN 10 ELSE 0 END, 100) END AS confidence FROM s WHERE greatest(es, ls) > 0),
m AS (SELECT * FROM u WHERE confidence >= 75)"""


@query(f"{MATCHES} SELECT id1, id2, algorithm, round(similarity, 6) AS similarity, round(confidence, 6) AS confidence, 'title' AS matched_fields FROM m")
def linkage_matches(spark, sf_dir):
    m = title_matches(spark, sf_dir).scores(numbers() | {"matched_fields": F.array_join("matched_fields", ",")})
    return m.select("id1", "id2", "algorithm", "similarity", "confidence", "matched_fields")


@query(f"{MATCHES} SELECT id1, id2, 'title' AS field, round(similarity, 6) AS similarity, round(CASE WHEN similarity = 100 OR algorithm = 'exact' THEN similarity ELSE greatest(similarity - 5, 0) END, 6) AS field_confidence, 1.0::DOUBLE AS weight, round(similarity, 6) AS weighted_score FROM m")
def linkage_field_results(spark, sf_dir):
    """What each field added to a match."""
    rounded = {b: F.round(f"r.{a}", 6) for a, b in (("similarity", "similarity"), ("confidence", "field_confidence"), ("weight", "weight"), ("weighted_score", "weighted_score"))}
    m = title_matches(spark, sf_dir).scores({"field": F.col("field")} | rounded, lambda m: m.select("*", F.explode("field_results").alias("field", "r")))
    return m.select("id1", "id2", "field", *rounded)


@query(f"""{MATCHES}, n AS (SELECT count(*) AS n FROM p) SELECT max(n.n) AS total_1, max(n.n) AS total_2, count(id1) AS matches, count(*) FILTER (confidence >= 85) AS high_confidence, count(*) FILTER (confidence < 85) AS low_confidence,
 max(n.n) - count(DISTINCT id1) AS unmatched_1, max(n.n) - count(DISTINCT id2) AS unmatched_2, round(avg(confidence), 6) AS avg_confidence, (SELECT count(*) FROM c) AS total_comparisons, round(count(id1) * 100.0 / max(n.n), 6) AS match_rate_1, round(count(id1) * 100.0 / max(n.n), 6) AS match_rate_2 FROM n LEFT JOIN m ON true""")
def linkage_statistics(spark, sf_dir):
    s = title_matches(spark, sf_dir).statistics
    return s.withColumns({c: F.round(c, 6) for c in ("avg_confidence", "match_rate_1", "match_rate_2")})


@query(f"{MATCHES} SELECT id AS doc_id FROM p WHERE id NOT IN (SELECT id1 FROM m)")
def linkage_unmatched(spark, sf_dir):
    return title_matches(spark, sf_dir).unmatched_1.select(F.col("id").alias("doc_id"))


def _best(keep: str) -> str:
    w = {"id1": "row_number() OVER (PARTITION BY id1 ORDER BY round(confidence, 9) DESC, round(similarity, 9) DESC, id2)", "id2": "row_number() OVER (PARTITION BY id2 ORDER BY round(confidence, 9) DESC, round(similarity, 9) DESC, id1)"}
    return f"{MATCHES}, r AS (SELECT *, {w['id1']} AS r1, {w['id2']} AS r2 FROM m) SELECT id1, id2 FROM r WHERE {keep}"


def _cardinality(spark, sf_dir, kind):
    return title_matches(spark, sf_dir, replace(CONFIG, cardinality=kind)).matched.select("id1", "id2")


@query(_best("r1 = 1"))
def linkage_many_to_one(spark, sf_dir):
    return _cardinality(spark, sf_dir, "many_to_one")


@query(_best("r2 = 1"))
def linkage_one_to_many(spark, sf_dir):
    return _cardinality(spark, sf_dir, "one_to_many")


@query(_best("r1 = 1 AND r2 = 1"))
def linkage_one_to_one(spark, sf_dir):
    return _cardinality(spark, sf_dir, "one_to_one")


@query("WITH m AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM m)")
def unmatched_by_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return L.unmatched(c, "c_custkey", c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("m"))).select("c_custkey")


@query("WITH d AS (SELECT p_partkey, p_name, p_brand, p_type FROM part) SELECT p_partkey FROM d WHERE NOT EXISTS (SELECT 1 FROM d h WHERE h.p_partkey % 10 = 0 AND h.p_name IS NOT DISTINCT FROM d.p_name AND h.p_brand IS NOT DISTINCT FROM d.p_brand AND h.p_type IS NOT DISTINCT FROM d.p_type)")
def unmatched_by_value(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return L.unmatched(p, "p_partkey", p.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("m")), by_value=True).select("p_partkey")


CLASSES = f"SELECT min(doc_id) AS id, title, count(*) AS class_rows FROM {TITLES} GROUP BY title"


@query(f"""{MATCHES.replace(RECORDS, CLASSES)}, l AS (SELECT id1, count(*) AS linked_classes, sum(class_rows)::BIGINT AS linked_rows FROM m JOIN p ON p.id = id2 GROUP BY id1)
SELECT doc_id, p.id AS class_id, class_rows, coalesce(linked_classes, 0) AS linked_classes, coalesce(linked_rows, 0) AS linked_rows
FROM {TITLES} t JOIN p ON t.title IS NOT DISTINCT FROM p.title LEFT JOIN l ON id1 = p.id""")
def linkage_title_classes(spark, sf_dir):
    """Every document with its class of equal titles, and how many classes and rows that is linked with (itself too)."""
    docs = titles(spark, sf_dir)
    classes = docs.groupBy("title").agg(F.min("doc_id").alias("id"), F.count("*").alias("class_rows"))
    p = classes.select("id", "title")
    m = L.find_matches(p, p, "id", "id", CONFIG).matched.select("id1", "id2")
    sizes = classes.select(F.col("id").alias("id2"), "class_rows")
    links = m.join(sizes, "id2").groupBy(F.col("id1").alias("id")).agg(F.count("*").alias("linked_classes"), F.sum("class_rows").alias("linked_rows"))
    whole = classes.join(links, "id", "left").fillna(0, ["linked_classes", "linked_rows"]).alias("k")
    return docs.alias("a").join(whole, F.col("a.title").eqNullSafe(F.col("k.title"))).select("doc_id", F.col("id").alias("class_id"), "class_rows", "linked_classes", "linked_rows")


@query(None)
def linkage_all_algorithms(spark, sf_dir):
    """Cyrillic against Latin spellings of all titles with exact, combined fuzzy and phonetic scoring."""
    n = names(spark, sf_dir).select(F.col("doc_id").alias("id"), "cyr", F.concat("title", F.lit("'")).alias("latin"))
    config = L.LinkageConfig((FieldMapping("cyr", "latin"),), threshold=75.0, strategies=("phonetic_key",))
    m = L.find_matches(n.select("id", "cyr"), n.select("id", "latin"), "id", "id", config).scores(numbers() | {"matched_fields": F.col("matched_fields")})
    return m.select("id1", "id2", "algorithm", "similarity", "confidence", "matched_fields")


_TOP = "SELECT q.title AS q, c.title AS c, q.id AS q_id, c.id AS c_id, (1.0 - levenshtein(q.title, c.title)::DOUBLE / greatest(length(q.title), length(c.title), 1))::FLOAT AS similarity FROM p q, p c"


def _top(spark, sf_dir):
    """The titles of all documents as queries and as texts."""
    p = records(spark, sf_dir)
    return p.select(F.col("id").alias("q_id"), F.col("title").alias("q")), p.select(F.col("id").alias("c_id"), F.col("title").alias("c"))


@query(f"WITH p AS ({RECORDS}), s AS ({_TOP}), r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, c_id) AS r FROM s WHERE similarity >= 0.6::FLOAT) SELECT q_id, c_id, round(similarity::DOUBLE, 5) AS similarity, r AS rank FROM r WHERE r <= 5")
def topk_similar_names(spark, sf_dir):
    return topk.best_pairs(*_top(spark, sf_dir), 0.6, 5).select("q_id", "c_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH p AS ({RECORDS}), s AS ({_TOP}), m AS (SELECT * FROM s WHERE similarity >= 0.6::FLOAT) SELECT count(*) AS matches, count(DISTINCT q_id) AS matched_queries, round(count(DISTINCT q_id)::DOUBLE / (SELECT count(*) FROM p), 6) AS match_rate, round(count(*)::DOUBLE / (SELECT count(*) FROM p), 6) AS avg_matches FROM m")
def topk_statistics(spark, sf_dir):
    s = topk.pair_statistics(*_top(spark, sf_dir), 0.6, records(spark, sf_dir).count())
    return s.withColumns({c: F.round(c, 6) for c in ("match_rate", "avg_matches")})


@query(rf"""WITH q AS (SELECT item_id, unnest(w) AS w, len(w) AS n FROM (SELECT item_id, list_distinct([x for x in regexp_split_to_array(lower(text), '\s+') if x <> '']) AS w FROM benchmark)),
d AS (SELECT doc_id, unnest(w) AS w, len(w) AS n FROM (SELECT doc_id, list_distinct([x for x in regexp_split_to_array(lower(text), '\s+') if x <> '']) AS w FROM documents WHERE text IS NOT NULL)),
o AS (SELECT item_id, doc_id, count(*) * 100.0::DOUBLE / greatest(max(q.n), max(d.n)) AS overlap FROM q JOIN d ON q.w = d.w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS r FROM o WHERE overlap > 20)
SELECT item_id, doc_id, round(overlap, 6) AS overlap FROM r WHERE r = 1""")
def token_overlap_best(spark, sf_dir):
    """The document with the largest word overlap of each benchmark item."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q"))
    c = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("c_id"), F.col("text").alias("c"))
    return topk.token_overlap(q, c, 20.0).select(F.col("q_id").alias("item_id"), F.col("c_id").alias("doc_id"), F.round("overlap", 6).alias("overlap"))
