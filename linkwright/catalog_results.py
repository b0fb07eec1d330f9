"""Queries over results, scans, profiles and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import privacy as P
from .operators import results as R
from .registry import query, table
from .sources import files, sinks
from .storage import new_path


def shared(spark) -> str:
    """A new folder where driver and executors both read and write."""
    return new_path(spark)


def scored(spark, sf_dir):
    """Results to query: orders with a score from 0 to 100."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id1"), F.col("o_custkey").alias("id2"), (F.col("o_orderkey") * 37 % 101).cast("double").alias("confidence"), F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", F.lit("status")), F.lit("key"))).alias("matched_fields"), "o_orderpriority")


SCORED = "(SELECT o_orderkey AS id1, o_custkey AS id2, (o_orderkey * 37 % 101)::DOUBLE AS confidence, o_orderstatus = 'P' AS is_p, o_orderpriority FROM orders) t"


@query(f"SELECT id1, id2, confidence FROM {SCORED} WHERE confidence BETWEEN 40 AND 60")
def results_confidence_range(spark, sf_dir):
    return R.by_confidence(scored(spark, sf_dir), 40, 60).select("id1", "id2", "confidence")


@query(f"SELECT id1 FROM {SCORED} WHERE is_p")
def results_any_field(spark, sf_dir):
    return R.by_fields(scored(spark, sf_dir), ["status", "other"]).select("id1")


@query(f"SELECT count(*) FILTER (confidence >= 75) AS high, count(*) FILTER (confidence < 75) AS low FROM {SCORED}")
def results_high_low(spark, sf_dir):
    s = scored(spark, sf_dir)
    return R.high(s).agg(F.count("*").alias("high")).crossJoin(R.low(s).agg(F.count("*").alias("low")))  # one row each


@query(r"SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^BLUE .*T$') OR regexp_matches(p_brand, '(?i)^BLUE .*T$') OR regexp_matches(p_type, '(?i)^BLUE .*T$')")
def results_search(spark, sf_dir):
    return R.search(table(spark, sf_dir, "part"), "^BLUE .*T$").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring')")
def results_search_literal(spark, sf_dir):
    return R.search_literal(table(spark, sf_dir, "part"), "ring", "p_name").select("p_partkey")


@query(f"SELECT id1, confidence FROM {SCORED} ORDER BY confidence DESC, id1, id2 LIMIT 50 OFFSET 100")
def results_sorted_page(spark, sf_dir):
    return R.page(R.sorted_by(scored(spark, sf_dir), "confidence"), 3, 50).select("id1", "confidence")


@query(f"SELECT id1, confidence FROM {SCORED} ORDER BY CASE WHEN confidence >= 80 THEN 0 ELSE 1 END, CASE WHEN confidence >= 80 THEN confidence ELSE -confidence END, id1, id2 LIMIT 100")
def results_split_sort_page(spark, sf_dir):
    return R.web_page(R.split_sorted(scored(spark, sf_dir)), 1, 100)[0].select("id1", "confidence")


def _matched(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    both = s.join(n, s.s_nationkey == n.n_nationkey)
    return both.select(F.struct("s_suppkey", "s_name", F.col("s_acctbal").alias("value")).alias("record1"), F.struct("n_nationkey", "n_name", F.col("n_regionkey").cast("double").alias("value")).alias("record2"), (F.col("s_acctbal") / 100).alias("confidence"), F.array(F.lit("a"), F.lit("b")).alias("matched_fields"), F.lit("exact").alias("algorithm"))


_JOINED = "FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT s_suppkey AS record1_s_suppkey, s_name AS record1_s_name, s_acctbal AS record1_value, n_nationkey AS record2_n_nationkey, n_name AS record2_n_name, n_regionkey::DOUBLE AS record2_value, round(s_acctbal / 100, 6) AS confidence_score, 'a, b' AS matching_fields {_JOINED}")
def results_flat(spark, sf_dir):
    return R.flat(_matched(spark, sf_dir)).withColumn("confidence_score", F.round("confidence_score", 6))


@query(f"SELECT round(s_acctbal / 100, 6) AS match_score, s_suppkey, s_name, n_regionkey::DOUBLE AS value, n_nationkey, n_name {_JOINED}")
def results_main_flat(spark, sf_dir):
    return R.main_flat(_matched(spark, sf_dir)).withColumn("match_score", F.round("match_score", 6))


@query(f"SELECT round_even(s_acctbal / 100, 2) AS confidence_score, s_suppkey AS f1_s_suppkey, s_name AS f1_s_name, s_acctbal AS f1_value, n_nationkey AS f2_n_nationkey, n_name AS f2_n_name, n_regionkey::DOUBLE AS f2_value, 'exact' AS algorithm {_JOINED}")
def results_web_flat(spark, sf_dir):
    return R.web_flat(_matched(spark, sf_dir))


@query(f"SELECT round(s_acctbal / 100, 6) AS match_score, s_suppkey AS a_s_suppkey, s_name AS a_s_name, s_acctbal AS a_value, n_regionkey::DOUBLE AS b_value, n_nationkey AS b_n_nationkey, n_name AS b_n_name {_JOINED}")
def results_prefixes(spark, sf_dir):
    """Both records' columns with the prefixes that a job configures."""
    return R.main_flat(_matched(spark, sf_dir), prefixes=("a_", "b_")).withColumn("match_score", F.round("match_score", 6))


@query(f"SELECT round(s_acctbal / 100, 6) AS match_score, s_suppkey, n_name {_JOINED} WHERE s_acctbal / 100 < 40")
def results_low_confidence(spark, sf_dir):
    return R.low_confidence(_matched(spark, sf_dir), 40).select(F.round("match_score", 6).alias("match_score"), "s_suppkey", "n_name")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_tax END AS x FROM lineitem")
def results_without_nan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_tax")).alias("x"))
    return R.without_nan(li)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def results_json_round_trip(spark, sf_dir):
    """A document for each customer's orders, and its records again."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    doc = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("matched_records"))).alias("j"))
    return R.from_json(doc, "j", "o_orderkey: long, o_orderstatus: string, o_totalprice: double")


# ---- exports, read back


def _result(spark, sf_dir):
    """A result of linking suppliers with their nations."""
    from .operators.linkage import LinkageResult

    m = _matched(spark, sf_dir).withColumns({"id1": F.col("record1.s_suppkey"), "id2": F.col("record2.n_nationkey")})
    n = table(spark, sf_dir, "nation")
    statistics = m.agg(F.count("*").alias("matches"))
    return LinkageResult(m, n.where("n_nationkey < 0"), n.where("n_regionkey = 1"), statistics, {"threshold": 75.0})


_EXPORTED = f"SELECT s_suppkey::VARCHAR AS record1_s_suppkey, n_name AS record2_n_name, 'a, b' AS matching_fields, true AS dated {_JOINED}"


@query(_EXPORTED)
def export_csv(spark, sf_dir):
    path = sinks.export_csv(_result(spark, sf_dir).matched, shared(spark))
    back = spark.read.option("header", True).csv(path)
    return back.select("record1_s_suppkey", "record2_n_name", "matching_fields", F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT").alias("dated"))


@query(f"SELECT 'matched' AS part, count(*) AS n {_JOINED} UNION ALL SELECT 'unmatched_1', 0 UNION ALL SELECT 'unmatched_2', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'statistics', 1")
def export_json(spark, sf_dir):
    path = sinks.export_json(_result(spark, sf_dir), shared(spark))
    parts = [spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name in ("matched", "unmatched_1", "unmatched_2", "statistics")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"SELECT s_suppkey, n_name, round(s_acctbal / 100, 6) AS confidence {_JOINED} WHERE s_acctbal / 100 >= 20 ORDER BY s_acctbal DESC, s_suppkey, n_nationkey LIMIT 10 OFFSET 10")
def export_dispatched(spark, sf_dir):
    """Filtered, sorted, the second page of ten, written with its types and read back."""
    export = sinks.Export("parquet", least=20.0, fields=("a",), page=2, page_size=10)
    back = sinks.load_result(spark, sinks.export_result(_result(spark, sf_dir), export, shared(spark)))
    return back.matched.select("record1.s_suppkey", "record2.n_name", F.round("confidence", 6).alias("confidence"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, printf('%.2f', c_acctbal) AS c_acctbal FROM customer")
def export_download(spark, sf_dir):
    """One CSV file with a byte order mark, quotes and two places, made of JSON lines."""
    source = sinks.save(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), shared(spark), "json")[0]
    to = shared(spark) + ".csv"
    sinks.download(spark, source, to, "csv")
    return files.read_csv(spark, to)


@query("SELECT count(*) AS rows, max(n) <= 500 AS bounded FROM (SELECT 500 AS n, c_custkey FROM customer)")
def export_chunked(spark, sf_dir):
    """Files of at most 500 rows."""
    path = sinks.save_chunked(table(spark, sf_dir, "customer"), shared(spark), 500)
    by_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return by_file.agg(F.sum("n").alias("rows"), (F.max("n") <= 500).alias("bounded"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def scan_csv(spark, sf_dir):
    """Written as CSV and read back: header, detected delimiter, all columns text."""
    df, at = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), shared(spark)
    path = sinks.save(df.coalesce(1), at, "csv")[0]
    part = next(p for p in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path").toPandas()["path"])
    return files.read_csv(spark, part)


@query("SELECT (SELECT count(*) FROM customer) AS rows, 4 AS n_columns")
def scan_count_lines(spark, sf_dir):
    """Rows and columns of a written CSV file, one record a line."""
    path = sinks.save(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), shared(spark), "csv")[0]
    facts = files.info(spark, path)
    return spark.createDataFrame([(files.count_lines_csv(spark, path), len(facts["columns"]))], "rows long, n_columns int")


@query("SELECT p_partkey, strpos(p_partkey || ',' || p_name, 'ring') - 1 AS at FROM part WHERE contains(p_name, 'ring')")
def scan_find_bytes(spark, sf_dir):
    path = sinks.save(table(spark, sf_dir, "part").select("p_partkey", "p_name"), shared(spark), "csv")[0]
    return files.find_bytes(spark, path, b"ring").select(F.split("line", ",")[0].cast("long").alias("p_partkey"), F.col("at").cast("long").alias("at"))


@query("WITH p AS (SELECT unnest(['ring', 'e', 'ee']) AS pattern) SELECT pattern, count(*)::BIGINT AS places FROM (SELECT pattern, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part, p) WHERE substr(p_name, i, length(pattern)) = pattern GROUP BY pattern")
def scan_find_places(spark, sf_dir):
    """How often each pattern begins in files of all part names."""
    path = shared(spark)
    table(spark, sf_dir, "part").select("p_name").write.text(path)
    found = [files.find_places(spark, path, x.encode()).select(F.lit(x).alias("pattern")) for x in ("ring", "e", "ee")]
    return found[0].union(found[1]).union(found[2]).groupBy("pattern").agg(F.count("*").alias("places"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def scan_json_lines(spark, sf_dir):
    path = sinks.save(table(spark, sf_dir, "nation"), shared(spark), "json")[0]
    return files.read_jsonl(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def scan_json_array(spark, sf_dir):
    path = shared(spark) + ".json"
    sinks.save_pretty_json(table(spark, sf_dir, "nation"), path)
    return files.load(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def scan_chunks(spark, sf_dir):
    """A function over chunks, its partial counts added up."""
    def count(frame):
        return frame.groupby("o_orderpriority").size().rename("n").reset_index()

    return files.map_chunks(table(spark, sf_dir, "orders").select("o_orderpriority"), count, "o_orderpriority string, n long", 1000).groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@query("SELECT 'c_custkey' AS \"column\", count(*) AS rows, count(c_custkey) AS filled, count(c_custkey) = 0 AS all_null FROM customer UNION ALL SELECT 'nothing', count(*), 0, true FROM customer")
def profile_columns(spark, sf_dir):
    return files.profile(table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("nothing")))


@query("SELECT count(*) AS rows, count(*) FILTER (lang IS NULL) AS null_lang, count(*) FILTER (text IS NULL) AS null_text, count(*) - count(DISTINCT text) AS duplicate_texts FROM documents")
def profile_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"), F.count_if(F.col("lang").isNull()).alias("null_lang"), F.count_if(F.col("text").isNull()).alias("null_text"), (F.count("*") - F.countDistinct("text")).alias("duplicate_texts"))


def _sql_finds(x: str) -> str:
    return " UNION ALL ".join(f"SELECT page_id AS id, '{kind}' AS kind, " + " + ".join(f"len(regexp_extract_all({x}, '(?is){p}'))" for p in patterns) + " AS n FROM pages" for kind, patterns in files.SUSPICIOUS.items())


@query(f"SELECT id, kind, n::BIGINT AS n FROM ({_sql_finds('html')}) WHERE n > 0")
def content_findings(spark, sf_dir):
    return files.content_findings(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"SELECT kind, CASE WHEN kind IN ('executable', 'command') THEN 'high' WHEN kind IN ('script', 'sql') THEN 'medium' ELSE 'low' END AS severity, count(*) AS files, sum(n)::BIGINT AS finds FROM ({_sql_finds('html')}) WHERE n > 0 GROUP BY ALL")
def content_threat_report(spark, sf_dir):
    return files.threat_report(files.content_findings(table(spark, sf_dir, "pages"), "page_id", "html"))


# ---- personal data

_FOUND = " UNION ALL ".join(f"SELECT doc_id AS id, 'text' AS field, '{k}' AS pii_type, unnest(regexp_extract_all(text, '(?i){p}')) AS value, {c}::DOUBLE AS confidence FROM documents" for k, (p, c) in P.PATTERNS.items())


def _found(spark, sf_dir):
    return P.findings(table(spark, sf_dir, "documents"), "doc_id", columns=["text"])


@query(f"SELECT id, field, pii_type, value, confidence FROM ({_FOUND})")
def pii_findings(spark, sf_dir):
    return _found(spark, sf_dir).drop("number")


@query(f"WITH f AS ({_FOUND}) SELECT 'total' AS kind, 'all' AS name, count(*) AS n FROM f UNION ALL SELECT 'type', pii_type, count(*) FROM f GROUP BY pii_type UNION ALL SELECT 'field', field, count(*) FROM f GROUP BY field")
def pii_summary(spark, sf_dir):
    return P.summary(_found(spark, sf_dir))


@query(f"""WITH f AS (SELECT DISTINCT pii_type, value FROM ({_FOUND}))
SELECT pii_type, value, CASE WHEN pii_type = 'email' THEN repeat('*', strpos(value, '@') - 1) || substr(value, strpos(value, '@')) WHEN pii_type IN ('phone', 'ssn', 'credit_card') THEN repeat('*', length(value) - 4) || right(value, 4)
 WHEN pii_type = 'ip_address' THEN regexp_replace(value, '^([0-9]+)\\.([0-9]+)\\..*$', '\\1.\\2.xxx.xxx') ELSE CASE WHEN contains(value, '/') THEN substr(value, 1, 7) || 'xxxx' ELSE substr(value, 1, length(value) - 1) || 'x' END END AS safe,
 substr(sha256(value || 'default_salt'), 1, 8) AS hashed FROM f""")
def pii_rules(spark, sf_dir):
    f = _found(spark, sf_dir).select("pii_type", "value").distinct()
    safe = F.coalesce(*[F.when(F.col("pii_type") == k, P.apply_rule(F.col("value"), *P.RULES[k])) for k in P.PATTERNS])
    return f.select("pii_type", "value", safe.alias("safe"), P.hashed(F.col("value")).alias("hashed"))


_TEXT_RULES = {
    "email": "CASE WHEN strpos({v}, '@') > 0 THEN repeat('*', strpos({v}, '@') - 1) || substr({v}, strpos({v}, '@')) ELSE repeat('*', length({v})) END",
    "ip_address": "regexp_replace({v}, '^([0-9]+)\\.([0-9]+)\\..*$', '\\1.\\2.xxx.xxx')",
    "date_of_birth": "CASE WHEN contains({v}, '/') AND regexp_matches({v}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN substr({v}, 1, 7) || 'xxxx' ELSE substr({v}, 1, length({v}) - 1) || 'x' END",
}
_DIGITS = "CASE WHEN length({v}) > 4 THEN repeat('*', length({v}) - 4) || right({v}, 4) ELSE repeat('*', length({v})) END"


def _sql_replaced(source: str, rules: dict) -> str:
    """The text put together again from the pieces between the matches and the replaced matches, type after type."""
    for kind, (p, _) in P.PATTERNS.items():
        rule = rules.get(kind, _DIGITS).format(v="f[i]")
        glued = f"array_to_string([p[i] || CASE WHEN i <= len(f) THEN {rule} ELSE '' END for i in range(1, len(p) + 1)], '')"
        source = f"SELECT doc_id, CASE WHEN len(f) > 0 THEN {glued} ELSE text END AS text FROM (SELECT doc_id, text, string_split_regex(text, '(?i){p}') AS p, regexp_extract_all(text, '(?i){p}') AS f FROM ({source}))"
    return source


@query(_sql_replaced("SELECT doc_id, text FROM documents", _TEXT_RULES))
def pii_anonymize(spark, sf_dir):
    return P.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["text"])


@query(_sql_replaced("SELECT doc_id, text FROM documents", {k: "'[REDACTED]'" if k == "email" else "''" for k in P.PATTERNS}))
def pii_remove_replace(spark, sf_dir):
    """E-mail addresses replaced by a mark, everything else removed."""
    policy = P.Policy(rules={k: ("replace", {}) if k == "email" else ("remove", {}) for k in P.PATTERNS})
    return P.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), policy, columns=["text"])


_PLACED = " UNION ALL ".join(
    f"SELECT doc_id AS id, '{k}' AS pii_type, f[i] AS value, {c}::DOUBLE AS confidence, list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in f[1:i - 1]]), 0) AS s FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '(?i){p}') AS p, regexp_extract_all(text, '(?i){p}') AS f FROM documents))"
    for k, (p, c) in P.PATTERNS.items()
)


@query(f'SELECT id, pii_type, value, confidence, s::INTEGER AS start, (s + length(value))::INTEGER AS "end" FROM ({_PLACED})')
def pii_positions(spark, sf_dir):
    return P.positions(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT event_type, count(*) AS n FROM (VALUES ('read'), ('write'), ('read')) t(event_type) GROUP BY 1")
def pii_audit_log(spark, sf_dir):
    """Events appended to a log and counted from it."""
    path = shared(spark)
    for kind in ("read", "write", "read"):
        P.log_audit(spark, path, kind, "ann")
    return P.audit_summary(P.audit_log(spark, path)).select("event_type", "n")


@query("""WITH f AS (SELECT p_name AS v, min(p_partkey) AS o FROM part GROUP BY p_name), n AS (SELECT v, printf('ANON_%06d', row_number() OVER (ORDER BY o, v)) AS a FROM f)
SELECT p_partkey, a AS p_name FROM part JOIN n ON p_name = v""")
def pii_pseudonymize(spark, sf_dir):
    return P.pseudonymize(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("SELECT count(*) AS tracked, count(*) FILTER (o_orderdate + INTERVAL 90 DAY < TIMESTAMP '1999-01-01') AS expired FROM orders")
def pii_retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderdate") + F.make_dt_interval(F.lit(90))).alias("expires_at"))
    return P.protection_statistics(o, F.lit("1999-01-01").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type")
def pii_audit_summary(spark, sf_dir):
    return P.audit_summary(table(spark, sf_dir, "events"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderdate > TIMESTAMP '1997-01-01' AND (o_orderstatus = 'O' OR o_custkey = 5 OR o_orderkey % 3 = 0))")
def results_access(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"owner": F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_custkey") == 5, "me").otherwise("other")), "expires_at": F.col("o_orderdate"), "is_public": F.col("o_orderstatus") == "O", "shared_with": F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("me")))})
    return o.where(R.accessible("me", F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("""WITH j AS (SELECT sale_id AS job_id, client_id::VARCHAR AS user, status, sold_at AS created_at FROM sales),
h AS (SELECT job_id, status, row_number() OVER (ORDER BY created_at DESC NULLS LAST, job_id) AS k FROM j WHERE status = 'held')
SELECT 'held' AS kind, job_id, status FROM h WHERE k <= 100 UNION ALL SELECT 'client', job_id, status FROM j WHERE "user" = '1'""")
def job_lists(spark, sf_dir):
    """Sales as jobs: the hundred newest held ones, and all of one client."""
    jobs = table(spark, sf_dir, "sales").select(F.col("sale_id").alias("job_id"), F.col("client_id").cast("string").alias("user"), "status", F.col("sold_at").alias("created_at"))
    held, own = R.listed(jobs, status="held", limit=100), R.listed(jobs, user="1")
    return held.select(F.lit("held").alias("kind"), "job_id", "status").unionByName(own.select(F.lit("client").alias("kind"), "job_id", "status"))
