import json

import pytest
from pyspark.sql import functions as F

from linkwright.operators import blocking as B
from linkwright.operators import linkage as L
from linkwright.operators import privacy as P
from linkwright.operators import results as R
from linkwright.operators import telemetry, topk
from linkwright.operators.scoring import Algorithm, FieldMapping, register
from linkwright.plans import config as plans
from linkwright.sources import files, sinks
from linkwright.streaming import monitor

NAME = (FieldMapping("name", "name"),)


@pytest.fixture(scope="module")
def people(spark):
    a = spark.createDataFrame([(1, "John Smith", "Tashkent"), (2, "Мария Иванова", "Самарканд"), (3, "Aziz Karimov", None), (4, None, "x"), (5, "John Smith", "Tashkent")], "id long, name string, city string")
    b = spark.createDataFrame([(10, "Jon Smith", "Toshkent"), (11, "Mariya Ivanova", "Samarkand"), (12, "Somebody Else", "Nukus"), (13, "", "")], "id long, name string, city string")
    return a, b


def test_linkage(people):
    r = L.find_matches(*people, "id", "id", L.LinkageConfig((*NAME, FieldMapping("city", "city", 0.5)), strategies=("exact_prefix", "ngram", "phonetic_key")))
    pairs = {(m["id1"], m["id2"]) for m in r.matched.collect()}
    assert {(1, 10), (5, 10), (2, 11)} <= pairs and not {p for p in pairs if p[1] in (12, 13)}
    left = {x["id"] for x in r.unmatched_1.collect()}
    assert left | {a for a, _ in pairs} == {1, 2, 3, 4, 5} and not left & {a for a, _ in pairs}
    stats = r.statistics.first()
    assert stats["matches"] == len(pairs) and stats["high_confidence"] + stats["low_confidence"] == stats["matches"]
    assert all(0 <= m["confidence"] <= 100 and m["similarity"] <= m["confidence"] for m in r.matched.collect())


def test_blocked_pairs_are_among_all_pairs(people):
    all_pairs = {tuple(r) for r in L.candidates(*people, "id", "id", L.LinkageConfig(NAME, use_blocking=False)).collect()}
    some = {tuple(r) for r in L.candidates(*people, "id", "id", L.LinkageConfig(NAME)).collect()}
    assert len(all_pairs) == 20 and some <= all_pairs


def test_cardinalities(people):
    many = {}
    for kind in L.CARDINALITIES:
        m = L.find_matches(*people, "id", "id", L.LinkageConfig(NAME, cardinality=kind, threshold=60.0)).matched.collect()
        many[kind] = [(r["id1"], r["id2"]) for r in m]
    assert len({a for a, _ in many["many_to_one"]}) == len(many["many_to_one"])
    assert len({b for _, b in many["one_to_many"]}) == len(many["one_to_many"])
    assert set(many["one_to_one"]) <= set(many["many_to_one"]) & set(many["one_to_many"])


def test_strict_null_is_compared_as_text(spark):
    d = spark.createDataFrame([(1, None)], "id long, name string")
    config = dict(use_blocking=False, algorithms=(Algorithm("exact"),))
    assert L.find_matches(d, d, "id", "id", L.LinkageConfig(NAME, strict=True, **config)).matched.count() == 1
    assert L.find_matches(d, d, "id", "id", L.LinkageConfig(NAME, **config)).matched.count() == 0


def test_digits_sound_alike_only_in_strict_mode(spark):
    d = spark.createDataFrame([(1, "555-1234")], "id long, name string")
    e = spark.createDataFrame([(2, "998 77 00")], "id long, name string")
    config = dict(use_blocking=False, algorithms=(Algorithm("phonetic"),))
    assert L.find_matches(d, e, "id", "id", L.LinkageConfig(NAME, strict=True, **config)).matched.count() == 1
    assert L.find_matches(d, e, "id", "id", L.LinkageConfig(NAME, **config)).matched.count() == 0


def test_plugged_in_algorithm_and_strategy(people):
    register("same_start", lambda a, b, p: F.when(F.substring(a, 1, 2) == F.substring(b, 1, 2), 100.0).otherwise(0.0))
    B.register("first_letter", lambda c: F.array(F.lower(F.substring(F.trim(c), 1, 1))))
    r = L.find_matches(*people, "id", "id", L.LinkageConfig(NAME, (Algorithm("same_start"),), strategies=("first_letter",)))
    assert {(m["id1"], m["id2"]) for m in r.matched.collect()} == {(1, 10), (5, 10)}


def test_bad_configurations():
    for bad in (lambda: L.LinkageConfig(()), lambda: L.LinkageConfig(NAME, threshold=101), lambda: L.LinkageConfig(NAME, cardinality="x"), lambda: FieldMapping("a", "b", 0.0), lambda: Algorithm("nothing")):
        with pytest.raises(ValueError):
            bad()


def test_strategy_selection(spark):
    assert B.select_strategies(spark.createDataFrame([(1, "abc")], "id long, name string"), ["name"], "id") == ["exact_prefix"]
    assert B.select_strategies(spark.createDataFrame([(1, "мир")], "id long, name string"), ["name"], "id") == ["exact_prefix", "phonetic_key"]
    assert B.select_strategies(spark.range(1001).withColumn("name", F.lit("abc")), ["name"], "id") == ["exact_prefix", "ngram"]


def test_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("!!",), ("a b-c",)], "t string")
    got = [sorted(r[0]) for r in df.select(B.ngram_keys(F.col("t"))).collect()]
    assert got == [["abc", "bcd"], ["ab"], [], [" bc", "a b"]]
    assert sorted(df.select(B.ngram_keys(F.col("t"), skips=1)).first()[0]) == ["abc", "abd", "bcd"]


def test_top_k_loses_no_pair(spark):
    texts = [(i, "abcdefghij"[: 1 + i % 10] + "xyz"[: i % 4]) for i in range(60)] + [(99, "")]
    q, c = spark.createDataFrame(texts, "q_id long, q string"), spark.createDataFrame(texts, "c_id long, c string")
    full = q.crossJoin(c).where(1 - F.levenshtein("q", "c") / F.greatest(F.length("q"), F.length("c"), F.lit(1)) >= 0.7 - 1e-7).where("q != ''")
    got = topk.similarity_pairs(q, c, 0.7).where("q_id != 99")
    assert got.count() == full.count() == got.select("q_id", "c_id").distinct().count()


def test_anonymize(spark):
    text = "Mail bob.x@mail.example.com or call 555-123-4567 from 10.20.30.40, ssn 123-45-6789."
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id long, t string")
    got = [r["t"] for r in P.anonymize(df).orderBy("id").collect()]
    assert got[1:] == ["nothing", None]
    assert "*****@mail.example.com" in got[0] and "********4567" in got[0] and "10.20.xxx.xxx" in got[0] and "6789" in got[0] and "123-45" not in got[0]
    assert {r["pii_type"] for r in P.findings(df, "id").collect()} == {"email", "phone", "ip_address", "ssn"}
    custom = P.Policy()
    custom.add("ticket", r"T-\d+", 0.5, ("replace", {}))
    assert P.anonymize(spark.createDataFrame([("see T-12",)], "t string"), custom).first()[0] == "see [REDACTED]"


def test_generalize_hash_and_noise(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("12/25/1990",), ("12345",)], "v string")
    assert [r[0] for r in df.select(P.generalize(F.col("v"), 1)).collect()] == ["10.1.2.xxx", "12/25/1xxxx", "1234x"]
    assert df.select(F.length(P.hashed(F.col("v")))).distinct().collect()[0][0] == 8
    low, high = df.where("v = '12345'").select(P.noisy(F.col("v"), 0.1, 3).cast("double").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert 11110 <= low <= high <= 13580


def test_scan_and_protect(spark):
    df = spark.createDataFrame([(1, "a@b.example.org")], "id long, t string")
    safe, found, record = P.scan_and_protect(df, "id")
    assert safe.first()["t"] == "*@b.example.org" and found.where("kind = 'total'").first()["n"] == 1 and record.first()["n_rows"] == 1


def test_eviction_and_place(spark):
    df = spark.range(1, 101).select(F.col("id").alias("result_id"), F.lit(10).alias("size"), F.timestamp_seconds(F.col("id") * 60).alias("last_accessed"))
    gone = telemetry.evict(df, 500)
    assert sorted(r["result_id"] for r in gone.collect()) == list(range(1, 61))
    assert telemetry.evict(df, 1000).count() == 0
    got = telemetry.exact_place(df, [], "result_id", {"p95": 0.95, "p0": 0.0}).first()
    assert (got["p95"], got["p0"]) == (96, 1)


def test_files(spark, tmp_path):
    semi, pipe, empty = tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv"
    semi.write_text("id;name\n1;Ёлка\n2;x\n", encoding="utf-8")
    pipe.write_bytes("id|name\n1|Ёлка мир труд\n".encode("cp1251"))
    empty.write_text("")
    assert files.read_csv(spark, str(semi)).collect()[0]["name"] == "Ёлка"
    assert files.read_csv(spark, str(pipe)).collect()[0]["name"] == "Ёлка мир труд"
    assert files.validate(spark, str(semi)).is_valid and not files.validate(spark, str(empty)).is_valid and not files.validate(spark, str(tmp_path / "no.csv")).is_valid
    short = tmp_path / "d.csv"
    short.write_text("a,b,c\n1,2\n\n1,2,3,4\n")
    assert [tuple(r) for r in files.read_lines_csv(spark, str(short)).collect()] == [("1", "2", ""), ("1", "2", "3")]
    lines = tmp_path / "e.json"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    assert files.load(spark, str(lines)).count() == 2
    assert files.structure(spark.createDataFrame([(1, None)], "a int, b string")).warnings == ["column b is empty"]
    found = files.map_files(spark, [str(semi), str(pipe)], lambda p: __import__("pandas").DataFrame({"n": [len(open(p, "rb").read())]}), "n long")
    assert found.agg(F.sum("n")).first()[0] == semi.stat().st_size + pipe.stat().st_size


def test_protected_files(spark, tmp_path):
    from linkwright.sources import secure

    (tmp_path / "p.csv").write_text("id,mail\n1,bob@mail.example.com\n")
    df = secure.load_protected(spark, str(tmp_path / "p.csv"))
    assert df.first()["mail"] == "***@mail.example.com"
    with pytest.raises(ValueError):
        secure.load_protected(spark, str(tmp_path / "missing.csv"))
    raw = files.read_csv(spark, str(tmp_path / "p.csv"))
    assert spark.read.option("header", True).csv(secure.save_protected(raw, str(tmp_path / "out"))[0]).first()["mail"].startswith("***")
    assert secure.map_chunks_protected(raw, lambda f: f[["mail"]], "mail string").first()["mail"].startswith("***")
    seen_df, seen = telemetry.observed(raw, "rows")
    assert seen_df.count() == 1 and seen.get["rows"] == 1


def test_mapping_suggestions():
    got = files.suggest_mappings(["name", "region_code", "zzz"], ["full_name", "region", "qq"])
    assert [(m["source"], m["target"]) for m in got] == [("name", "full_name"), ("region_code", "region")]
    assert all(0.3 < m["score"] and m["weight"] <= 1 for m in got)


def test_store(spark, tmp_path):
    store = sinks.ResultStore(spark, str(tmp_path / "store"))
    df = spark.range(5)
    key = store.store(df, "ann")
    assert store.retrieve(key, "ann").count() == 5
    with pytest.raises(PermissionError):
        store.retrieve(key, "bob")
    store.share(key, ["bob", "bob"])
    assert store.retrieve(key, "bob").count() == 5 and store.index().first()["shared_with"] == ["bob"]
    store.store(spark.range(7), "ann", key)
    assert store.index().first()["version"] == 2 and store.retrieve(key, "ann").count() == 7
    store.delete(key)
    assert store.index().count() == 0


def test_jobs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,John Smith\n2,Ann Lee\n")
    (tmp_path / "b.csv").write_text("key,full\n7,Jon Smith\n8,Zed\n")
    one = {"file1": {"path": str(tmp_path / "a.csv")}, "file2": {"path": str(tmp_path / "b.csv")}, "mapping_fields": [{"file1_col": "name", "file2_col": "full", "match_type": "fuzzy"}], "settings": {"confidence_threshold": 70}}
    two = {"file1": str(tmp_path / "a.csv"), "file2": str(tmp_path / "b.csv"), "id1": "id", "id2": "key", "matching": {"mappings": [{"source_field": "name", "target_field": "full"}], "algorithms": [{"name": "exact"}], "confidence_threshold": 70}, "output": {"path": str(tmp_path / "out"), "format": "csv"}}
    for i, c in enumerate((one, two, {"broken": 1})):
        (tmp_path / f"{i}.json").write_text(json.dumps(c))
    done = plans.run_batch(spark, plans.discover(str(tmp_path), "[0-9].json"))
    assert [(o.status, o.matches) for o in done] == [("completed", 1), ("completed", 0), ("failed", 0)]
    assert plans.batch_summary(spark, done).first()["success_rate"] == pytest.approx(2 / 3)
    assert (tmp_path / "out_unmatched_1.csv").exists() and not (tmp_path / "out.csv").exists()
    assert plans.with_environment(two, {"LINK_THRESHOLD": "80"})["matching"]["confidence_threshold"] == 80.0
    assert plans.config_hash(one) == plans.config_hash(json.loads(json.dumps(one)))


def test_alert_cooldown_and_progress(spark):
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, ts = State(), pd.to_datetime([0, 100, 400, 500, 900], unit="s")
    frame = pd.DataFrame({"rule": "r", "ts": ts, "value": 1.0})
    out = pd.concat(monitor.cooled(("r",), iter([frame]), state, 300.0))
    assert [t.timestamp() for t in out["ts"]] == [0, 400, 900] and state.get == (900.0,)
    updates = spark.createDataFrame([("a", 1, "running", 1), ("a", 2, "cancelled", 1), ("a", 3, "running", 2), ("b", 1, "running", 1), ("b", 2, "running", 5)], "operation string, ts int, status string, done int")
    got = {r["operation"]: (r["status"], r["done"]) for r in monitor.progress(updates).collect()}
    assert got == {"a": ("cancelled", 1), "b": ("running", 5)}
    tried = spark.createDataFrame([(0, True), (0, False), (3, False)], "retries int, acknowledged boolean")
    assert [tuple(r) for r in monitor.after_attempt(tried).select("status", "retries").collect()] == [("done", 0), ("queued", 1), ("dead", 4)]


def test_pages_and_nan(spark):
    df = spark.range(25).select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.when(F.col("id") == 3, float("nan")).otherwise(1.0).alias("x"))
    rows, info = R.web_page(df.orderBy("id1"), 3, 10)
    assert [r["id1"] for r in rows.collect()] == [20, 21, 22, 23, 24] and info["total_pages"] == 3
    assert R.without_nan(df).where("x IS NULL").count() == 1
    assert R.as_json(df.limit(1)).first()["json"].startswith("{")


def test_entry_without_the_optional_parts():
    """Without llm and the pipeline the entry still imports."""
    import subprocess
    import sys

    code = "import sys; sys.modules['linkwright.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'linkage_matches' in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0], check=False).returncode == 0
