import json

import pytest
from pyspark.sql import functions as F

from linkwright.operators import linkage as L
from linkwright.operators import privacy, telemetry
from linkwright.operators.scoring import Algorithm, FieldMapping
from linkwright.plans import config as plans
from linkwright.sources import files, sinks
from linkwright.streaming import monitor


@pytest.fixture(scope="module")
def result(spark):
    a = spark.createDataFrame([(1, "John Smith", "x"), (2, "Ann Lee", "y"), (3, "Nobody Known", "z")], "id long, name string, city string")
    b = spark.createDataFrame([(7, "John Smith", "x"), (8, "Anne Lee", "w")], "id long, name string, city string")
    return L.find_matches(a, b, "id", "id", L.LinkageConfig((FieldMapping("name", "name"), FieldMapping("city", "city", 0.5)), (Algorithm("exact"), Algorithm("fuzzy", {"method": "levenshtein"})), 55.0, use_blocking=False))


def test_comparisons_and_field_results(result):
    s = result.statistics.first()
    assert s["total_comparisons"] == 6 and s["matches"] == result.matched.count()
    one = result.matched.where("id1 = 1 AND id2 = 7").first()
    assert set(one["field_results"]) == {"name", "city"} and one["field_results"]["city"]["weighted_score"] == 50.0 and one["algorithm"] == "exact"


def test_blocked_comparisons_are_counted(spark):
    a = spark.createDataFrame([(1, "ab one"), (2, "ab two"), (3, "zz")], "id long, name string")
    r = L.find_matches(a, a, "id", "id", L.LinkageConfig((FieldMapping("name", "name"),), strategies=("exact_prefix",)))
    assert r.statistics.first()["total_comparisons"] == 5
    by_city = L.LinkageConfig((FieldMapping("name", "name"),), strategies=("whole",), block_on=(("id", "id"),))
    assert L.find_matches(a, a, "id", "id", by_city).statistics.first()["total_comparisons"] == 3


def test_fewer_pairing_keys_make_the_same_pairs(spark):
    from linkwright.operators import blocking as B

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "ab", "abc", "abcd", "abx", " Ab ", "zz", None, ""])], "id long, name string")
    whole, few = (B.index(df, "id", ["name"], ["exact_prefix"], p) for p in (False, True))
    pairs = [{tuple(r) for r in B.candidate_pairs(x, x).collect()} for x in (whole, few)]
    assert pairs[0] == pairs[1] and few.count() < whole.count()


def test_rows_without_ids_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name\nAnn Lee\nAnn Lee\nZed\n")
    (tmp_path / "b.csv").write_text("full\nAnn Lee\n")
    job = plans.Job(str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), L.LinkageConfig((FieldMapping("name", "full"),), (Algorithm("exact"),)), output=str(tmp_path / "out"), format="csv", prefixes=("l_", "r_"), sure=101.0)
    r = plans.run(spark, job)
    assert r.matched.count() == 2 and r.unmatched_1.count() == 1
    out = spark.read.option("header", True).csv(str(tmp_path / "out.csv"))
    assert {"match_score", "l_name", "r_full"} <= set(out.columns) and out.count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out_low_confidence.csv")).count() == 2


def test_exports(spark, result, tmp_path):
    path = sinks.export_result(result, sinks.Export("csv", least=100.0), str(tmp_path), "a")
    assert spark.read.option("header", True).csv(path).count() == 1
    empty = sinks.export_result(result, sinks.Export("csv", least=101.0), str(tmp_path), "b")
    assert spark.read.option("header", True).csv(empty).count() == 0
    sinks.export_result(result, sinks.Export("json", unmatched=False), str(tmp_path), "c")
    assert json.loads((tmp_path / "export_c.json" / "metadata.json").read_text())["metadata"]["threshold"] == 55.0 and not (tmp_path / "export_c.json" / "unmatched_1").exists()
    back = sinks.load_result(spark, sinks.save_result(result, str(tmp_path / "typed")))
    assert back.matched.dtypes == result.matched.dtypes and back.metadata["threshold"] == 55.0
    with pytest.raises(ValueError):
        sinks.Export("xml")
    store = sinks.ResultStore(spark, str(tmp_path / "store"))
    key = store.store(result.matched, "ann")
    assert spark.read.option("header", True).csv(sinks.export_stored(store, key, "ann", sinks.Export(), str(tmp_path))).count() == result.matched.count()
    with pytest.raises(PermissionError):
        sinks.export_stored(store, key, "bob", sinks.Export(), str(tmp_path))
    assert store.list("ann").count() == 1 and store.list("bob").count() == 0


def test_download(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', 2.345), (2, None, None)], "id int, t string, x double")
    assert sinks.download_csv(df, str(tmp_path / "d.csv")) == 2
    raw = (tmp_path / "d.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines()[1] == '"1","say ""hi"", ok","2.35"' or '"2.34"' in raw.decode()
    assert files.read_csv(spark, str(tmp_path / "d.csv")).columns == ["id", "t", "x"]
    sinks.download(spark, str(tmp_path / "d.csv"), str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_sessions_and_reports(spark, tmp_path):
    config = {"matching": {"mappings": [{"source_field": "a", "target_field": "b"}]}}
    plans.save_session(spark, config, str(tmp_path), "one")
    assert plans.load_session(spark, str(tmp_path), "one") == config
    document = json.loads((tmp_path / "one.session.json").read_text())
    document["config"]["matching"]["confidence_threshold"] = 1
    (tmp_path / ".one.session.json.crc").unlink()
    (tmp_path / "one.session.json").write_text(json.dumps(document))
    with pytest.raises(ValueError):
        plans.load_session(spark, str(tmp_path), "one")
    plans.save_batch_report(spark, [plans.Outcome("x", "completed", 3), plans.Outcome("y", "failed", error="no")], str(tmp_path / "r.json"))
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["summary"]["matches"] == 3 and [j["status"] for j in report["jobs"]] == ["completed", "failed"]


def test_validation_by_format(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nbroken\n')
    (tmp_path / "c.csv").write_text("a;b\n1;2\n")
    (tmp_path / "d.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "e.csv").write_text("a,b\n1,<script>x</script>\n")
    (tmp_path / "f.csv").write_bytes(b"MZ\x90\x00")
    v = files.validate(spark, str(tmp_path / "a.json"))
    assert v.is_valid and v.metadata["layout"] == "array" and v.metadata["sample_rows"] == 2
    v = files.validate(spark, str(tmp_path / "b.jsonl"))
    assert not v.is_valid and v.metadata["broken"] == 1
    assert files.validate(spark, str(tmp_path / "c.csv")).metadata["delimiter"] == ";"
    v = files.validate(spark, str(tmp_path / "d.xlsx"))
    assert v.warnings or not v.is_valid
    assert files.columns_of(spark, str(tmp_path / "c.csv")) == ["a", "b"] and files.info(spark, str(tmp_path / "c.csv"))["rows"] == 1
    report = {r["path"].rsplit("/", 1)[1]: r for r in files.security_report(spark, [str(tmp_path / x) for x in ("c.csv", "e.csv", "f.csv", "none.csv")]).collect()}
    assert report["c.csv"]["is_valid"] and not report["e.csv"]["is_valid"] and "script" in report["e.csv"]["errors"][0]
    assert any("program" in e for e in report["f.csv"]["errors"]) and not report["none.csv"]["is_valid"]


def test_positions_of_personal_data(spark):
    text = "é bob@x.example.com and 555-123-4567, again 555-123-4568"
    got = [(r["pii_type"], r["value"], r["start"], r["end"]) for r in privacy.positions(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id long, t string"), "id", "t").collect()]
    assert got and all(text[a:b] == v for _, v, a, b in got) and {k for k, *_ in got} == {"email", "phone"}


def test_places_of_skewed_values(spark):
    rows = [("a", float(v)) for v in [1] * 500 + list(range(100)) + [10**9]] + [("b", 5.0)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p50"], r["p99"], r["top"]) for r in telemetry.exact_place(df, ["k"], "v", {"p50": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    a = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (a[300], a[int(0.99 * 601)], a[-1]), "b": (5.0, 5.0, 5.0), None: (2.0, 2.0, 2.0)}


def test_alerts_hold_for_their_time(spark):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [(at(0), "user_satisfaction", 0.5), (at(5), "user_satisfaction", 0.5), (at(10), "user_satisfaction", 0.5), (at(15), "user_satisfaction", 0.9), (at(20), "user_satisfaction", 0.1), (at(20), "up", 0.0)]
    m = spark.createDataFrame(rows, "t string, metric string, value double").select(F.to_timestamp("t").alias("window_start"), "metric", "value")
    got = {(r["alert"], r["window_start"].minute) for r in telemetry.alerting(m).collect()}
    assert got == {("LowUserSatisfaction", 10), ("ServiceDown", 20)}


def test_queue(spark):
    q = monitor.put(spark.createDataFrame([(1, 1, "b"), (2, 5, "a"), (3, 5, "b")], "job_id long, priority int, created_at string"))
    assert [r["job_id"] for r in monitor.take(q, 2).collect()] == [2, 3]
    tried = spark.createDataFrame([(2, True), (3, False)], "job_id long, acknowledged boolean")
    after = {r["job_id"]: (r["status"], r["retries"]) for r in monitor.settle(q, tried).collect()}
    assert after == {1: ("queued", 0), 2: ("done", 0), 3: ("queued", 1)}
    done = monitor.work(q, lambda m: m.withColumn("acknowledged", F.col("job_id") != 3), max_retries=1)
    assert {r["job_id"]: r["status"] for r in done.collect()} == {1: "done", 2: "done", 3: "dead"}
    assert monitor.dead_letters(done).count() == 1


def test_tables_of_their_own(spark, tmp_path):
    jobs = sinks.LogTable(spark, str(tmp_path / "jobs"), "job_id string, status string, at long", "job_id")
    assert jobs.rows().count() == 0
    jobs.put(spark.createDataFrame([("a", "queued", 1), ("b", "queued", 2)], "job_id string, status string, at long"))
    jobs.put(spark.createDataFrame([("a", "done", 3)], "job_id string, status string, at long"))
    assert {(r["job_id"], r["status"]) for r in jobs.rows().collect()} == {("a", "done"), ("b", "queued")}
    assert [r["job_id"] for r in jobs.newest("at", 1).collect()] == ["a"]
    jobs.remove(spark.createDataFrame([("b",)], "job_id string"))
    assert [r["job_id"] for r in jobs.rows().collect()] == ["a"]


def test_codecs_and_empty_tables(spark, tmp_path):
    store = sinks.ResultStore(spark, str(tmp_path / "store"))
    key = store.store(spark.range(1000), "ann")
    assert store.compress(key) in ("zstd", "gzip", "snappy") and store.retrieve(key, "ann").count() == 1000 and store.index().first()["version"] == 2
    assert sinks.save(spark.range(0), str(tmp_path / "none"), "both") == [] and not (tmp_path / "none.csv").exists()
    assert [p.rsplit(".", 1)[1] for p in sinks.save(spark.range(3), str(tmp_path / "some"), "both")] == ["csv", "json"]
    m = telemetry.measured(spark.range(7), "seven")
    assert m["rows"] == 7 and m["ms"] > 0


def test_scratch_tables_go(spark):
    import os

    from linkwright import storage

    with storage.scratch(spark):
        gone = storage.stored(spark.range(3), "gone")
        kept = storage.stored(gone, "kept", keep=True)
        path = gone.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path) and kept.count() == 3
    assert storage.clean(spark, 1e6) == 0
    storage.forget(kept)
