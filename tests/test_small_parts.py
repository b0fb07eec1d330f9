"""Parts that no query covers: throughput, reduction ratio, JSON-lines streams, stored copies, previews, job lists."""

import datetime as dt

from pyspark.sql import functions as F

from linkwright.operators import blocking, telemetry
from linkwright.operators import results as R
from linkwright.sources import files
from linkwright.streaming import monitor


def test_throughput():
    assert telemetry.throughput(1000, 500, 2.0) == 250_000.0
    assert telemetry.throughput(0, 500, 2.0) == 0.0
    assert telemetry.throughput(10, 10, 0.0) == 0.0


def test_reduction_ratio(spark):
    rows = spark.createDataFrame([(10, 10, 10, 90.0), (0, 10, 10, 100.0), (100, 10, 10, 0.0), (500, 10, 10, 0.0), (5, 0, 10, 0.0)], "pairs long, n1 long, n2 long, want double")
    got = rows.select("want", blocking.reduction_ratio(F.col("pairs"), F.col("n1"), F.col("n2")).alias("r"))
    assert all(abs(r["want"] - r["r"]) < 1e-9 for r in got.collect())


def test_a_stream_of_json_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": 1, "t": "é"}\n{"id": 2}\n')
    (folder / "b.jsonl").write_text('{"id": 3, "t": null, "more": 5}\n')
    got = monitor.run_once(files.stream(spark, str(folder), "jsonl", "id long, t string"), "append")
    assert sorted((r["id"], r["t"]) for r in got.collect()) == [(1, "é"), (2, None), (3, None)]


def test_a_stored_copy_is_read_again(spark, tmp_path):
    first = files.materialized(spark.range(5), str(tmp_path), "k")
    again = files.materialized(spark.range(7), str(tmp_path), "k")
    other = files.materialized(spark.range(7), str(tmp_path), "other")
    assert (first.count(), again.count(), other.count()) == (5, 5, 7)


def test_previews(spark):
    df = spark.createDataFrame([(i, float("nan") if i % 2 else 1.5) for i in range(300)], "i long, v double")
    assert files.preview(df).count() == 10
    assert files.preview(df, 1000).count() == 100 and files.preview(df, 0).count() == 1
    assert all(r["v"] is None or r["v"] == 1.5 for r in files.preview(df, 50).collect())


def test_lists_by_user_and_status(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 2], ["queued", "done"][i % 3 == 0], at + dt.timedelta(minutes=i % 4) if i != 5 else None) for i in range(12)]
    jobs = spark.createDataFrame(rows, "job_id long, user string, status string, created_at timestamp")
    order = sorted(rows, key=lambda r: (-(r[3] or dt.datetime(1971, 1, 1)).timestamp(), r[0]))
    ids = lambda df: [r["job_id"] for r in df.collect()]
    assert ids(R.listed(jobs)) == [r[0] for r in order]
    assert ids(R.listed(jobs, user="b")) == [r[0] for r in order if r[1] == "b"]
    assert ids(R.listed(jobs, user="b", status="queued", limit=2)) == [r[0] for r in order if r[1:3] == ("b", "queued")][:2]
    assert ids(R.listed(jobs, user="nobody")) == []
