from linkwright.catalog import ORACLE_SQL, QUERIES

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


def test_every_job_has_its_place(spark):
    out = QUERIES["job_queue_places"](spark, SF)
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert sorted(r["place"] for r in out.collect()) == list(range(1, n + 1)) and n > 100
    assert_same(out, connect(SF), ORACLE_SQL["job_queue_places"])
