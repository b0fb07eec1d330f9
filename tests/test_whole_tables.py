import pytest

from linkwright.catalog import ORACLE_SQL, QUERIES

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


def test_every_document_is_linked(spark):
    out = QUERIES["linkage_title_classes"](spark, SF).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.select("doc_id").distinct().count() == out.count() == docs.count()
    assert 500 < out.select("class_id").distinct().count() < docs.count()


@pytest.mark.parametrize("name", ["linkage_title_classes", "linkage_statistics", "cartesian_pairs", "blocking_ngram_pairs"])
def test_whole_queries_equal_their_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])


def test_all_pairs_of_whole_tables(spark):
    pairs = QUERIES["cartesian_pairs"](spark, SF)
    n, s = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("nation", "supplier"))
    assert pairs.distinct().count() == pairs.count() == n * s
