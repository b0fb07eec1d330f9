from linkwright.operators import linkage as L
from linkwright.operators.scoring import FieldMapping


def test_pairs_that_meet_on_an_ngram_alone_are_found_at_any_size(spark):
    a, b = (spark.createDataFrame([(1, name)], "id long, name string") for name in ("xanderson", "janderson"))
    config = {"mappings": (FieldMapping("name", "name"),)}
    assert [tuple(r) for r in L.candidates(a, b, "id", "id", L.LinkageConfig(**config)).collect()] == [(1, 1)]
    assert L.candidates(a, b, "id", "id", L.LinkageConfig(**config, strict=True)).count() == 0
