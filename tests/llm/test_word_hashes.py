"""Long words made to be alike by any polynomial hash modulo 2**64."""

from linkwright.llm.op7_substrings import remove_repeats
from linkwright.llm.op8_decontaminate import contamination
from linkwright.llm.op10_lines import clean_lines


def thue_morse(power):
    a, b = "a", "b"
    for _ in range(power):
        a, b = a + b, b + a
    return a, b


def test_windows_of_different_long_words_are_no_repeats(spark):
    for power in (6, 9, 10, 11):
        p, q = thue_morse(power)
        equal = [f"w{i}" for i in range(49)]
        docs = spark.createDataFrame([(1, " ".join([*equal, p])), (2, " ".join([*equal, q])), (3, " ".join([*equal, q]))], "doc_id long, text string")
        assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 50}


def test_rules_count_no_false_repeats(spark):
    rows = []
    for i, power in enumerate((6, 9, 10, 11)):
        p, q = thue_morse(power)
        rows += [(2 * i, f"p q {p} r s p q {q} t u"), (2 * i + 1, f"p q {p} r s p q {p} t u")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 6 * (i % 2) for i in range(8)}


def test_items_of_different_long_words_are_not_found(spark):
    p, q = thue_morse(11)
    head = "one two three four five six seven eight nine "
    items = spark.createDataFrame([("x", head + p)], "item_id string, text string")
    docs = spark.createDataFrame([(1, head + q), (2, head + p)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in contamination(docs, items).collect()} == {1: 0, 2: 10}
