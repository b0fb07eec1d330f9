"""One very long text, clashing column names and empty tables, through every operator."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkwright.llm import op1_rans, op2_simhash, op3_counts, op4_quality, op5_language, op6_toxicity, op7_substrings, op8_decontaminate, op9_dropout, op10_lines

from . import brute

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
UNIT, N = "alpha beta gamma delta ", 870_000  # 20 MB


@pytest.fixture(scope="module")
def long(spark):
    return spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(UNIT), N).alias("text"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([("a", "Alpha beta, gamma delta alpha beta gamma delta alpha beta!"), ("b", "beta alpha")], "item_id string, text string")


def classifiers():
    machine = op4_quality.Machine()
    machine.w, machine.fitted = np.random.default_rng(1).normal(size=machine.w.shape), True
    lexicon = op6_toxicity.Lexicon({}, {})
    model = (["de", "en"], np.random.default_rng(2).normal(-9, 1, (op5_language.BUCKETS + 1, 2)).astype(np.float32))
    return {"op4": lambda df: op4_quality.classify(df, machine), "op5": lambda df: op5_language.predict(df, model), "op6": lambda df: op6_toxicity.classify(df, lexicon)}


def test_a_text_of_20_mb(spark, long, benchmark):
    r = op1_rans.read_documents(spark, op1_rans.encode_documents(long, BPE, 2)).first()
    unit = Tokenizer.from_file(BPE).encode(UNIT, add_special_tokens=False).ids
    assert np.array_equal(np.frombuffer(r["ids"], "<u4"), np.r_[np.tile(unit, N), 2])
    # the shingles are four, in equal numbers but for the last ones
    r = op2_simhash.near_duplicates(long).first()
    assert r["fingerprint"] == f"{brute.fingerprint(UNIT * 400):016x}" and r["component_id"] == 0
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    per = len(model.encode(UNIT * 3)) - len(model.encode(UNIT * 2))
    r = op3_counts.count_tokens(long, PIECES).first()
    assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(UNIT) * N, len(model.encode(UNIT)) + per * (N - 1), True)
    r = op7_substrings.remove_repeats(long).select("n_words", "n_removed", F.length("kept_text").alias("n")).first()
    assert tuple(r) == (4 * N, 0, len(UNIT) * N - 1)
    r = op8_decontaminate.contamination(long, benchmark).select("n_words", "n_hit", "items").first()
    assert tuple(r) == (4 * N, 4 * N - 2, ["a"])  # the last window ends two words before the end
    r = op9_dropout.decode(op9_dropout.encode(long, PIECES), PIECES).select("n_ids", F.expr("decoded <=> text").alias("same")).first()
    assert r["same"] and r["n_ids"] > per * N
    r = op10_lines.clean_lines(long).drop("clean_text", "text").first()
    assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (4 * N, 19 * N, 4 * N, True, False)
    for classify in classifiers().values():
        r = classify(long).select("score").first()
        assert 0 <= r["score"] <= 1


def test_clashing_names_and_empty_tables(spark, benchmark):
    names = ["n_bytes", "n_tokens", "over_limit", "score", "predicted", "lang_pred", "n_words", "n_removed", "kept_text", "n_hit", "hit_words", "items", "ids", "n_ids", "decoded", "word_chars", "kept", "clean_text", "fp", "__spans", "label", "node", "a b"]
    rows = [(1, "a text of words"), (1, "a text of words"), (2, None), (None, "")]
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("mine") for n in names})
    whole = classifiers() | {
        "op3": lambda df: op3_counts.count_tokens(df, PIECES), "op7": op7_substrings.remove_repeats, "op8": lambda df: op8_decontaminate.contamination(df, benchmark),
        "op9": lambda df: op9_dropout.decode(op9_dropout.encode(df, PIECES), PIECES), "op10": op10_lines.clean_lines,
    }
    for name, run in whole.items():
        plain, out = run(clash.select("doc_id", "text")), run(clash)
        assert sorted(map(repr, out.select(plain.columns).collect())) == sorted(map(repr, plain.collect())), name
        kept = [n for n in names if n not in plain.columns and n != "__spans"]
        assert out.where(" OR ".join(f"`{n}` != 'mine'" for n in kept)).count() == 0, name
        assert set(kept) <= set(out.columns) and run(clash.limit(0)).count() == 0, name
    assert op2_simhash.near_duplicates(clash).count() == 4 and op2_simhash.near_duplicates(clash.limit(0)).count() == 0
    assert op2_simhash.keep_one(clash).columns == clash.columns
    assert op1_rans.read_documents(spark, op1_rans.encode_documents(clash, BPE, 2)).count() == 4
