import corpus_pipeline as cp
from pyspark.sql import functions as F

from linkwright.llm import op6_toxicity as toxicity
from linkwright.llm import op9_dropout as dropout
from linkwright.llm.labelled import sample

from . import brute

KINDS = {"intent": toxicity.INTENTS, "harm": toxicity.HARMS, "target": toxicity.TARGETS, "negation": toxicity.NEGATIONS, "report": toxicity.REPORTS, "insult": toxicity.INSULTS}


def test_stages_against_brute_force(spark, sf):
    """Each stage against a plain version of its decision, on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    now, model = docs, dropout.Model(cp.public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in cp.STAGES:
        given = sorted((r["doc_id"], r["text"]) for r in now.collect())
        out = stage(spark, now, sf).cache()
        if name == "toxicity":
            lexicon = toxicity.learn(sample(now, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", 5, 0, toxicity.ROWS))
            want = [(i, t) for i, t in given if brute.toxicity(t, KINDS, lexicon.learned, lexicon.rates) < 0.5]
        elif name == "near_dedup":
            label = brute.components([i for i, _ in given], [brute.fingerprint(t) for _, t in given])
            want = [(i, t) for i, t in given if label[i] == i]
        elif name == "substring_dedup":
            kept = [(i, t, brute.words(t), k) for (i, t), k in zip(given, brute.kept_words(given), strict=True)]
            want = [(i, t if len(ws) == len(k) else " ".join(k)) for i, t, ws, k in kept if k or not ws]
        elif name == "decontamination":
            want = [(i, t) for i, t in given if not brute.contaminated(t, items)[1]]
        else:
            table = dict(given)
            got = out.collect()
            assert {r["doc_id"] for r in got} == set(table) and all(r["lossless"] for r in got)
            for r in got:
                ids = memoryview(r["ids"]).cast("I").tolist()
                assert b"".join(model.bytes[k] for k in ids)[1:].decode() == table[r["doc_id"]] and len(ids) == r["n_tokens"]
            break
        assert out.columns == docs.columns
        assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(want)
        now = out


def test_stages_keep_columns_and_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", 0, "mine", 1.5), (2, "", None, None, None, None, None), (None, "a text without an id", "en", "s", 20, "x", 2.0), (3, "a text", "en", "s", 6, "y", 0.0), (3, "a text", "en", "s", 6, "y", 0.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            docs = out.cache()
        assert {r["n_words"] for r in docs.where("doc_id = 3 OR doc_id IS NULL").collect()} <= {"x", "y"}
        cp.STAGES[-1][1](spark, docs, sf).collect()


def test_run_is_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf).cache()
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "n_tokens", F.crc32("ids"), "lossless").collect()))
    want = rows(docs)
    assert rows(cp.run(spark, sf)) == want and want and all(r[-1] for r in want)
