"""A corpus pipeline of five operators: documents in, token ids out.

Every stage is written as Parquet to the shared folder and read again, so a lost
executor repeats a part of one stage at most.  All stages but the last return
the columns of ``documents``.

1. toxicity: documents that the pattern grammar rejects go.
2. SimHash near-dedup: of each component one document stays, the smallest doc_id.
3. substring dedup: words in repeated passages go; texts that lose words become
   the kept words joined by a space, and n_chars follows; a document that loses
   all its words goes.
4. benchmark decontamination: documents with a window of an item go.
5. SentencePiece: seeded merge-dropout ids, decoded again as a check.

Defined results.  Every stage takes nulls in any column: a null text is clean,
has fingerprint zero (so of all texts without words one stays), no words to cut
or find; a null doc_id passes, and counts as the greatest where the smallest
stays.  Empty texts and very long ones (read whole) are treated alike.  Repeated
rows of one doc_id and text are copies: one stays.  Empty tables, also of labels
or benchmark items, give empty or unchanged ones.  Extra columns come out as they
came in, whatever their names, as do those of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import op6_toxicity as toxicity
from linkwright.llm import op9_dropout as dropout
from linkwright.llm.labelled import sample
from linkwright.llm.op2_simhash import keep_one
from linkwright.llm.op7_substrings import remove_repeats
from linkwright.llm.op8_decontaminate import contamination
from linkwright.llm.shared import documents, forget, scratch, stored


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no operator's result can take the name of one of them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(True).alias("__")).alias("__others"))


def unpacked(rows: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of like again; changed: those with new values."""
    whole = {c: F.col(c) if c in ("doc_id", "text") else F.col("__others")[c] for c in like.columns}
    return rows.select(*[changed.get(c, whole[c]).alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(sample(docs, labels, "toxic", 5, 0, toxicity.ROWS))
    return unpacked(toxicity.classify(packed(docs), lexicon).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeats(packed(docs)).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    if "n_chars" not in docs.columns:
        return unpacked(out, docs, text=text)
    n_chars = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__others")["n_chars"])
    return unpacked(out, docs, text=text, n_chars=n_chars)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unpacked(contamination(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit = 0"), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = dropout.decode(dropout.encode(docs.select("doc_id", "text"), model), model)
    return out.select("doc_id", F.col("n_ids").alias("n_tokens"), "ids", F.expr("decoded <=> text").alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_and_decode),
]

#: SQL expresses neither the grammar nor XXH64 nor the model; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage stores on its way goes when its result is stored
            docs = stored(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            forget(before)
        before = docs
    return docs
