"""Driver queries of the dealt operators; each derives its contract's columns from its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op4_quality as quality
from . import op5_language as language
from . import op6_toxicity as toxicity
from . import op9_dropout as dropout
from . import op12_bytes as byte_bpe
from . import oracles
from .labelled import sample
from .op1_rans import encode_documents, read_documents
from .op2_simhash import near_duplicates
from .op3_counts import count_tokens
from .op7_substrings import remove_repeats
from .op8_decontaminate import contamination
from .op10_lines import clean_lines
from .op11_phrases import collocations
from .op13_clicks import deduplicate
from .shared import documents, remainder


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = encode_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = quality.learn(sample(docs, _labels(spark, sf_dir), "quality", 4, 2, quality.ROWS))
    return quality.classify(docs, machine).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.learn(docs, remainder("doc_id", 4) != 2)
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = toxicity.learn(sample(docs, _labels(spark, sf_dir), "toxic", 5, 0, toxicity.ROWS))
    return toxicity.classify(docs, lexicon).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op9_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_tokens and ids_crc32 of the varied ids, and whether they decode to the whole text again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = dropout.decode(dropout.encode(documents(spark, sf_dir).select("doc_id", "text"), model), model)
    return out.select("doc_id", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.expr("decoded <=> text").alias("lossless"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), ranks).drop("text")
    return byte_bpe.decode(ids, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


QUERIES = {f.__name__: f for f in (op1_rans, op2_simhash, op3_counts, op4_quality, op5_language, op6_toxicity, op7_substrings, op8_decontaminate, op9_dropout, op10_lines, op11_phrases, op12_bytes, op13_clicks)}
ORACLE_SQL = {"op7_substrings": oracles.OP7, "op8_decontaminate": oracles.OP8, "op10_lines": oracles.OP10, "op11_phrases": oracles.OP11, "op13_clicks": oracles.OP13}
