"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import ann, bpe, chat, importance, language, merkle, near_dup, ngram_join, packing, quality, suffix_dedup, toxicity, warc
from threadloom.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", "source_doc_id", "removable")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("mask_starts", "mask_ends")]
    return chat.rotate(_table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "segment", "n_turns", "n_masked", "rendered", *spans)


def _decided(scored: DataFrame, threshold: float) -> DataFrame:
    predicted: Column = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return _decided(toxicity.score(documents, toxicity.learn(documents, _table(spark, sf_dir, "labels"))), 0.5)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_sets(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), 0.3)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).alias("n_chars")  # beyond the longs too
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.digest([one_more if f == "n_chars" else F.col(f) for f in fields]))
    return merkle.manifest(_table(spark, sf_dir, "documents"), "doc_id", fields, "lang", tampered)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = language.identify(documents, language.learn(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ann": op3_ann,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality": op7_quality,
    "op8_near_dup": op8_near_dup,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_merkle": op11_merkle,
    "op12_importance": op12_importance,
    "op13_language": op13_language,
}

ORACLE_SQL: dict[str, str] = {"op4_chat": chat.ORACLE, "op11_merkle": merkle.ORACLE, "op12_importance": importance.ORACLE}
