"""From documents to training sequences, in stages that each call one operator.

Every stage works on all rows its predecessor kept. Decisions are taken row by row, whether doc_ids are null or repeat;
of near copies one row stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import ngram_join, packing, quality, suffix_dedup, toxicity
from threadloom.llm.common import begin_stage, bounded_join, delete, keyed, lasting_path, small_batches, unused, work_table

QUALITY, TOXIC = 0.3, 0.5
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage begins once the rows of the one before are written, so that one's work tables go first. One pipeline runs in an application at a time."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        begin_stage(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least QUALITY; null and empty texts are scored like others. An empty table gives no rows.

    Every row is decided by itself, whatever its doc_id; the keys of rejected rows are broadcast only if counted to be few.
    """
    key = unused(docs, "row_key")
    rows = keyed(docs, "quality-rows", key)
    scored = quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), key)
    gone = work_table(scored.filter(F.col("score") < QUALITY).select(F.col("doc_id").alias(key)), "rejected")
    return bounded_join(rows, gone, [key], "left_anti").select(*docs.columns)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under TOXIC, each decided by itself. Without labels of both kinds all or none go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, TOXIC)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (the smallest doc_id, nulls last): five-word shingles and a similarity of 0.8. Texts without words all stay."""
    return ngram_join.keep_one(docs, words=5, percent=80)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that a smaller document or an earlier place holds; a row that loses all its words goes.

    Rows with a null doc_id take part under keys beyond all ids. n_chars, where there is one, is counted anew.
    """
    key, own = unused(docs, "row_key"), unused(docs, "own_id")
    rows = keyed(docs, "repeats-rows", key)
    named = rows.withColumn(own, F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(1 << 62) + F.col(key)))
    return suffix_dedup.cut_repeats(named, key=key).withColumn("doc_id", F.col(own)).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list = [("quality", keep_good), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir; each stage's rows are written and read again by the next, and then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES:
        path = lasting_path(spark, f"stage-{name}")
        out = f(spark, docs, sf_dir)
        with small_batches(spark):
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
