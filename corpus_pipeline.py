"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

``run`` applies the stages to ``documents``. Each stage's rows are written as Parquet in the shared folder
and read back as the next one's input.

Defined results, in every stage but the last: rows come back with all their columns as they were, whatever these are called;
an empty table gives an empty one; a null text counts as empty. What each stage does with nulls, ties and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, lang_id, mixing, queries, simhash
from tessera.llm._common import scratch, small_batches

#: Words a worker remembers: fewer than in a job of its own, since the workers hold what other stages need as well.
REMEMBERED = 100_000


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: those with letters whose label is null, unknown or not contradicted by their text.

    Null and empty texts have no letters and go; repeated rows are each judged alike; ids play no part.
    """
    small_batches(spark)
    return lang_id.keep_known(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, a null id after all others.

    Among rows that share this id the smallest hash of all columns decides, and equal rows are one. Texts without words are near duplicates of each other.
    """
    small_batches(spark)
    return simhash.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark stay, by their own id and text: a null id or one of several documents does not matter, and repeated rows stay or go together."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture asks for, once at least; a null source is one of its own, and repeated rows are dealt together."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens and ids_crc32 of each row, null ids first, an empty text as the end id alone."""
    small_batches(spark)
    return queries.tokens(docs, REMEMBERED)


STAGES = [("language_id", languages), ("simhash_dedup", dedup), ("decontamination", clean), ("mixing", mix), ("token_file", tokens)]

#: Model, fingerprint and tokenizer stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
