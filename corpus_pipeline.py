"""The corpus pipeline: toxic documents go, of equal and of near-equal ones one stays, sources are mixed to their
weights, and what is left is encoded. Every stage is written as Parquet and read again by the next.

Defined cases: a null text is empty; documents without words aren't toxic, are equal to each other, are similar to nothing, and are
never drawn; ties go to the smallest doc_id, a null doc_id counting as the largest; rows that repeat id and text are one document
and stay or go together; other columns, whatever their names, are kept by all stages but the last; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm import bpe, exact_dedup, mixing, similar, toxicity
from filmroll.llm.common import stored, table, without


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a machine trained on the stage's own documents."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest, then that with the smallest id."""
    return without(docs, exact_dedup.exact_dedup(docs).where(~F.col("kept")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a Jaccard index of 0.8 or more one stays. Candidates are found by anchor points of
    fingerprints, as in op4, but of words, since fingerprints of shingles of such pairs differ in up to 13 bits."""
    return without(docs, similar.near_copies(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the weights of domains, languages and sources, repeated where a leaf is short:
    as many tokens as there are."""
    return mixing.draw(docs, fraction=1.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    return bpe.digests(docs, limits=bpe.Limits(kept=15_000, words=25_000, slice=1 << 19))  # beside what earlier stages left in an executor


STAGES = [("toxicity", not_toxic), ("exact dedup", no_copies), ("SimHash near-dedup", no_near_copies),
          ("mixing sources to target weights", mixed), ("BPE encoding and decoding", encoded)]

#: A trained machine, fingerprints and a vocabulary decide the rows: none of them can be said in SQL.
ORACLE_SQL = None


#: Whole texts that go to a Python worker at once; a session's 10,000 rows would hold most of a task's input.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
