"""The numbered queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filmroll.llm import bpe, chroma, exact_dedup, licenses, mixing, repeats, runs, secrets, simhash, token_cache, toxicity, trie, warc
from filmroll.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(warc.plan(table(spark, sf_dir, "pages")))
    return warc.digests(warc.read(archives, payload=False))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(chroma.recordings(table(spark, sf_dir, "embeddings")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_loops(table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.limits(token_cache.count(table(spark, sf_dir, "documents"), token_cache.new_cache(spark)))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_license_scan, op4_simhash_near_dedup, op5_chroma_fingerprints, op6_secret_scan, op7_exact_dedup,
                                  op8_bpe, op9_mixing, op10_suffix_dedup, op11_periodic_runs, op12_prefix_trie, op13_token_counts)}
ORACLES = {"op2_warc": warc.ORACLE, "op3_license_scan": licenses.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op9_mixing": mixing.ORACLE,
           "op12_prefix_trie": trie.ORACLE}
