"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Misra-Gries counters (`freqItems`: every digest above `support` of the rows survives in at most 1/support
counters) name the digests that could be frequent. Their rows are counted exactly, map-side first; the verified
ones, at most 1/support rows, are broadcast with their winner and answer their copies without a shuffle. The
remaining digests, none of them frequent, take the ordinary shuffle.

Texts are equal when identical after deleting space and U+0009-U+000D. Of equal texts the one with most code points
stays, then the smallest doc_id. Defined cases: a null text is empty, and empty texts equal one another; a null
doc_id counts as larger than any other; rows that repeat the id of the row that stays are that document and stay
with it (`group_size` counts them); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import stored, texts

SUPPORT = 0.001
WHITE = "[\\x20\\x09-\\x0D]+"


def digests(docs: DataFrame) -> DataFrame:
    """One thin row per document: id, code points, digest of the text without white space."""
    t = texts(docs)
    return t.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("text_hash"),
                    F.unhex(F.sha2(F.regexp_replace("text", WHITE, ""), 256)).alias("digest"))


def _winner(rows: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id")))
    return (rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))
            .select("digest", "group_size", F.col("best.doc_id").alias("keep_id")))


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """At most 1/support candidates, among them every digest with more than `support` of the rows."""
    found = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], support)
    return found.select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest"))


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and text_hash (of the text as it is) for every row of `docs`."""
    rows = stored(digests(docs), "digests")
    frequent = stored(frequent_digests(rows, support), "frequent")
    heavy = stored(_winner(rows.join(F.broadcast(frequent), "digest")).where("group_size > 1"), "heavy")
    copies = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    ordinary = rest.join(_winner(rest), "digest")
    return copies.select(ordinary.columns).union(ordinary).select(
        "doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "text_hash")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, length(text) AS n, sha256(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256 FROM t),
w AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w"""
