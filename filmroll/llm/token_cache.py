"""Token counts of whole texts with a public vocabulary, through a digest cache.

A cache is a Parquet table (version, digest, n_tokens) in a folder of the caller's. `digest` is the SHA-256 of the
normalised content, `version` that of the vocabulary file with the library's name and version, so counts of another
vocabulary or library are never taken. A call

1. takes the digests of all rows, and joins the distinct ones to the cache;
2. gathers one text for each digest that is missed, combined before the shuffle, and encodes it once;
3. appends the new counts, by Spark's commit of whole tasks, and joins all rows to the cache.

A digest of more than a thousandth of all rows (a thousand at most) is joined by broadcast, and its rows are dealt
out by id, so a text with a third of all rows is no hot key. Calls that append at the same time may add a digest twice;
it is read once. A call that fails leaves the cache as it was, or with more counts; either can be used again.

`normalise` must map to one text only contents of equal counts. The default leaves the content as it is, which is
right for every vocabulary.

Defined cases: a null text counts as empty; empty texts have the library's count (0 without special tokens); repeated
rows each get a row; null ids stay null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm.common import texts
from filmroll.session import broadcast_limit, shared_path, store

#: Text bytes encoded at a time.
SLICE = 1 << 20
#: A digest of more than one in so many rows is joined by broadcast; so there are fewer such digests.
HOT = 1000
#: The most tokens that a document may have without being over the limit.
LIMIT = 4096
CACHE = "digest binary, n_tokens bigint, version string"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """The library that a vocabulary file is for, loaded once by each worker."""

    _loaded: dict[str, Counter] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            coder = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda found: coder.encode(found, num_threads=1)
        else:
            from tokenizers import Tokenizer
            coder = Tokenizer.from_file(path)
            coder.no_truncation()
            coder.no_padding()
            self.ids = lambda found: [e.ids for e in coder.encode_batch_fast(found, add_special_tokens=False)]

    def counts(self, found: list[str]) -> list[int]:
        return [len(i) for i in self.ids(found)]


def version(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes() + f"{library.__name__} {library.__version__}, no added tokens".encode()).hexdigest()


def _encode(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)

        def out(digests, found):
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counter.counts(found), pa.int64())], ["digest", "n_tokens"])

        for b in batches:
            digests, found, held = [], [], 0
            for d, t in zip(b.column("digest"), b.column("text")):
                digests.append(d.as_py())
                found.append(t.as_py())
                held += len(found[-1])
                if held > SLICE:
                    yield out(digests, found)
                    digests, found, held = [], [], 0
            if digests:
                yield out(digests, found)
    return task


def new_cache(spark: SparkSession) -> str:
    """The path of a cache in the shared folder that nothing is in yet."""
    return shared_path(spark, "token-cache")


def cached(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """digest, n_tokens of version `of`, each digest once."""
    spark.createDataFrame([], CACHE).write.mode("ignore").partitionBy("version").parquet(cache)  # where there is none yet
    return (spark.read.schema(CACHE).parquet(cache).where(F.col("version") == of)
            .groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")))


def count(docs: DataFrame, cache: str, path: str | None = None, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of `docs`; what `cache` didn't hold is in it afterwards."""
    path, spark = path or default_path(), docs.sparkSession
    of = version(path)
    t = texts(docs).withColumn("digest", F.unhex(F.sha2(F.encode(normalise(F.col("text")), "UTF-8"), 256)))
    keys, facts = store(t.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "digests", rows=F.count("*"))

    digests = keys.groupBy("digest").agg(F.count("*").alias("n"))
    missed, _ = store(digests.select("digest").join(cached(spark, cache, of), "digest", "left_anti"), "missed")
    few = missed.measured_bytes <= broadcast_limit(spark)
    found = t.join(F.broadcast(missed), "digest", "left_semi") if few else t
    found = found.groupBy("digest").agg(F.any_value("text").alias("text"))
    if not few:
        found = found.join(missed, "digest", "left_semi")
    (found.mapInArrow(_encode(path), "digest binary, n_tokens bigint").withColumn("version", F.lit(of))
     .write.mode("append").partitionBy("version").parquet(cache))

    counts = cached(spark, cache, of)
    hot, _ = store(digests.where(F.col("n") > max(HOT, facts["rows"] // HOT)).select("digest"), "hot")
    hot = counts.join(F.broadcast(hot), "digest", "left_semi").withColumnRenamed("n_tokens", "n_hot")
    dealt = keys.join(F.broadcast(hot), "digest", "left").withColumn(
        "digest", F.when(F.col("n_hot").isNull(), F.col("digest")).otherwise(F.unhex(F.md5(F.encode(F.coalesce("doc_id", F.lit(0)).cast("string"), "UTF-8")))))
    return dealt.join(counts, "digest", "left").select("doc_id", "n_bytes", F.coalesce("n_hot", "n_tokens").alias("n_tokens"))


def limits(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """With `over_limit`: whether a document has more than `limit` tokens."""
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
