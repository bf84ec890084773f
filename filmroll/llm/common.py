"""Input normalisation and stored intermediate tables, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.session import attach, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id` and `text` alone, so no other column can clash; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, and a lost executor costs only its
    running tasks. The folder's owner clears it; nothing here may delete a table a lazy result still reads."""
    path = shared_path(df.sparkSession, label)
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stands for a null id in keys.
NO_ID = -(2**63)


def without(docs: DataFrame, dropped: DataFrame, text_hash: str = "text_hash") -> DataFrame:
    """`docs`, all columns, without the rows whose id and text are those of `dropped` (doc_id, text_hash)."""
    id_, hash_ = "__id__", "__hash__"
    while {id_, hash_} & {*docs.columns}:
        id_, hash_ = f"_{id_}", f"_{hash_}"
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), hash_: F.xxhash64(F.coalesce("text", F.lit("")))})
    out = dropped.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(id_), F.col(text_hash).alias(hash_)).distinct()
    return attach(keyed, out, [id_, hash_], "left_anti", label="dropped").drop(id_, hash_)


def returning(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`task`, after which the worker gives memory it no longer uses back to the system: workers are kept for later tasks of
    other operators, beside which it would count."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
    return run
