"""Shared storage, cut lineage and size-checked joins.

Per-frame parameters are small next to the pixels they apply to, but "small" is checked, never
assumed: `attach` knows the parameter table's measured size, broadcasts it below a byte limit and
otherwise falls back to a shuffle join, of which the adaptive plan splits a hot frame or roll over many tasks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES_CONF = "spark.filmroll.broadcastBytes"
BROADCAST_BYTES = 64 * 1024 * 1024

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. A local session without one gets a fresh folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_dirs[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/filmroll-{label}-{uuid.uuid4().hex}"


def _column_bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.length(c), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        # nested values by the length of their text, which grows with every element and string in them
        return F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) * 3 + 16 * kind.simpleString().count(":") + 64
    return F.lit(16)


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size in memory, from real lengths."""
    return sum((_column_bytes(f) for f in df.schema.fields), F.lit(32)).cast("bigint")


def store(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write once, read back: cuts the lineage and keeps later passes from recomputing `df`. The write
    also measures the table (`bytes`) and any further `metrics`, so that needs no job of its own."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    seen = Observation()
    measured = df.observe(seen, F.sum(row_bytes(df)).alias("bytes"), *[m.alias(k) for k, m in metrics.items()])
    measured.write.mode("error").parquet(path)
    facts = dict(seen.get)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.measured_bytes = int(facts["bytes"] or 0)
    stored.path = path
    return stored, facts


def materialize(df: DataFrame, label: str) -> DataFrame:
    return store(df, label)[0]


def known_bytes(df: DataFrame) -> int | None:
    """The measured size of a stored table; it also bounds any selection of its columns and rows."""
    return getattr(df, "measured_bytes", None)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES)))


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", label: str = "params", size: int | None = None) -> DataFrame:
    """Join `small` to `big`. A small table that is not stored yet is stored, which measures it; `size`
    passes an upper bound already measured instead. Beyond the limit it is a shuffle join, whose hot keys the
    adaptive plan splits."""
    if size is None:
        size = known_bytes(small)
    if size is None:
        small = materialize(small, label)
        size = small.measured_bytes
    return big.join(F.broadcast(small) if size <= broadcast_limit(big.sparkSession) else small, on, how)
