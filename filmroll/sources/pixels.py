"""Reading decoded samples and writing developed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.constants import FLOAT_SAMPLES, SAMPLE_MAX
from filmroll.functions.pixel import map_rgb
from filmroll.operators.pixels import FRAME, PLACE
from filmroll.session import attach, known_bytes
from filmroll.sources.versions import Head, Versions


def normalise_samples(df: DataFrame, sample_type: str) -> DataFrame:
    """Integer samples become [0, 1] doubles (cast, then divide); floating samples stay as they are."""
    if sample_type in FLOAT_SAMPLES:
        return map_rgb(df, lambda c: c.cast("double"))
    if sample_type not in SAMPLE_MAX:
        raise ValueError(f"unsupported sample type {sample_type}")
    return map_rgb(df, lambda c: c.cast("double") / SAMPLE_MAX[sample_type])


def read_pixels(spark: SparkSession, path: str, sample_type: str) -> DataFrame:
    return normalise_samples(spark.read.parquet(path), sample_type)


FILE_BYTES = 128 * 1024 * 1024


def _files(df: DataFrame, file_bytes: int) -> int:
    """How many files to write: by the measured size of a stored table, or as many as the session shuffles to."""
    spark, size = df.sparkSession, known_bytes(df)
    known = size // file_bytes if size is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, known)


def write_pixels(df: DataFrame, path: str, file_bytes: int = FILE_BYTES, clustered: bool = False) -> None:
    """Clustered by roll, frame and row, so a frame's row groups can be skipped by their statistics and
    a large roll is spread over many files. `clustered`: they are already, and neither moved nor sorted."""
    if clustered:
        df.write.mode("error").parquet(path)
        return
    df.repartitionByRange(_files(df, file_bytes), *FRAME, "y").sortWithinPartitions(*FRAME, *PLACE).write.mode("error").parquet(path)


def _developed_key(by: list[str]):
    return F.concat_ws("/", *[F.col(c).cast("string") for c in by])


def write_developed(df: DataFrame, path: str, policy: str = "error", by: list[str] = FRAME, file_bytes: int = FILE_BYTES) -> Head:
    """Developed pixels, kept by roll and frame (or whatever `by` names), in a new version of the table at `path`.
    `policy`: "error" refuses a table that exists, "overwrite" replaces only what is being written, "skip-existing"
    adds what is not there yet. All of a write appears at once or nothing does, and a writer that another overtook is refused."""
    if policy not in ("error", "overwrite", "skip-existing"):
        raise ValueError(f"unknown policy {policy}")
    held = Versions(df.sparkSession, path)
    head = held.head()
    if policy == "error" and head.version:
        raise FileExistsError(f"{path} holds developed frames already")
    files = _files(df, file_bytes)
    keyed = df.withColumn("_by", _developed_key(by))
    if policy == "skip-existing" and head.writes:
        there = df.sparkSession.createDataFrame([(k,) for _, k in head.writes], "_by string")  # a name for each folder
        keyed = attach(keyed, there, ["_by"], "left_anti", "written")
    ready = keyed.repartitionByRange(files, *FRAME, "y").sortWithinPartitions(*FRAME, *PLACE)
    return held.commit([held.stage(ready, "developed", "_by", replaces=policy == "overwrite")], head)


def read_developed(spark: SparkSession, path: str, schema, version: Head | None = None, keys: set[str] | None = None) -> DataFrame:
    """The frames of the newest version, or of one read before; `keys` ("roll/frame") names some."""
    return Versions(spark, path).read("developed", schema, version, keys)
