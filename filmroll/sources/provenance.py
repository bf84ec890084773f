"""The JSON record of how a developed file was made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import PROVENANCE_KEY
from filmroll.functions.pixel import is_finite
from filmroll.operators.pixels import FRAME
from filmroll.session import attach

RECORD = ("struct<output:string,version:string,linear_scale:double,exposure:double,contrast:double,"
          "white_balance:array<double>,density_scale:array<double>,film_stock:string,scan_gain:double>")


def provenance_record(description: Column, key: str = PROVENANCE_KEY) -> Column:
    """The record inside a file's description; NULL for anything that isn't one."""
    return F.from_json(description, f"struct<`{key}`:{RECORD}>")[key]


def read_provenance(files: DataFrame, key: str = PROVENANCE_KEY) -> DataFrame:
    return files.withColumn("record", provenance_record(F.col("description"), key))


def with_provenance(frame_tone: DataFrame, profiles: DataFrame, version: str, key: str = PROVENANCE_KEY) -> DataFrame:
    """Adds `description`. `profiles` has one row per frame (six calibration columns, film_stock, gain). A
    value that isn't a finite number gives a `problem` instead of a record."""
    rows = attach(frame_tone, profiles, FRAME, "left", "profiles")
    flat = F.col("mode") == "linear"
    wb, scale = (F.array(*[f"{k}_{c}" for c in ("r", "g", "b")]) for k in ("wb", "s"))
    known = F.col("wb_r").isNotNull()
    record = F.struct(
        F.when(flat, "flat").otherwise("print").alias("output"), F.lit(version).alias("version"),
        F.when(flat, F.col("linear_scale")).alias("linear_scale"),
        F.when(~flat, F.col("exposure")).alias("exposure"), F.when(~flat, F.col("grade")).alias("contrast"),
        F.when(known, wb).alias("white_balance"), F.when(known, scale).alias("density_scale"),
        F.when(F.col("film_stock") != "", F.col("film_stock")).alias("film_stock"),
        F.when(F.col("gain") != 1.0, F.col("gain")).alias("scan_gain"))
    needed = F.when(flat, F.col("linear_scale").isNotNull()).otherwise(
        F.col("exposure").isNotNull() & F.col("grade").isNotNull())
    numbers = [F.when(flat, F.col("linear_scale")), F.when(~flat, F.col("exposure")), F.when(~flat, F.col("grade")),
               *[F.col(f"{k}_{c}") for k in ("wb", "s") for c in ("r", "g", "b")], F.col("gain")]
    fine = needed
    for number in numbers:
        fine = fine & (number.isNull() | is_finite(number))
    return rows.select(
        *frame_tone.columns, F.when(fine, F.to_json(F.struct(record.alias(key)))).alias("description"),
        F.when(~fine, "the printing decision isn't a finite number").alias("problem"))


def reject_positives(files: DataFrame, printing: bool = False) -> DataFrame:
    """Adds `rejected`: developing refuses anything already developed, printing only finished prints."""
    output = provenance_record(F.col("description"))
    refused = F.when(output.isNull(), F.lit(None).cast("string"))
    if printing:
        refused = refused.when(output["output"] == "print", "already a print: printing expects a flat positive")
    else:
        refused = refused.otherwise(F.lit("already a positive: develop the original scan"))
    return files.withColumn("rejected", refused)
