"""Numbering rows within groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filmroll.session import attach, materialize


def number_within(df: DataFrame, groups: list[str], order: list[str], name: str = "n") -> DataFrame:
    """1-based position of each row in its group by `order` (a total order). Rows are range-partitioned
    by group and order, so a large group spans many tasks; a slice adds the sizes of the slices before it."""
    cut = df.repartitionByRange(*groups, *order).withColumn("_slice", F.spark_partition_id())
    stored = materialize(cut, "slices")
    before = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_size")).select(
        *groups, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*groups, "_slice").orderBy(*order)
    placed = stored.withColumn("_at", F.row_number().over(inside))
    return attach(placed, offsets, [*groups, "_slice"], label="offsets").withColumn(
        name, F.col("_at") + F.col("_offset")).drop("_slice", "_at", "_offset")


def top_per_group(df: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    """The first `k` rows of each group; Spark cuts every partition to k per group before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("_rank") <= k)


def listed_names(df: DataFrame, groups: list[str], name: str, order: list[str], limit: int,
                 more: str) -> DataFrame:
    """Per group: how many rows, and the first `limit` names followed by `more` ("%d" = the rest)."""
    first = top_per_group(df.select(*groups, name, *order), groups, order, limit)
    shown = first.groupBy(*groups).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", F.col(name).alias("_name")))), lambda s: s["_name"]), ", ").alias("_shown"))
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    rest = F.col("count") - limit
    return counts.join(shown, groups).select(*groups, "count", F.when(rest > 0, F.concat(
        F.col("_shown"), F.format_string(more, rest))).otherwise(F.col("_shown")).alias("names"))
