"""Exact grouped order statistics over groups of any size.

A frame, a roll or one hot group can hold a large share of all rows, so no group's values ever meet
in one task. Instead of sorting or collecting, each pass counts rows in a bounded number of buckets
per group (combined map-side before the shuffle), finds the bucket every wanted rank falls in, and the
next pass looks only at rows inside those buckets:

* pass 1 uses logarithmic buckets of the value itself, so it needs no prior knowledge of the range;
* later passes cut each still-wide bucket linearly between its own smallest and largest value;
* once every wanted bucket is small, its distinct values are ranked by a window over that bucket.

Buckets come from arithmetic that never decreases as the value grows, so ranks are exact. NULL values are left
out; a NaN or an infinity has no rank, so a group that holds one has no quantiles, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filmroll.functions.pixel import is_finite
from filmroll.session import attach, materialize, store

BUCKETS_PER_OCTAVE = 64
SMALLEST_EXPONENT = 100
SPLITS = 4096
WINDOW_ROWS_CONF = "spark.filmroll.quantile.windowRows"
WINDOW_ROWS = 200_000
SMALL_GROUP_CONF = "spark.filmroll.quantile.smallGroupRows"
SMALL_GROUP_ROWS = 20_000


def log_bucket(value: Column) -> Column:
    """A non-decreasing bucket number: 64 per octave of magnitude, mirrored for negative values."""
    magnitude = F.greatest(F.abs(value), F.lit(2.0 ** -SMALLEST_EXPONENT))
    step = F.floor(F.log2(magnitude) * BUCKETS_PER_OCTAVE) + (SMALLEST_EXPONENT * BUCKETS_PER_OCTAVE + 1)
    return F.when(value == 0, F.lit(0)).when(value > 0, step).otherwise(-step).cast("bigint")


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def order_statistics(df: DataFrame, groups: list[str], value: str, ranks: Callable[[Column], Column],
                     ties: bool = False) -> DataFrame:
    """Rows `(groups, n, rank, value, below, equal)`: the value at each 0-based rank of each group.

    `ranks` turns the group's row count into an array of wanted ranks. `below`/`equal` (rows smaller
    than / equal to the value) are only filled in when `ties` is asked for."""
    spark = df.sparkSession
    small_bucket = int(spark.conf.get(WINDOW_ROWS_CONF, str(WINDOW_ROWS)))
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_bucket", log_bucket(F.col("_v")))

    # pass 1: the group's size and the bucket of every wanted rank
    by_group = W.partitionBy(*groups)
    running = by_group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = (_histogram(rows, groups)
               .withColumn("n", F.sum("_rows").over(by_group))
               .withColumn("_before", F.sum("_rows").over(running) - F.col("_rows"))
               .withColumn("_wanted", F.array_distinct(ranks(F.col("n")))))
    inside = F.filter("_wanted", lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_rows")))
    targets = counted.withColumn("rank", F.explode(inside)).select(
        *groups, "n", "rank", "_bucket", F.lit(0).cast("bigint").alias("_piece"), "_rows", "_lo", "_hi", "_before")

    found = []
    while True:
        done, hit = _settled(ties)
        targets, facts = store(targets, "ranks", still_open=F.count_if(~done), largest=F.max(F.when(~done, F.col("_rows"))))
        found.append(targets.where(done).select(*groups, "n", "rank", *hit))
        if not facts["still_open"]:
            break
        cut = targets.where(~done).groupBy(*groups, "_bucket", "_piece").agg(
            *[F.first(c).alias(c) for c in ("_before", "n")], F.first("_lo").alias("_from"), F.first("_hi").alias("_to"),
            F.collect_set("rank").alias("_ranks")).drop("_piece")
        # every wanted bucket is a range of values that no other range overlaps; `cut` has no more rows
        # than `targets`, whose measured size bounds it
        rows = attach(rows, cut, [*groups, "_bucket"], size=2 * targets.measured_bytes)
        rows = rows.where(F.col("_v").between(F.col("_from"), F.col("_to")))
        if facts["largest"] <= small_bucket:
            found.append(_rank_values(rows, groups))
            break
        rows, targets = _split(rows, groups)
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _settled(ties: bool):
    """Which targets already give the answer, and the answer's columns."""
    rank, before, size = F.col("rank"), F.col("_before"), F.col("_rows")
    one_value = F.col("_lo") == F.col("_hi")
    if ties:
        return one_value, [F.col("_lo").alias("value"), before.alias("below"), size.alias("equal")]
    last = rank == before + size - 1
    value = F.when(last, F.col("_hi")).otherwise(F.col("_lo")).alias("value")
    unknown = F.lit(None).cast("bigint")
    return one_value | (rank == before) | last, [value, unknown.alias("below"), unknown.alias("equal")]


def _rank_values(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Small ranges: count distinct values, then rank them inside their own range."""
    keys = [*groups, "_bucket", "_from"]
    running = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    values = (rows.groupBy(*keys, "_v")
              .agg(F.count(F.lit(1)).alias("equal"), *[F.first(c).alias(c) for c in ("_before", "_ranks", "n")])
              .withColumn("below", F.col("_before") + F.sum("equal").over(running) - F.col("equal")))
    hit = F.filter("_ranks", lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("equal")))
    return values.withColumn("rank", F.explode(hit)).select(
        *groups, "n", "rank", F.col("_v").alias("value"), "below", "equal")


def _split(rows: DataFrame, groups: list[str]):
    """Large ranges: cut each linearly and find the piece of every wanted rank."""
    share = (F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
    rows = rows.withColumn("_piece", F.floor(share * SPLITS).cast("bigint"))
    keys = [*groups, "_bucket", "_from"]
    pieces = rows.groupBy(*keys, "_piece").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        *[F.first(c).alias(c) for c in ("_before", "_ranks", "n")])
    running = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, W.currentRow)
    pieces = pieces.withColumn("_before", F.col("_before") + F.sum("_rows").over(running) - F.col("_rows"))
    inside = F.filter("_ranks", lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_rows")))
    targets = pieces.withColumn("rank", F.explode(inside)).select(
        *groups, "n", "rank", "_bucket", "_piece", "_rows", "_lo", "_hi", "_before")
    return rows.select(*groups, "_bucket", "_v"), targets


def group_sizes(df: DataFrame, groups: list[str]) -> tuple[int, int]:
    """Rows in the largest group, and in all. Reads the group columns only, and combines before the shuffle."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.agg(F.max("_n"), F.sum("_n")).first()
    return int(found[0] or 0), int(found[1] or 0)


def largest_group(df: DataFrame, groups: list[str]) -> int:
    return group_sizes(df, groups)[0]


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether groups of at most `rows` rows may be handled one group at a time."""
    return rows <= int(df.sparkSession.conf.get(SMALL_GROUP_CONF, str(SMALL_GROUP_ROWS)))


def channel_quantiles(df: DataFrame, groups: list[str], columns: list[str], probs: dict[str, float],
                      at_most: int | None = None) -> DataFrame:
    """Per group: `n` (values of the first column), `n_bad` (rows with a NaN or infinity) and, for every
    column and name in `probs`, `{column}_{name}`: linearly interpolated between the two neighbouring order
    statistics; NULL if `n_bad` isn't 0 or the column has no values. Every group gets a row.

    `at_most` is a known bound on the rows of a group; without one it is counted, with `n` and `n_bad`, in one
    pass. Groups within a small measured bound use the built-in exact percentile, larger ones the counting
    passes above; both give the same rows."""
    df = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    bad = F.count_if(reduce(Column.__or__, [~is_finite(F.col(c)) & F.col(c).isNotNull() for c in columns]))
    counts = [F.count(columns[0]).alias("n"), bad.alias("n_bad")]
    whole = {c: F.when(is_finite(F.col(c)), F.col(c)) for c in columns}
    sound = F.col("n_bad") == 0
    sizes = None
    if at_most is None:
        sizes, facts = store(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), *counts), "sizes", largest=F.max("_rows"))
        at_most = int(facts["largest"] or 0)
    if is_small(df, at_most):
        ask = F.array(*[F.lit(p) for p in probs.values()])
        found = df.groupBy(*groups).agg(*counts, *[F.percentile(whole[c], ask).alias(f"_{c}") for c in columns])
        return found.select(*groups, "n", "n_bad", *[
            F.when(sound, F.get(f"_{c}", F.lit(i))).alias(f"{c}_{k}") for c in columns for i, k in enumerate(probs)])
    if sizes is None:
        sizes = materialize(df.groupBy(*groups).agg(*counts), "sizes")
    df = df.select(*groups, *[whole[c].alias(c) for c in columns])

    def ranks(n: Column) -> Column:
        at = [(n - 1) * F.lit(p) for p in probs.values()]
        return F.array(*[F.floor(h).cast("bigint") for h in at], *[F.ceil(h).cast("bigint") for h in at])

    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    tall = df.select(*groups, F.expr(f"stack({len(columns)}, {pairs}) as (_column, _value)"))
    stats = order_statistics(tall, [*groups, "_column"], "_value", ranks)

    def at(c: str, p: float) -> Column:
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = (F.max(F.when((F.col("_column") == c) & (F.col("rank") == k), F.col("value"))) for k in (F.floor(h), F.ceil(h)))
        share = F.max(F.when(F.col("_column") == c, h - F.floor(h)))
        return lo + (hi - lo) * share

    wide = stats.groupBy(*groups).agg(*[at(c, p).alias(f"{c}_{k}") for c in columns for k, p in probs.items()])
    joined = attach(sizes, wide, groups, "left", label="quantiles")
    return joined.select(*groups, "n", "n_bad", *[F.when(sound, F.col(f"{c}_{k}")).alias(f"{c}_{k}") for c in columns for k in probs])


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
                    at_most: int | None = None) -> DataFrame:
    """`channel_quantiles` of one column; output columns are named as in `probs`."""
    q = channel_quantiles(df.select(*groups, value), groups, [value], probs, at_most)
    return q.select(*groups, "n", *[F.col(f"{value}_{k}").alias(k) for k in probs])
