"""Streams folded into versioned tables: exactly once, resumed where they stopped, at a cost per batch of what the batch touches.

A ledger is a folder: tables of `Versions`, and the stream's checkpoint. A batch stages its rows, and the manifest that makes them
visible also notes the batch, so a batch that is run again after a failure is skipped if it was committed and leaves nothing
behind if it wasn't. A later call with the same folder goes on from the checkpoint, with the files that are new.

Tables are kept by key (a key range or a day), and rows are added to them, not merged into what is there. What is read is merged,
and a key that has more than MOST_WRITES writes is merged on storage too, so neither grows with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmroll.sources.versions import Head, Staged, Versions

#: Writes of a key before they are merged.
MOST_WRITES = 8
BUCKETS = 64

Step = Callable[[DataFrame, Versions, Head], tuple[list[Staged], dict]]
Merge = Callable[[DataFrame], DataFrame]


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


def follow(stream: DataFrame, path: str, step: Step) -> Versions:
    """Everything that is new, batch by batch."""
    held = Versions(stream.sparkSession, path)

    def batch(new: DataFrame, batch_id: int) -> None:
        head = held.head()
        if head.facts.get("batch", -1) >= batch_id:
            return  # committed before a failure
        staged, facts = step(new, held, head)
        held.commit(staged, head, batch=batch_id, **facts)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return held


def compacted(held: Versions, head: Head, name: str, schema: T.StructType, merge: Merge, key: Callable[[DataFrame], DataFrame]) -> list[Staged]:
    """Keys with many writes, merged to one. What the batch itself stages is added after it."""
    many = {k for (n, k), ws in head.writes.items() if n == name and len(ws) >= MOST_WRITES}
    if not many:
        return []
    return [held.stage(key(merge(held.read(name, schema, head, many))), name, "_key", also=tuple(many))]


@dataclass(frozen=True)
class Fold:
    """Mergeable rows: `partial` makes them of a batch's rows, `merge` of several such tables together one; `key` says, from
    their columns, where they are kept."""
    partial: Merge
    merge: Merge
    key: Column

    def keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_key", self.key)


def fold(stream: DataFrame, path: str, name: str, how: Fold) -> DataFrame:
    """What is folded of a stream's rows, up to the newest."""
    schema = how.partial(stream.sparkSession.createDataFrame([], stream.schema)).schema

    def step(new: DataFrame, held: Versions, head: Head) -> tuple[list[Staged], dict]:
        return [*compacted(held, head, name, schema, how.merge, how.keyed), held.stage(how.keyed(how.partial(new)), name, "_key", replaces=False)], {}

    return how.merge(follow(stream, path, step).read(name, schema))


def refresh_touched(rows: DataFrame, keys: list[str], compute: Merge, path: str) -> DataFrame:
    """A table of results kept up to date with a stream of `rows`: the keys a batch touches are computed again from all
    their rows, for statistics that don't merge, like medians. Rows lie by ranges of hashed keys and sorted in them, so
    those of other keys are hardly read. The result has the latest rows of every key."""
    spark = rows.sparkSession
    result = T.StructType([*compute(spark.createDataFrame([], rows.schema)).schema.fields, T.StructField("_version", T.LongType())])

    def latest(found: DataFrame) -> DataFrame:
        last = found.groupBy(*keys).agg(F.max("_version").alias("_version"))
        return found.join(last, [*keys, "_version"]).select(*result.names)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_key", bucket(keys))

    def step(new: DataFrame, held: Versions, head: Head) -> tuple[list[Staged], dict]:
        merged = compacted(held, head, "rows", rows.schema, lambda df: df.repartition(bucket(keys)).sortWithinPartitions(*keys), keyed)
        own = held.stage(keyed(new).repartition("_key").sortWithinPartitions("_key", *keys), "rows", "_key", replaces=False)
        fresh = spark.read.schema(rows.schema).parquet(f"{held.path}/rows/write={own.write}").select(*rows.columns)
        before = held.read("rows", rows.schema, head, set(own.keys))
        again = before.join(fresh.select(*keys).distinct(), keys, "left_semi").unionByName(fresh)
        results = compute(again).withColumn("_version", F.lit(head.version + 1).cast("bigint"))
        return [*merged, own, *compacted(held, head, "results", result, latest, keyed),
                held.stage(keyed(results), "results", "_key", replaces=False)], {}

    held = follow(rows, path, step)
    return latest(held.read("results", result)).drop("_version")


class Routed:
    """Lines parted into typed events and a side table of what can't be used, and what was folded of them on the way."""

    def __init__(self, held: Versions, schema: T.StructType, folds: dict[str, tuple[Fold, T.StructType]]):
        self._held, self._schema, self._folds = held, schema, folds

    def events(self) -> DataFrame:
        return self._held.read("lines", self._schema, keys={"events"})

    def side(self) -> DataFrame:
        """run_id, ts, line, why: "no time", "malformed" or "late"."""
        return self._held.read("lines", self._schema, keys={"side"}).select("run_id", "ts", "line", "why")

    def folded(self, name: str) -> DataFrame:
        how, schema = self._folds[name]
        return how.merge(self._held.read(name, schema))

    def newest(self) -> Column:
        """The newest event time so far."""
        return F.timestamp_micros(F.lit(self._held.head().facts.get("newest")).cast("bigint"))


def route(lines: DataFrame, path: str, delay: str, parse: Callable[..., DataFrame], folds: dict[str, Fold] | None = None) -> Routed:
    """Lines (run_id, ts, line) into events and a side table, committed together with all that is folded of them, so that the
    two always hold every line once. Late is what is older, by more than `delay`, than the newest event time of the
    batches before it: what a query with that watermark would drop. Folds see all lines, with `why` NULL for events."""
    spark, wait = lines.sparkSession, F.expr(f"INTERVAL {delay}")
    schema = parse(lines, "line").withColumn("why", F.lit(None).cast("string")).schema
    empty = spark.createDataFrame([], schema)
    known = {name: (how, how.partial(empty).schema) for name, how in (folds or {}).items()}

    def step(new: DataFrame, held: Versions, head: Head) -> tuple[list[Staged], dict]:
        newest, seen = head.facts.get("newest"), Observation()
        late = F.lit(False) if newest is None else F.col("ts") < F.timestamp_micros(F.lit(newest)) - wait
        why = F.when(F.col("ts").isNull(), "no time").when(F.col("problem").isNotNull(), "malformed").when(late, "late")
        rows = parse(new, "line").withColumn("why", why).withColumn("_part", F.when(F.col("why").isNull(), "events").otherwise("side"))
        own = held.stage(rows.observe(seen, F.max(F.unix_micros("ts")).alias("newest")), "lines", "_part", replaces=False)
        staged, told = [own], spark.read.schema(schema).parquet(f"{held.path}/lines/write={own.write}").select(*schema.names)
        for name, (how, kept) in known.items():
            staged += [*compacted(held, head, name, kept, how.merge, how.keyed), held.stage(how.keyed(how.partial(told)), name, "_key", replaces=False)]
        return staged, {"newest": max((n for n in (newest, seen.get["newest"]) if n is not None), default=None)}

    return Routed(follow(lines, path, step), schema, known)
