"""Runs as streams: progress lines, counts, sessions, pairing and completion.

Every function takes and returns streaming (or static) DataFrames; only `run_once` starts anything. Event time is `ts`.
What goes by the order of events (sessions, pairs) is settled when the watermark has passed it, so it doesn't depend on the order of
arrival. Folds, for `ledger.route`, count what doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filmroll.session import shared_path
from filmroll.streaming.ledger import Fold, bucket

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Fixed line formats, tab-separated
LINE = (r"^(start\t\d+\t[^\t]*|done\t\d+\t(ok|failed)\t[^\t]*|summary\t(row|warn)\t[^\t]*\t[^\t]*"
        r"|end\t\d+\t\d+\t[01])$")


def read_lines(spark: SparkSession, folder: str, file_glob: str, schema, files_per_batch: int = 64) -> DataFrame:
    """New files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def parse_progress(lines: DataFrame, *keep: str) -> DataFrame:
    """(run_id, ts, line) -> typed events, with the columns `keep`; a line that doesn't fit its format keeps only a `problem`."""
    rows = lines.withColumns({"_p": F.split("line", "\t", -1), "_good": F.col("line").rlike(LINE)})
    good, kind = F.col("_good"), F.get("_p", F.lit(0))

    def at(i: int):
        return F.get("_p", F.lit(i))

    def when(kinds: tuple[str, ...], value, cast: str = "string"):
        return F.when(good & kind.isin(*kinds), value).try_cast(cast)

    return rows.select(
        "run_id", "ts", F.when(good, kind).alias("kind"), when(("start", "done"), at(1), "bigint").alias("idx"),
        when(("start",), at(2)).alias("name"), when(("done",), at(2)).alias("status"), when(("done",), at(3)).alias("detail"),
        when(("summary",), at(1)).alias("level"), when(("summary",), at(2)).alias("label"), when(("summary",), at(3)).alias("text"),
        when(("end",), at(1), "bigint").alias("developed"), when(("end",), at(2), "bigint").alias("total"),
        when(("end",), at(3) == "1", "boolean").alias("cancelled"),
        F.when(~good, F.concat(F.lit("not a progress line: "), F.col("line"))).alias("problem"), *keep)


def run_counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Frames developed and failed per run and tumbling window, once the window is closed."""
    done = events.where(F.col("kind") == "done").withWatermark("ts", delay)
    out = done.groupBy(F.window("ts", width).alias("_w"), "run_id").agg(
        F.count_if(F.col("status") == "ok").alias("developed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.select("run_id", F.col("_w.start").alias("window_start"), "developed", "failed")


def counts_fold(width: str) -> Fold:
    """All lines of a run and tumbling window, by what became of them."""
    classes = {"developed": F.col("why").isNull() & (F.col("kind") == "done") & (F.col("status") == "ok"),
               "failed": F.col("why").isNull() & (F.col("kind") == "done") & (F.col("status") == "failed"),
               "other": F.col("why").isNull() & (F.col("kind") != "done"), "late": F.col("why") == "late", "malformed": F.col("why") == "malformed",
               "no_time": F.col("why") == "no time"}
    by = ["run_id", "window_start", "window_end"]

    def partial(rows: DataFrame) -> DataFrame:
        windows = F.window("ts", width)
        timed = rows.where(F.col("ts").isNotNull()).select("*", windows.alias("_w")).select("*", F.col("_w.start").alias(by[1]), F.col("_w.end").alias(by[2])).drop("_w")
        none = F.lit(None).cast("timestamp")
        untimed = rows.where(F.col("ts").isNull()).select("*", none.alias(by[1]), none.alias(by[2]))
        return timed.union(untimed).groupBy(*by).agg(*[F.count_if(is_).alias(n) for n, is_ in classes.items()])

    return Fold(partial, lambda df: df.groupBy(*by).agg(*[F.sum(n).alias(n) for n in classes]), F.date_format("window_start", "yyyy-MM-dd"))


def reports_fold() -> Fold:
    """A frame's report that holds, of however many: the first by event time (then by status and detail), and how many."""
    first = ["ts", "status", "detail"]

    def partial(rows: DataFrame) -> DataFrame:
        done = rows.where(F.col("why").isNull() & (F.col("kind") == "done"))
        return done.groupBy("run_id", "idx").agg(F.min(F.struct(*first)).alias("first"), F.count(F.lit(1)).alias("reports"))

    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy("run_id", "idx").agg(F.min("first").alias("first"), F.sum("reports").alias("reports"))

    return Fold(partial, merge, bucket(["run_id", "idx"]))


def _stateful(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """State with timers needs the store that keeps several values for a key."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return events.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


#: Keys share so many buckets of state. A call to the store costs much more than a row, so there are some per bucket and batch, and
#: none per key or row. A stream's buckets can't be changed later.
BUCKETS = 1024


def _keyed(*keys: str) -> list:
    """A bucket of keys, and the key in it as text, which keeps NULL and any type."""
    return [F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket"), F.to_json(F.struct(*keys)).alias("key")]


def _unkeyed(df: DataFrame, key_schema: str, *columns) -> DataFrame:
    return df.select(F.from_json("key", key_schema).alias("_k"), *columns).select("_k.*", *[c for c in df.columns if c != "key"])


def _ms(us: int) -> int:
    return -(-us // 1000)


class _Ordered(StatefulProcessor):
    """Rows of each key in event-time order: they wait in their bucket until the watermark has passed them. A bucket has one timer, for
    the first time at which something in it is due. Waiting rows are appended, and read again only when some are due, as whole batches."""

    ROW: pa.Schema  # of a waiting row: first its key, then its time in microseconds
    OPEN: pa.Schema  # of what is open of a key: first the key
    FROM: int  # the column of OPEN from which its deadline counts
    WAIT: int  # microseconds from there to the deadline
    COLUMNS: dict[str, str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getListState("open", "rows binary")

    def _wake(self, at: int) -> None:
        set_ = list(self.handle.listTimers())
        if set_ and min(set_) <= at:
            return
        for old in set_:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    @staticmethod
    def _get(state, schema: pa.Schema) -> list[tuple]:
        out = []
        for (raw,) in state.get():
            out += zip(*(c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(bytes(raw)), schema).columns))
        return out

    @staticmethod
    def _packed(rows: list[tuple], schema: pa.Schema) -> tuple:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        return (pa.RecordBatch.from_arrays(columns, schema=schema).serialize().to_pybytes(),)

    @classmethod
    def _put(cls, state, rows: list[tuple], schema: pa.Schema) -> None:
        if rows:
            state.put([cls._packed(rows, schema)])
        else:
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for chunk in rows:
            batch = pa.RecordBatch.from_pandas(chunk[self.ROW.names], self.ROW, preserve_index=False)
            self.waiting.appendValue((batch.serialize().to_pybytes(),))
            first.append(int(chunk["us"].min()))
        if first:
            self._wake(_ms(min(first)))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()  # timers set here fire with a later batch, so all that is due is settled
        due: dict[str, list[tuple]] = {}
        rest: list[tuple] = []
        for r in self._get(self.waiting, self.ROW):
            if _ms(r[1]) < until:
                due.setdefault(r[0], []).append(r)
            else:
                rest.append(r)
        if due:
            self._put(self.waiting, rest, self.ROW)
        before = {r[0]: r for r in self._get(self.open, self.OPEN)}
        after, found = [], []
        for k in {**before, **due}:
            now, out = self.settle(k, before.get(k), sorted(due.get(k, ()), key=self.order), until)
            found += out
            if now:
                after.append(now)
        if before or after:
            self._put(self.open, after, self.OPEN)
        ahead = [_ms(r[1]) for r in rest] + [_ms(r[self.FROM] + self.WAIT) for r in after]
        if ahead:
            self.handle.registerTimer(min(ahead))
        if found:
            yield pd.DataFrame({n: pd.array(c, dtype=t) for (n, t), c in zip(self.COLUMNS.items(), zip(*found))})

    def close(self) -> None:
        pass


def _schema(**columns: pa.DataType) -> pa.Schema:
    return pa.schema(list(columns.items()))


class _Sessions(_Ordered):
    ROW = _schema(key=pa.string(), us=pa.int64(), events=pa.int64(), ends=pa.int64(), malformed=pa.int64())
    OPEN, FROM = _schema(key=pa.string(), first=pa.int64(), last=pa.int64(), events=pa.int64(), malformed=pa.int64()), 2
    COLUMNS = {"key": "object", "session_start": "int64", "session_end": "int64", "events": "int64", "ends": "int64", "malformed": "int64"}

    def __init__(self, gap_us: int):
        self.WAIT = gap_us

    def order(self, row):
        return row[1]

    def settle(self, key, now, due, until):
        out = []

        def row(end, ends):
            return (key, now[1], end, now[3], ends, now[4])

        seconds: dict[int, list[int]] = {}
        for _, us, n, ends, bad in due:  # one second may have come in several batches
            have = seconds.setdefault(us, [0, 0, 0])
            have[0], have[1], have[2] = have[0] + n, have[1] + ends, have[2] + bad
        for us, (n, ends, bad) in seconds.items():
            if now and us - now[2] >= self.WAIT:
                out.append(row(now[2] + self.WAIT, 0))
                now = None
            now = (key, now[1], us, now[3] + n, now[4] + bad) if now else (key, us, us, n, bad)
            if ends:
                out.append(row(us, ends))
                now = None
        if now and _ms(now[2] + self.WAIT) < until:
            out.append(row(now[2] + self.WAIT, 0))
            now = None
        return now, out


def run_sessions(events: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """Runs told apart by their ends, and by silence where no end was recorded. Times are whole seconds, and all that a run
    reports in one second is counted before the shuffle, so a busy run is as many rows as it lasts seconds."""
    second = F.date_trunc("second", "ts")
    counted = events.where(F.col("ts").isNotNull()).select(
        *_keyed("run_id"), second.alias("ts"), F.unix_micros(second).alias("us"), F.lit(1).cast("bigint").alias("events"),
        F.coalesce(F.col("kind") == "end", F.lit(False)).cast("bigint").alias("ends"), F.col("kind").isNull().cast("bigint").alias("malformed"))
    counted = counted.mapInPandas(_per_second, counted.schema).withWatermark("ts", delay)
    found = _stateful(counted, ["bucket"], _Sessions(gap_seconds * 1_000_000),
                      "key string, session_start bigint, session_end bigint, events bigint, ends bigint, malformed bigint")
    return _unkeyed(found, "run_id bigint", *[F.timestamp_micros(c).alias(c) for c in ("session_start", "session_end")], "events", "ends", "malformed")


def _per_second(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for c in chunks:
        yield c.groupby(["bucket", "key", "ts", "us"], as_index=False, sort=False).sum()


def frames_once(events: DataFrame, delay: str) -> DataFrame:
    """A frame reported twice counts once, whatever it was reported as: the first report seen stands."""
    return events.where(F.col("kind") == "done").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "idx"])


class _Pairs(_Ordered):
    ROW = _schema(key=pa.string(), us=pa.int64(), done=pa.int32(), status=pa.string())
    OPEN, FROM = _schema(key=pa.string(), us=pa.int64()), 1
    COLUMNS = {"key": "object", "started": "int64", "ended": "Int64", "status": "object"}

    def __init__(self, within_us: int):
        self.WAIT = within_us

    def order(self, row):
        return row[1], row[2], row[3] or ""

    def settle(self, key, now, due, until):
        out = []
        start = now[1] if now else None
        for _, us, done, status in due:
            if not done:
                if start is not None:
                    out.append((key, start, None, None))
                start = us
            elif start is not None and us - start <= self.WAIT:
                out.append((key, start, us, status))
                start = None
        if start is not None and _ms(start + self.WAIT) < until:
            out.append((key, start, None, None))
            start = None
        return None if start is None else (key, start), out


def start_to_done(events: DataFrame, within: str, delay: str) -> DataFrame:
    """One row for each start: with the first end of the same frame before the frame's next start, `within` the start, or without
    one, once none can come any more. A start and an end at the same time belong together."""
    one = events.sparkSession.sql(f"SELECT CAST(unix_micros(TIMESTAMP_MICROS(0) + INTERVAL {within}) AS BIGINT)").first()[0]
    rows = events.where(F.col("kind").isin("start", "done") & F.col("ts").isNotNull()).select(
        *_keyed("run_id", "idx"), "ts", F.unix_micros("ts").alias("us"), (F.col("kind") == "done").cast("int").alias("done"), "status").withWatermark("ts", delay)
    found = _stateful(rows, ["bucket"], _Pairs(one), "key string, started bigint, ended bigint, status string")
    return _unkeyed(found, "run_id bigint, idx bigint", *[F.timestamp_micros(c).alias(c) for c in ("started", "ended")], "status")


ROLL_DONE = "run_id bigint, expected bigint, developed bigint, failed bigint, outcome string"


class _Completion(StatefulProcessor):
    """A run's frames with their first reports, and whether the run was told of; that outlives the frames."""

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait, self.keep = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getMapState("frames", "idx bigint", "us bigint, ok boolean")
        self.run = handle.getValueState("run", "expected bigint, last bigint, closed boolean")

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _told(self, key: tuple, expected: int, last: int, outcome: str) -> pd.DataFrame:
        reports = [v[1] for v in self.frames.values()]
        self.frames.clear()
        self.run.update((expected, last, True))
        self._wake(last + self.keep)
        return pd.DataFrame([(key[0], expected, sum(reports), len(reports) - sum(reports), outcome)], columns=["run_id", "expected", "developed", "failed", "outcome"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        expected, last, closed = self.run.get() if self.run.exists() else (0, 0, False)
        for chunk in rows:
            for idx, us, ok, most, newest in zip(chunk["idx"], chunk["us"], chunk["ok"], chunk["expected"], chunk["newest"]):
                last, expected = max(last, int(newest)), max(expected, int(most))
                if closed:
                    continue
                have = self.frames.getValue((int(idx),)) if self.frames.containsKey((int(idx),)) else None
                if have is None or (int(us), bool(ok)) < (have[0], have[1]):
                    self.frames.updateValue((int(idx),), (int(us), bool(ok)))
        if closed:  # repeats after the end change nothing, and keep the marker
            self.run.update((expected, last, True))
            self._wake(last + self.keep)
        elif sum(1 for _ in self.frames.keys()) >= expected:
            yield self._told(key, expected, last, "complete")
        else:
            self.run.update((expected, last, False))
            self._wake(last + self.wait)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, last, closed = self.run.get()
        if closed:
            self.run.clear()
        else:
            yield self._told(key, expected, last, "didn't finish")

    def close(self) -> None:
        pass


def _first_reports(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for c in chunks:
        us = pd.Series([int(t.value // 1000) for t in c["ts"]], index=c.index, dtype="int64")
        c = c.assign(us=us, ok=c["status"] == "ok", newest=(us + 999) // 1000).sort_values(["us", "ok"])
        yield c.groupby(["run_id", "idx", "expected"], as_index=False).agg(
            ts=("ts", "max"), us=("us", "first"), ok=("ok", "first"), newest=("newest", "max"))[["run_id", "idx", "expected", "ts", "us", "ok", "newest"]]


def roll_completion(done: DataFrame, wait_ms: int, delay: str, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """(run_id, idx, ts, status, expected) -> one row per run: when every expected frame has a report, or when none came
    for `wait_ms` of event time. A frame counts once, as its first report says; reports are cut to one per frame before the shuffle.
    A run that was told of is remembered for `keep_ms` of event time after its last report, so repeats don't tell of it again."""
    reports = done.select("run_id", "idx", "ts", "status", "expected").mapInPandas(
        _first_reports, "run_id bigint, idx bigint, expected bigint, ts timestamp, us bigint, ok boolean, newest bigint").withWatermark("ts", delay)
    return _stateful(reports, ["run_id"], _Completion(wait_ms, keep_ms), ROLL_DONE)


def run_once(stream: DataFrame, label: str) -> DataFrame:
    """Everything available now, appended to a table under the shared folder; the table."""
    spark = stream.sparkSession
    path = shared_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", shared_path(spark, f"{label}-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
