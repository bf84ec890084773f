import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from filmroll.operators import auto
from filmroll.sources.versions import Versions
from filmroll.streaming import ledger
from filmroll.streaming import progress as st


def feed(spark, tmp_path, batches, schema):
    """One file per batch, read one at a time."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")
    import glob, os, time
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(batches)):
        for f in glob.glob(f"{folder}/b{i}/*.parquet"):
            target = flat / f"{i}.parquet"
            shutil.copy(f, target)
            os.utime(target, (time.time() - 100 + i, time.time() - 100 + i))
    return st.read_lines(spark, str(flat), "*.parquet", spark.read.parquet(str(flat)).schema, files_per_batch=1)


def test_lines_and_their_problems(spark):
    good = ["start\t0\ta.tif", "done\t0\tok\tgrade 0.9", "done\t1\tfailed\tbroken", "summary\twarn\tCheck\tx", "end\t3\t4\t0"]
    bad = ["start\tx\ta", "done\t0\tmaybe\t", "done\t0", "summary\tnote\ta\tb", "end\t1\t2", "hello", ""]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(good + bad)], "run_id int, ts int, line string")
    rows = {r.ts: r for r in st.parse_progress(df).collect()}
    assert [rows[i].kind for i in range(5)] == ["start", "done", "done", "summary", "end"]
    assert rows[2].status == "failed" and rows[4].total == 4 and rows[4].cancelled is False
    assert all(rows[i].problem and rows[i].kind is None for i in range(5, 12))


def vote(roll, frame, s):
    return (roll, frame, 1.0, 1.0, 1.0, s, 1.0, 1.0)


VOTES = "roll_id int, frame_id int, wb_r double, wb_g double, wb_b double, s_r double, s_g double, s_b double"


def estimates(df):
    return {r.roll_id: (r.votes, r.s_r) for r in df.collect()}


def test_rolls_refine_over_batches(spark, tmp_path):
    stream = feed(spark, tmp_path, [[vote(1, 1, 1.0), vote(2, 1, 5.0)], [vote(1, 2, 2.0), vote(1, 3, 9.0)], [vote(1, 4, 9.5)]], VOTES)
    assert estimates(ledger.refresh_touched(stream, ["roll_id"], auto.roll_estimate, str(tmp_path / "votes"))) == {1: (4, 5.5), 2: (1, 5.0)}


def test_a_second_call_goes_on(spark, tmp_path, monkeypatch):
    """Two calls give what one does, the second reads new files only, and merged writes change nothing."""
    monkeypatch.setattr(ledger, "MOST_WRITES", 2)
    path, batches = str(tmp_path / "votes"), [[vote(r, n, float(n * r)) for r in (1, 2, n + 3)] for n in range(5)]
    seen = []

    def compute(rows):
        seen.append(rows.count())
        return auto.roll_estimate(rows)

    stream = feed(spark, tmp_path, batches[:3], VOTES)
    first = estimates(ledger.refresh_touched(stream, ["roll_id"], compute, path))
    before = len(seen)
    spark.createDataFrame([vote(1, 9, 50.0)], VOTES).coalesce(1).write.parquet(str(tmp_path / "more"))
    (file,) = (tmp_path / "more").glob("*.parquet")
    shutil.copy(file, tmp_path / "flat" / "9.parquet")
    second = estimates(ledger.refresh_touched(stream, ["roll_id"], compute, path))
    assert seen[before:] == [0, 4]  # the schema's probe, then the touched roll's rows alone
    assert first == {1: (3, 1.0), 2: (3, 2.0), 3: (1, 0.0), 4: (1, 4.0), 5: (1, 10.0)}
    assert second == {**first, 1: (4, 1.5)}
    held = Versions(spark, path)
    assert max(len(w) for w in held.head().writes.values()) <= 3


def test_a_batch_that_was_committed_is_not_applied_again(spark, tmp_path):
    held, rows = Versions(spark, str(tmp_path / "v")), spark.createDataFrame([(1, "a")], "n int, key_ string")
    held.commit([held.stage(rows, "t", "key_", replaces=False)], held.head(), batch=0)
    stream = feed(spark, tmp_path, [[(2, "b")]], "n int, key_ string")
    of = ledger.Fold(lambda df: df, lambda df: df, F.col("key_"))
    assert [r.n for r in ledger.fold(stream, str(tmp_path / "v"), "t", of).collect()] == [1]


LINES = "run_id bigint, s bigint, line string"


def test_every_line_is_an_event_or_aside(spark, tmp_path):
    minute = 60
    batches = [[(1, 0, "start\t1\ta"), (1, minute, "done\t1\tok\tgrade"), (1, 2 * minute, "what")], [(1, 500 * minute, "done\t1\tfailed\tx"), (2, 500 * minute, "end\t1\t1\t0")],
               [(1, 3 * minute, "done\t2\tok\tlate"), (1, 499 * minute, "done\t1\tok\tagain"), (1, None, "start\t2\tb"), (1, 4 * minute, "nonsense")]]
    stream = feed(spark, tmp_path, batches, LINES).select("run_id", F.timestamp_seconds("s").alias("ts"), "line")
    of = ledger.route(stream, str(tmp_path / "lines"), "2 hours", st.parse_progress, {"counts": st.counts_fold("1 hour"), "reports": st.reports_fold()})
    assert sorted((r.line, r.why) for r in of.side().collect()) == [("done\t2\tok\tlate", "late"), ("nonsense", "malformed"), ("start\t2\tb", "no time"), ("what", "malformed")]
    assert of.events().count() + of.side().count() == 9
    counts = of.folded("counts").collect()
    assert sum(sum(r[k] for k in ("developed", "failed", "other", "late", "malformed", "no_time")) for r in counts) == 9
    once = [(r.run_id, r.idx, r["first"].status, r["first"].detail, r.reports) for r in of.folded("reports").collect()]
    assert once == [(1, 1, "ok", "grade", 3)]  # the first by event time holds, whenever it came


@pytest.fixture
def clock():
    return lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minutes))


def rows_at(spark, rows):
    return [(run, 1_700_000_000 + 60 * m, *rest) for run, m, *rest in rows]


def test_completion_over_batches(spark, tmp_path):
    """State lives across batches: one run completes in the second and stays so whatever repeats; one goes quiet and times out."""
    batches = [rows_at(spark, [(1, 0, 1, "ok", 3), (1, 1, 2, "failed", 3), (1, 2, 2, "ok", 3), (2, 0, 1, "ok", 5)]), rows_at(spark, [(1, 30, 3, "ok", 3)]),
               rows_at(spark, [(3, 50, 1, "ok", 1), (1, 51, 3, "ok", 3)]), rows_at(spark, [(4, 600, 1, "ok", 9), (1, 600, 1, "failed", 3)]),
               rows_at(spark, [(4, 1200, 1, "ok", 9), (1, 1199, 1, "ok", 3)]), rows_at(spark, [(4, 3000, 1, "ok", 9)]), rows_at(spark, [(5, 9000, 1, "ok", 9)])]
    stream = feed(spark, tmp_path, batches, "run_id bigint, s bigint, idx bigint, status string, expected bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = st.run_once(st.roll_completion(stream, 3_600_000, "10 minutes"), "c").collect()
    got = {r.run_id: (r.outcome, r.developed, r.failed) for r in found}
    assert got == {1: ("complete", 2, 1), 2: ("didn't finish", 1, 0), 3: ("complete", 1, 0), 4: ("didn't finish", 1, 0)}
    assert len(found) == 4


def test_a_told_run_is_forgotten_in_the_end(spark, tmp_path):
    batches = [rows_at(spark, [(1, 0, 1, "ok", 1)]), rows_at(spark, [(2, 5000, 1, "ok", 1)]), rows_at(spark, [(2, 5001, 1, "ok", 1)]), rows_at(spark, [(1, 5002, 1, "ok", 1)])]
    stream = feed(spark, tmp_path, batches, "run_id bigint, s bigint, idx bigint, status string, expected bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = st.run_once(st.roll_completion(stream, 60_000, "1 minute", keep_ms=3_600_000), "c").collect()
    assert sorted(r.run_id for r in found) == [1, 1, 2]


def test_sessions_end_with_an_end_or_in_silence(spark, tmp_path):
    def at(*rows):
        return [(run, 1_700_000_000 + s, kind) for run, s, kind in rows]
    batches = [at((1, 0, "start"), (1, 5, "done"), (1, 9, "end"), (1, 12, "start")), at((1, 30, None), (2, 3, "start"), (2, 3, "end"), (2, 3, "done")), at((1, 7200, "start")), at((9, 30_000, "start"))]
    stream = feed(spark, tmp_path, batches, "run_id bigint, s bigint, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.run_id, int(r.session_start.timestamp()) - 1_700_000_000, int(r.session_end.timestamp()) - 1_700_000_000, r.events, r.ends, r.malformed)
                 for r in st.run_once(st.run_sessions(stream, 3600, "1 minute"), "s").collect())
    assert got == [(1, 0, 9, 3, 1, 0), (1, 12, 3630, 2, 0, 1), (1, 7200, 10800, 1, 0, 0), (2, 3, 3, 3, 1, 0)]


def test_late_repeats_and_windows(spark, tmp_path):
    batches = [rows_at(spark, [(1, 0, "done", 1, "ok"), (1, 1, "done", 1, "ok"), (1, 2, "done", 2, "failed")]), rows_at(spark, [(1, 3, "done", 2, "failed"), (1, 300, "done", 3, "ok")]),
               rows_at(spark, [(1, 301, "done", 3, "ok")]),  # rows are late against the batch before
               rows_at(spark, [(1, 5, "done", 9, "ok"), (1, 900, "done", 4, "ok")])]
    schema = "run_id bigint, s bigint, kind string, idx bigint, status string"
    stream = feed(spark, tmp_path, batches, schema).withColumn("ts", F.timestamp_seconds("s"))
    once = st.run_once(st.frames_once(stream, "1 hour"), "o").collect()
    assert sorted(r.idx for r in once) == [1, 2, 3, 4]
    counts = {r.window_start: (r.developed, r.failed) for r in st.run_once(st.run_counts(stream, "10 minutes", "1 hour"), "w").collect()}
    assert sum(d for d, _ in counts.values()) == 4 and sum(f for _, f in counts.values()) == 2


def test_starts_without_an_end(spark, tmp_path):
    batches = [rows_at(spark, [(1, 0, "start", 1, None), (1, 1, "start", 2, None)]), rows_at(spark, [(1, 5, "done", 1, "ok")]),
               rows_at(spark, [(1, 500, "start", 3, None), (1, 501, "done", 3, "failed")]), rows_at(spark, [(1, 900, "start", 4, None), (1, 900, "done", 4, "ok")]),
               rows_at(spark, [(1, 2000, "start", 5, None)])]
    schema = "run_id bigint, s bigint, kind string, idx bigint, status string"
    stream = feed(spark, tmp_path, batches, schema).withColumn("ts", F.timestamp_seconds("s"))
    got = {r.idx: r.status for r in st.run_once(st.start_to_done(stream, "1 HOUR", "10 minutes"), "p").collect()}
    assert got == {1: "ok", 2: None, 3: "failed", 4: "ok"}


def test_each_start_takes_the_first_end_before_the_next(spark, tmp_path):
    """Out of order within the delay; ends too many, too late, or without a start."""
    rows = [(0, "start"), (3, "done"), (4, "done"), (10, "start"), (12, "start"), (14, "done"), (20, "start"), (100, "done"), (101, "done")]
    batches = [rows_at(spark, [(1, m, kind, 1, "ok" if kind == "done" else None) for m, kind in part]) for part in (rows[1::2], rows[0::2])]
    batches.append(rows_at(spark, [(2, 5000, "start", 1, None)]))
    stream = feed(spark, tmp_path, batches, "run_id bigint, s bigint, kind string, idx bigint, status string").withColumn("ts", F.timestamp_seconds("s"))
    found = st.run_once(st.start_to_done(stream, "1 HOUR", "3 hours"), "p").collect()
    minute = lambda t: None if t is None else round((t.timestamp() - 1_700_000_000) / 60)
    assert sorted((minute(r.started), minute(r.ended)) for r in found if r.ended) == [(0, 3), (12, 14)]
    assert sorted(minute(r.started) for r in found if not r.ended) == [10, 20]


class Store:
    """A bucket's state and timers, and how often they are called."""

    def __init__(self):
        self.lists, self.timers, self.calls = {}, set(), 0

    def getListState(self, name, schema):
        return Kept(self, name)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.until


class Kept:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _set(self, rows):
        self.store.calls += 1
        self.store.lists[self.name] = rows

    def get(self):
        self.store.calls += 1
        return iter(self.store.lists.get(self.name, []))

    def appendValue(self, row):
        self._set(self.store.lists.get(self.name, []) + [row])

    def put(self, rows):
        self._set(rows)

    def clear(self):
        self._set([])


def test_keys_of_a_bucket_share_calls_to_the_store():
    """Their number depends on batches, not on keys or rows; what is open, due or ahead of each key is kept apart."""
    minute, keys = 60_000_000, 500
    first = [(str(k), at * minute, done, "ok" if done else None) for k in range(keys) for at, done in ((1, 0), (2, 1), (3, 0), (90, 0))]
    second = [(str(k), 4 * minute, 1, None) for k in range(0, keys, 2)]
    of, store = st._Pairs(60 * minute), Store()
    of.init(store)
    found = []
    for rows, until in ((first, 3 * 60_000 + 1), (second, 80 * 60_000), ([], 200 * 60_000)):
        if rows:
            list(of.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["key", "us", "done", "status"])]), store))
        assert len(store.timers) == 1
        store.until = until
        (at,) = store.timers
        assert at < until
        for out in of.handleExpiredTimer((7,), store, None):
            found += [tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False)]
        store.timers.discard(at)
    want = [(str(k), 1 * minute, 2 * minute, "ok") for k in range(keys)]
    want += [(str(k), 3 * minute, None if k % 2 else 4 * minute, None) for k in range(keys)] + [(str(k), 90 * minute, None, None) for k in range(keys)]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert store.calls < 30 and not store.timers and not any(store.lists.values())
