"""Streaming operators, run over the event and order tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import table
from filmroll.operators import auto, scans
from filmroll.session import shared_path
from filmroll.streaming import progress as st
from filmroll.streaming.ledger import Fold, bucket, fold, refresh_touched, route

DELAY = "2 hours"


def _line_columns():
    """Events as progress lines; one in twenty is cut short."""
    k = F.get_json_object("props", "$.k")
    idx = (k.cast("int") % 10).cast("string")
    kind, tab = F.col("event_type"), F.lit("\t")
    line = (F.when(k.cast("int") % 20 == 7, F.concat(F.lit("done\t"), k))
            .when(kind == "view", F.concat(F.lit("start\t"), idx, tab, F.lit("f"), k, F.lit(".tif")))
            .when(kind == "click", F.concat(F.lit("done\t"), idx, F.lit("\tok\tgrade "), k))
            .when(kind == "error", F.concat(F.lit("done\t"), idx, F.lit("\tfailed\tdamaged")))
            .when(kind == "purchase", F.concat(F.lit("summary\twarn\tCheck\t"), k))
            .otherwise(F.concat(F.lit("end\t"), k, F.lit("\t100\t"), (k.cast("int") % 2).cast("string"))))
    return F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), line.alias("line")


def lines(spark, sf):
    return st.read_lines(spark, sf, "events.parquet", table(spark, sf, "events").schema).select(*_line_columns())


def events(spark, sf):
    return st.parse_progress(lines(spark, sf))


def routed(spark, sf, **folds):
    return route(lines(spark, sf), shared_path(spark, "lines"), DELAY, st.parse_progress, folds)


EVENT_SQL = """
WITH e AS (SELECT user_id AS run_id, ts, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (SELECT run_id, ts, CASE WHEN k % 20 <> 7 THEN CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'done' WHEN 'error' THEN 'done' WHEN 'purchase' THEN 'summary' ELSE 'end' END END AS kind,
  CASE WHEN k % 20 <> 7 THEN CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'failed' END END AS status, k % 10 AS idx, k FROM e),
bad AS (SELECT run_id, ts, concat('done	', k) AS line FROM e WHERE k % 20 = 7)
"""


def wm(kind: str = "true") -> str:
    return f"(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM ev WHERE {kind})"


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("st_progress_parse", EVENT_SQL.rstrip() + """
SELECT run_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN k % 20 <> 7 THEN CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'done' WHEN 'error' THEN 'done' WHEN 'purchase' THEN 'summary' ELSE 'end' END END AS kind,
  CASE WHEN k % 20 <> 7 AND event_type IN ('view', 'click', 'error') THEN CAST(k % 10 AS BIGINT) END AS idx, CASE WHEN k % 20 <> 7 AND event_type = 'view' THEN concat('f', k, '.tif') END AS name,
  CASE WHEN k % 20 <> 7 THEN CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'failed' END END AS status,
  CASE WHEN k % 20 <> 7 THEN CASE event_type WHEN 'click' THEN concat('grade ', k) WHEN 'error' THEN 'damaged' END END AS detail,
  CASE WHEN k % 20 <> 7 AND event_type = 'signup' THEN CAST(k AS BIGINT) END AS developed, CASE WHEN k % 20 <> 7 AND event_type = 'signup' THEN k % 2 = 1 END AS cancelled,
  CASE WHEN k % 20 = 7 THEN concat('not a progress line: done\t', k) END AS problem FROM e""")
def st_progress_parse(spark, sf):
    typed = st.run_once(st.parse_progress(lines(spark, sf)), "parsed")
    return typed.select("run_id", _time("ts"), "kind", "idx", "name", "status", "detail", "developed", "cancelled", "problem")


@query("st_run_counts", EVENT_SQL + f"""SELECT run_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (WHERE status = 'ok') AS developed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE kind <> 'done') AS other, count(*) FILTER (WHERE kind IS NULL) AS malformed, CAST(0 AS BIGINT) AS late, date_trunc('hour', ts) + INTERVAL 1 HOUR <= {wm()} AS closed
FROM ev GROUP BY run_id, date_trunc('hour', ts)""")
def st_run_counts(spark, sf):
    """Every line is in one of the counts."""
    of = routed(spark, sf, counts=st.counts_fold("1 hour"))
    closed = F.col("window_end") <= of.newest() - F.expr(f"INTERVAL {DELAY}")
    return of.folded("counts").select("run_id", _time("window_start"), "developed", "failed", "other", "malformed", "late", closed.alias("closed"))


@query("st_run_sessions", EVENT_SQL + f""", sec AS (SELECT run_id, date_trunc('second', ts) AS s, count(*) AS n, count(*) FILTER (WHERE kind = 'end') AS ends, count(*) FILTER (WHERE kind IS NULL) AS bad FROM ev GROUP BY ALL),
g AS (SELECT *, CASE WHEN lag(ends) OVER w = 0 AND s - lag(s) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS cut FROM sec WINDOW w AS (PARTITION BY run_id ORDER BY s)),
p AS (SELECT *, sum(cut) OVER (PARTITION BY run_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM g),
t AS (SELECT run_id, k, min(s) AS a, max(s) AS z, sum(n) AS events, sum(ends) AS ends, sum(bad) AS malformed FROM p GROUP BY run_id, k)
SELECT run_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(CASE WHEN ends > 0 THEN z ELSE z + INTERVAL 6 HOUR END, '%Y-%m-%d %H:%M:%S') AS session_end, CAST(events AS BIGINT) AS events, CAST(ends AS BIGINT) AS ends, CAST(malformed AS BIGINT) AS malformed
FROM t WHERE CASE WHEN ends > 0 THEN z ELSE z + INTERVAL 6 HOUR END < (SELECT date_trunc('second', max(ts)) - INTERVAL 2 HOUR FROM ev)""")
def st_run_sessions(spark, sf):
    """Over all lines; one that can't be read still tells that its run goes on."""
    sessions = st.run_once(st.run_sessions(events(spark, sf), 6 * 3600, DELAY), "sessions")
    return sessions.select("run_id", _time("session_start"), _time("session_end"), "events", "ends", "malformed")


def _aside(side, **columns):
    """Side rows in the columns of a result."""
    return side.select(*[v.alias(k) for k, v in columns.items()])


@query("st_frame_dedupe", EVENT_SQL + """SELECT run_id, CAST(idx AS BIGINT) AS idx, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS ts, f.status AS status, f.detail AS detail, reports
FROM (SELECT run_id, idx, min({'ts': ts, 'status': status, 'detail': CASE status WHEN 'ok' THEN concat('grade ', k) ELSE 'damaged' END}) AS f, count(*) AS reports FROM ev WHERE kind = 'done' GROUP BY run_id, idx)
UNION ALL SELECT run_id, NULL, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'malformed', line, 1 FROM bad""")
def st_frame_dedupe(spark, sf):
    """The first report of each frame, and the lines that are no reports."""
    of = routed(spark, sf, reports=st.reports_fold())
    once = of.folded("reports").select("run_id", "idx", F.date_format("first.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "first.status", "first.detail", "reports")
    return once.union(_aside(of.side(), run_id=F.col("run_id"), idx=F.lit(None).cast("bigint"), ts=_time("ts"), status=F.col("why"), detail=F.col("line"), reports=F.lit(1).cast("bigint")))


@query("st_start_done", EVENT_SQL + f""", f AS (SELECT * FROM ev WHERE kind IN ('start', 'done')),
n AS (SELECT *, lead(kind) OVER w AS k2, lead(ts) OVER w AS t2, lead(status) OVER w AS s2 FROM f WINDOW w AS (PARTITION BY run_id, idx ORDER BY ts, kind DESC, status)),
m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR AS w FROM f),
p AS (SELECT *, k2 = 'done' AND t2 <= ts + INTERVAL 24 HOUR AS paired FROM n, m WHERE kind = 'start' AND (t2 < w OR ts + INTERVAL 24 HOUR < w))
SELECT run_id, CAST(idx AS BIGINT) AS idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started, CASE WHEN paired THEN CAST(floor((epoch_us(t2) - epoch_us(ts)) / 1e6) AS BIGINT) END AS seconds, CASE WHEN paired THEN s2 END AS status FROM p
UNION ALL SELECT run_id, NULL, strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL, 'malformed' FROM bad""")
def st_start_done(spark, sf):
    """A row for each start that is settled, and the lines that can't be read."""
    pairs = st.run_once(st.start_to_done(events(spark, sf), "24 HOURS", DELAY), "pairs")
    seconds = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1e6).cast("bigint")
    side = routed(spark, sf).side()
    return pairs.select("run_id", "idx", _time("started"), seconds.alias("seconds"), "status").union(
        _aside(side, run_id=F.col("run_id"), idx=F.lit(None).cast("bigint"), started=_time("ts"), seconds=F.lit(None).cast("bigint"), status=F.col("why")))


@query("st_roll_complete", EVENT_SQL + f""", r AS (SELECT run_id, idx, min({{'ts': ts, 'ok': status = 'ok'}}) AS f, max(ts) AS last FROM ev WHERE kind = 'done' GROUP BY run_id, idx),
d AS (SELECT run_id, count_if(f.ok) AS developed, count_if(NOT f.ok) AS failed, max(last) AS last FROM r GROUP BY run_id),
s AS (SELECT run_id, count(DISTINCT idx) + run_id % 2 AS expected FROM ev WHERE kind = 'start' GROUP BY run_id)
SELECT d.run_id, expected, developed, failed, CASE WHEN developed + failed >= expected THEN 'complete' ELSE 'didn''t finish' END AS outcome FROM d JOIN s ON d.run_id = s.run_id
WHERE developed + failed >= expected OR last + INTERVAL 4 HOUR < {wm("kind = 'done' AND run_id IN (SELECT run_id FROM s)")}
UNION ALL SELECT run_id, NULL, NULL, NULL, concat(count(*), ' malformed') FROM bad GROUP BY run_id""")
def st_roll_complete(spark, sf):
    """A run expects the frames it starts, every other run one that it never does. With the lines of each that can't be read."""
    typed = st.parse_progress(table(spark, sf, "events").select(*_line_columns())).where(F.col("kind") == "start")
    planned = typed.groupBy("run_id").agg((F.count_distinct("idx") + F.col("run_id") % 2).alias("expected"))
    done = events(spark, sf).where(F.col("kind") == "done").join(planned, "run_id")
    told = st.run_once(st.roll_completion(done, 4 * 3600 * 1000, DELAY), "complete")
    side = routed(spark, sf).side().groupBy("run_id", "why").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("bigint")
    return told.union(_aside(side, run_id=F.col("run_id"), expected=none, developed=none, failed=none, outcome=F.concat_ws(" ", F.col("n").cast("string"), "why")))


def _votes(spark, sf):
    rows = st.read_lines(spark, sf, "orders.parquet", table(spark, sf, "orders").schema)
    u = F.col("o_totalprice") / 500000.0
    return rows.select(F.col("o_custkey").alias("roll_id"), F.col("o_orderkey").alias("frame_id"), (u / 10 + 0.7).alias("wb_r"), F.lit(1.0).alias("wb_g"),
                       (u / 5 + 1.0).alias("wb_b"), (u / 3 + 1.0).alias("s_r"), F.lit(1.0).alias("s_g"), (u / 4 + 0.6).alias("s_b"))


@query("st_roll_estimate", """
WITH v AS (SELECT o_custkey AS roll_id, o_totalprice / 500000e0 AS u FROM orders)
SELECT roll_id, count(*) AS votes, round(pow(10e0, quantile_cont(log10(u / 10 + 0.7e0), 0.5)), 6) AS wb_r, round(pow(10e0, quantile_cont(log10(u / 5 + 1e0), 0.5)), 6) AS wb_b,
  round(quantile_cont(u / 3 + 1e0, 0.5), 6) AS s_r, round(quantile_cont(u / 4 + 0.6e0, 0.5), 6) AS s_b FROM v GROUP BY roll_id""")
def st_roll_estimate(spark, sf):
    """Every order is a frame's vote for its customer's roll."""
    rolls = refresh_touched(_votes(spark, sf), ["roll_id"], auto.roll_estimate, shared_path(spark, "votes"))
    return rounded(rolls.select("roll_id", "votes", "wb_r", "wb_b", "s_r", "s_b"))


@query("st_ingest", """
WITH m AS (SELECT o_custkey AS roll_id, 1e0 / list_extract([30, 30, 60], CAST(o_orderkey % 3 + 1 AS INTEGER)) * 100e0 / 64e0 AS rel, o_orderstatus = 'P' AS missing FROM orders)
SELECT roll_id, count(*) AS frames, count(DISTINCT CASE WHEN NOT missing THEN rel END) AS exposure_groups, round(coalesce(abs(log2(max(rel) FILTER (WHERE NOT missing) / min(rel) FILTER (WHERE NOT missing))), 0e0), 6) AS spread_stops,
  count_if(missing) AS missing_exif, coalesce(abs(log2(max(rel) FILTER (WHERE NOT missing) / min(rel) FILTER (WHERE NOT missing))), 0e0) > 0.05 AS exposure_inconsistent FROM m GROUP BY roll_id""")
def st_ingest(spark, sf):
    """New scans' settings as they arrive, each roll checked again with what it has so far."""
    rows = st.read_lines(spark, sf, "orders.parquet", table(spark, sf, "orders").schema)
    shutter = F.get(F.array(F.lit(30), F.lit(30), F.lit(60)), (F.col("o_orderkey") % 3).cast("int"))
    known = F.col("o_orderstatus") != "P"
    meta = rows.select(
        F.col("o_custkey").alias("roll_id"), F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(known, F.lit(1.0) / shutter).alias("t"), F.when(known, 8.0).alias("f"), F.when(known, 100.0).alias("iso"),
        F.lit(None).cast("string").alias("wb_kind"), F.lit(None).cast("array<double>").alias("wb"), F.lit(None).cast("array<string>").alias("tonal_modules"))
    of = Fold(scans.scan_tallies, scans.merged_tallies, bucket(["roll_id"]))
    report = scans.report_of(fold(meta, shared_path(spark, "meta"), "tallies", of))
    return rounded(report.select("roll_id", "frames", "exposure_groups", "spread_stops", "missing_exif", "exposure_inconsistent"))
