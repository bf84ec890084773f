"""Listing, naming, resuming, logging and summing up."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import FILE_SQL, RESULT_SQL, existing_outputs, files, results, table, with_sql
from filmroll.functions.text import general_number, natural_key, one_line, output_name, stem
from filmroll.operators import rolls, scans, summary
from filmroll.sources.provenance import read_provenance, reject_positives
from filmroll.sources.runlog import finish_rows, log_rows, previous_unfinished

FS = with_sql(FILE_SQL)
R = with_sql(RESULT_SQL)


def _scans(spark, sf):
    return rolls.scans(rolls.classify(files(spark, sf)))


def _numbered(spark, sf):
    return rolls.frame_numbers(_scans(spark, sf))


def _jobs(spark, sf, template="{stem}_pos"):
    return rolls.plan_jobs(_numbered(spark, sf), F.concat("folder", F.lit("/inversion")), template,
                           F.regexp_extract("folder", "([^/]*)$", 1), F.col("p_type"))


JOB_SQL = FILE_SQL.rstrip() + """,
jobs AS (SELECT *, concat(folder, '/inversion/', regexp_replace(name, '\\.[^.]+$', ''), '_pos', regexp_extract(name, '\\.[^.]+$')) AS output_path FROM numbered)
"""
J = with_sql(JOB_SQL)


@query("fn_file_kind", FS + "SELECT file_id, path, kind FROM files")
def fn_file_kind(spark, sf):
    return rolls.classify(files(spark, sf)).select("file_id", "path", "kind")


@query("agg_skipped", FS + """, c AS (
  SELECT folder, count_if(kind = 'macos') AS macos, count_if(kind = 'contact sheet') AS contact_sheets, count_if(kind = 'folder') AS folders, count_if(kind = 'positive') AS positives,
    count_if(kind = 'JPEG') AS jpeg, count_if(kind = 'PNG') AS png, count_if(kind = 'non-TIFF file') AS non_tiff_file, count_if(kind = 'raw file') AS raw_file,
    count_if(kind = 'hidden') + count_if(kind = 'macos') AS hidden FROM files GROUP BY folder)
SELECT *, concat_ws(', ', CASE WHEN hidden = 0 THEN NULL WHEN hidden = macos THEN CASE WHEN hidden = 1 THEN '1 hidden macOS file' ELSE concat(hidden, ' hidden macOS files') END
    WHEN hidden = 1 THEN '1 hidden file' ELSE concat(hidden, ' hidden files') END, """ + ", ".join(
    f"CASE WHEN {c} = 1 THEN '1 {one}' WHEN {c} > 1 THEN concat({c}, ' {one}s') END" for c, one in (
        ("contact_sheets", "contact sheet"), ("jpeg", "JPEG"), ("png", "PNG"), ("non_tiff_file", "non-TIFF file"), ("raw_file", "raw file"), ("folders", "folder"), ("positives", "positive"))) + ") AS description FROM c")
def agg_skipped(spark, sf):
    return rolls.skipped_counts(rolls.classify(files(spark, sf)))


@query("win_frame_number", FS + "SELECT folder, file_id, name, CAST(n AS BIGINT) AS n FROM numbered")
def win_frame_number(spark, sf):
    return _numbered(spark, sf).select("folder", "file_id", "name", F.col("n").cast("bigint").alias("n"))


@query("sort_natural", FS + "SELECT name FROM files ORDER BY file_id")
def sort_natural(spark, sf):
    """All names in natural order (the comparison with SQL ignores order; the tests check it)."""
    return rolls.natural_order(files(spark, sf)).select("name")


@query("fn_natural_key", FS + """SELECT file_id, coalesce(TRY_CAST(regexp_extract(name, '[0-9]+') AS BIGINT), -1) AS first_number FROM files""")
def fn_natural_key(spark, sf):
    """The first number of every name as the natural key sees it."""
    parts = natural_key(F.col("name"))["parts"]
    number = F.get(F.filter(parts, lambda p: p["kind"] == 0), F.lit(0))["text"]
    return files(spark, sf).select("file_id", F.coalesce(number.cast("bigint"), F.lit(-1)).alias("first_number"))


@query("win_roll_names", FS + """, folders AS (SELECT DISTINCT folder FROM files), h AS (SELECT folder, substring(folder, 8) AS below, split_part(folder, '/', 3) AS head FROM folders)
SELECT folder, CASE WHEN count(*) OVER (PARTITION BY head) = 1 THEN head ELSE replace(below, '/', ' - ') END AS roll_name FROM h""")
def win_roll_names(spark, sf):
    return rolls.roll_names(files(spark, sf).select("folder").distinct(), "/scans")


@query("fn_output_name", FS + """SELECT file_id, concat(split_part(folder, '/', -1), '_', lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0'), '_', replace(p_type, '/', '-'), ' ', regexp_replace(name, '\\.[^.]+$', ''), regexp_extract(name, '\\.[^.]+$')) AS output FROM numbered""")
def fn_output_name(spark, sf):
    jobs = _jobs(spark, sf, "{roll}_{n:02}_{stock} {stem}")
    return jobs.select("file_id", F.regexp_replace("output_path", "^.*/inversion/", "").alias("output"))


@query("fn_output_name_refused", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 3 = 2 THEN NULL ELSE 'Brand-1/'.replace('/', '-') || p_partkey END AS name,
  CASE WHEN p_size % 3 = 0 THEN 'renders an empty name' WHEN p_size % 3 = 2 THEN 'gives a hidden file' END AS problem FROM part""")
def fn_output_name_refused(spark, sf):
    """Stems that leave a template empty, hidden or with characters a file name can't hold."""
    size = F.col("p_size") % 3
    raw = F.when(size == 0, " ").when(size == 2, F.concat(F.lit(".x"), F.col("p_partkey").cast("string"))).otherwise(
        F.concat(F.lit("Brand-1/"), F.col("p_partkey").cast("string")))
    name, problem = output_name("{stem}", raw, F.lit(""), F.lit(1), F.lit(None).cast("string"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), problem.alias("problem"))


@query("join_skip_existing", J + "SELECT file_id, output_path FROM jobs WHERE output_path NOT IN (SELECT path FROM existing)")
def join_skip_existing(spark, sf):
    return rolls.skip_existing(_jobs(spark, sf), existing_outputs(spark, sf)).select("file_id", "output_path")


@query("log_kept", J + "SELECT file_id, output_path FROM jobs WHERE output_path IN (SELECT path FROM existing)")
def log_kept(spark, sf):
    return rolls.kept_frames(_jobs(spark, sf), existing_outputs(spark, sf)).select("file_id", "output_path")


@query("join_existing_report", J + "SELECT folder, count(*) AS jobs, count_if(output_path IN (SELECT path FROM existing)) AS existing FROM jobs GROUP BY folder")
def join_existing_report(spark, sf):
    return rolls.existing_report(_jobs(spark, sf), existing_outputs(spark, sf))


@query("join_output_is_input", FS + "SELECT file_id, path AS output_path FROM scans WHERE p_type = 'SMALL'")
def join_output_is_input(spark, sf):
    """Small parts are set to be written back to their own folder, unchanged in name."""
    jobs = _scans(spark, sf).withColumn("output_path", F.when(F.col("p_type") == "SMALL", F.col("path")).otherwise(
        F.concat("folder", F.lit("/inversion/"), "name")))
    return rolls.output_is_input(jobs).select("file_id", "output_path")


@query("join_output_clash", FS + """, j AS (SELECT path, lower(concat(folder, '/inversion/', left(regexp_replace(name, '\\.[^.]+$', ''), 6), '.png')) AS output_key FROM scans)
SELECT output_key, count(*) AS inputs, min(path) AS first_input, max(path) AS last_input FROM j GROUP BY output_key HAVING count(*) > 1""")
def join_output_clash(spark, sf):
    """Names cut to six characters: some frames would share an output."""
    short = F.substring(stem(F.col("name")), 1, 6)
    return rolls.output_clashes(_scans(spark, sf).withColumn("output_path", F.concat("folder", F.lit("/inversion/"), short, F.lit(".png"))))


@query("set_rolls_union", J + "SELECT file_id, folder, output_path FROM jobs")
def set_rolls_union(spark, sf):
    """Rolls planned one kind of folder at a time, as one job table."""
    nested = F.col("folder").rlike("/day ")
    jobs = _jobs(spark, sf).select("file_id", "folder", "output_path")
    return rolls.all_jobs(jobs.where(nested), jobs.where(~nested))


FOLDER_SQL = FS + """, fo AS (SELECT CASE WHEN p_size % 13 = 5 THEN concat(folder, '/.trash') WHEN p_size % 13 = 6 THEN concat(folder, '/.thumbs/small') ELSE folder END AS folder, kind, p_size FROM files),
h AS (SELECT folder, count_if(kind = 'scan' AND p_size % 10 < 4) AS scans, count_if(kind = 'positive') AS positives, max(p_size) > 49 AS dest FROM fo WHERE NOT contains(folder, '/.') GROUP BY folder)
"""


def _listed(spark, sf):
    """Folders with their counts, some hidden; where fewer files are scans; and those written to."""
    size, kind = F.col("p_size"), F.col("kind")
    inside = F.when(size % 13 == 5, F.concat("folder", F.lit("/.trash"))).when(size % 13 == 6, F.concat("folder", F.lit("/.thumbs/small"))).otherwise(F.col("folder"))
    classified = rolls.classify(files(spark, sf)).withColumn("folder", inside)
    folders = classified.groupBy("folder").agg(F.count_if((kind == "scan") & (size % 10 < 4)).alias("scans"), F.count_if(kind == "positive").alias("positives"))
    return folders, classified.where(size > 49).select("folder").distinct()


@query("set_exclude_destinations", FOLDER_SQL + "SELECT folder, scans, positives FROM h WHERE scans > 0 AND NOT dest")
def set_exclude_destinations(spark, sf):
    return rolls.exclude_destinations(*_listed(spark, sf))


@query("agg_skipped_folders", FOLDER_SQL + "SELECT count_if(scans = 0 AND positives > 0) AS earlier_outputs, count_if(scans > 0 AND dest) AS destinations FROM h")
def agg_skipped_folders(spark, sf):
    return rolls.skipped_folders(*_listed(spark, sf))


@query("join_roll_clash", FS + """, r AS (SELECT folder, concat('/out/', upper(left(split_part(folder, '/', -1), 5))) AS output_dir, count_if(kind = 'scan') AS jobs FROM files GROUP BY folder)
SELECT lower(output_dir) AS output_key, count(*) AS rolls, arg_min(folder, folder) AS first_roll, arg_max(folder, folder) AS last_roll FROM r WHERE jobs > 0 GROUP BY lower(output_dir) HAVING count(*) > 1""")
def join_roll_clash(spark, sf):
    """Rolls whose output folders are named by a few letters."""
    counted = rolls.classify(files(spark, sf)).groupBy("folder").agg(F.count_if(F.col("kind") == "scan").alias("jobs"))
    last = F.substring_index("folder", "/", -1)
    return rolls.roll_clashes(counted.withColumns({"roll_name": F.col("folder"), "output_dir": F.concat(F.lit("/out/"), F.upper(F.substring(last, 1, 5)))}))


@query("agg_check_inputs", FS + """, n AS (SELECT folder, name, path, count(*) OVER (PARTITION BY name) AS k FROM (SELECT DISTINCT folder, CASE WHEN kind = 'folder' THEN 'dir' ELSE name END AS name, concat(folder, '/', CASE WHEN kind = 'folder' THEN 'dir' ELSE name END) AS path FROM files))
SELECT path, CASE WHEN k > 1 THEN concat(split_part(folder, '/', -1), '/', name) ELSE name END AS label FROM n""")
def agg_check_inputs(spark, sf):
    """Every file named twice over, and folders that share one name."""
    one = files(spark, sf).select(F.when(F.col("is_dir"), F.concat("folder", F.lit("/dir"))).otherwise(F.col("path")).alias("path"))
    return scans.unique_inputs(one.unionByName(one)).select("path", "label")


# --- provenance -------------------------------------------------------------------------------

@query("src_provenance", FS + "SELECT file_id, output, CASE WHEN output = 'flat' THEN 0.5e0 END AS linear_scale, CASE WHEN output IS NOT NULL THEN p_type END AS film_stock FROM files")
def src_provenance(spark, sf):
    record = read_provenance(files(spark, sf))
    return record.select("file_id", "record.output", "record.linear_scale", "record.film_stock")


@query("px_reject_positive", FS + """SELECT file_id, CASE WHEN output IS NOT NULL THEN 'already a positive: develop the original scan' END AS developing,
  CASE WHEN output = 'print' THEN 'already a print: printing expects a flat positive' END AS printing FROM files""")
def px_reject_positive(spark, sf):
    develop = reject_positives(files(spark, sf)).withColumnRenamed("rejected", "developing")
    return reject_positives(develop, printing=True).select("file_id", "developing", F.col("rejected").alias("printing"))


@query("agg_common_stock", FS + """SELECT roll_id, count(*) AS frames, CASE WHEN count(DISTINCT stock) = 1 AND count_if(stock IS NULL) = 0 THEN min(stock) END AS film_stock,
  CASE WHEN count(DISTINCT output) = 1 AND count_if(output IS NULL) = 0 THEN min(output) END AS output
FROM (SELECT p_partkey % 12 + p_size * 100 AS roll_id, CASE WHEN p_partkey % 12 = 4 THEN p_type END AS stock, CASE WHEN p_partkey % 12 = 4 AND p_size % 2 = 0 THEN 'flat' WHEN p_partkey % 12 = 4 THEN 'print' END AS output FROM part) GROUP BY roll_id""")
def agg_common_stock(spark, sf):
    """Sets of files that share, or don't share, a film stock and a kind of output."""
    record = read_provenance(files(spark, sf))
    rows = record.select((F.col("file_id") % 12 + F.col("p_size") * 100).alias("roll_id"), "record.film_stock", "record.output")
    return summary.common_decision(rows)


# --- results ----------------------------------------------------------------------------------

@query("agg_summary", R + """
SELECT r.roll_id, count(*) AS frames, count_if(error IS NULL) AS developed, count(*) FILTER (WHERE error IS NULL AND grade IS NOT NULL AND grade_fitted) AS fitted,
  round(min(grade) FILTER (WHERE error IS NULL AND grade_fitted), 6) AS grade_min, round(max(grade) FILTER (WHERE error IS NULL AND grade_fitted), 6) AS grade_max,
  count(*) FILTER (WHERE error IS NULL AND grade_fitted AND grade >= 1 - 1e-6) AS at_cap,
  round(min(exposure) FILTER (WHERE error IS NULL AND grade_fitted), 6) AS exposure_min, round(max(exposure) FILTER (WHERE error IS NULL AND grade_fitted), 6) AS exposure_max,
  round(min(linear_scale) FILTER (WHERE error IS NULL), 6) AS scale_min, round(max(linear_scale) FILTER (WHERE error IS NULL), 6) AS scale_max,
  round(quantile_cont(grade, 0.5) FILTER (WHERE error IS NULL AND grade_fitted), 6) AS grade_median
FROM results r GROUP BY r.roll_id""")
def agg_summary(spark, sf):
    return rounded(summary.roll_summary(results(spark, sf)))


@query("agg_low_grade", R + """, m AS (SELECT roll_id, count(*) AS n, quantile_cont(grade, 0.5) AS grade_median FROM fitted GROUP BY roll_id)
SELECT f.roll_id, frame_id, name, round(grade, 6) AS grade, round(grade_median, 6) AS grade_median FROM fitted f JOIN m ON f.roll_id = m.roll_id WHERE n >= 5 AND round(grade_median - grade, 6) >= 0.25""")
def agg_low_grade(spark, sf):
    return rounded(summary.low_grades(results(spark, sf)))


@query("agg_warning_groups", R + """, parts AS (SELECT roll_id, frame_id, name, unnest(warnings) AS message, unnest(range(len(warnings))) AS part FROM results WHERE warnings IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY roll_id, message ORDER BY frame_id, part) AS k, count(*) OVER (PARTITION BY roll_id, message) AS n FROM parts)
SELECT roll_id, message, max(n) AS frames, concat(string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 4), CASE WHEN max(n) > 4 THEN concat(' and ', max(n) - 4, ' more') ELSE '' END) AS names,
  min(frame_id) AS first_frame, CAST(arg_min(part, frame_id) AS INTEGER) AS first_part FROM k GROUP BY roll_id, message""")
def agg_warning_groups(spark, sf):
    return summary.warning_groups(results(spark, sf))


def _kept(spark, sf):
    """Frames an earlier run had left in place: orders before 1996."""
    return results(spark, sf).where(F.year("o_orderdate") < 1996).select("roll_id")


@query("agg_overall", R + """, s AS (SELECT roll_id, CASE WHEN error IS NULL THEN 'developed' ELSE 'failed' END AS state FROM results UNION ALL SELECT roll_id, 'kept' FROM results WHERE year(o_orderdate) < 1996)
SELECT roll_id, CAST(GROUPING(roll_id) AS INTEGER) AS whole_run, count_if(state = 'developed') AS developed, count_if(state = 'failed') AS failed, count_if(state = 'kept') AS kept FROM s GROUP BY ROLLUP (roll_id)""")
def agg_overall(spark, sf):
    return summary.run_totals(results(spark, sf), _kept(spark, sf))


@query("log_append", R + """SELECT roll_id, frame_id, name, CASE WHEN error IS NULL THEN 'developed' ELSE 'failed' END AS result,
  CASE WHEN error IS NOT NULL THEN NULL WHEN linear_scale IS NOT NULL THEN concat('flat x', regexp_replace(regexp_replace(printf('%.3f', round(linear_scale, 3)), '0+$', ''), '\\.$', ''))
    ELSE concat(printf('%.2f', round(grade, 2)), CASE WHEN grade_fitted THEN '' ELSE ' (pinned)' END) END AS grade,
  CASE WHEN error IS NULL AND linear_scale IS NULL THEN printf('%+.2f', round(exposure, 2)) END AS exposure,
  CASE WHEN error IS NULL THEN printf('%.2f', roll_id % 3 / 10e0 + 1e0) END AS gain,
  CASE WHEN round(seconds, 1) < 60 THEN concat(printf('%.1f', round(seconds, 1)), 's') ELSE concat(CAST(floor(round_even(seconds, 0) / 60) AS INTEGER), 'm', lpad(CAST(CAST(round_even(seconds, 0) AS INTEGER) % 60 AS VARCHAR), 2, '0'), 's') END AS time,
  concat_ws('; ', error, CASE WHEN warnings IS NULL THEN NULL WHEN len(warnings) = 2 THEN concat(name, ': ', warnings[1], '; ', warnings[2]) ELSE warnings[1] END) AS notes FROM results""")
def log_append(spark, sf):
    """The log line of every frame, appended to the log table and read back."""
    from filmroll.session import shared_path
    from filmroll.sources.runlog import append_log

    path = shared_path(spark, "log")
    append_log(log_rows(results(spark, sf), "develop"), path)
    return spark.read.parquet(path)


def _runs(spark, sf):
    """Runs: an order is a run, logged by its customer; urgent ones never finished."""
    rows = table(spark, sf, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return rows.select(
        F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("run_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"),
        F.when(~urgent, F.date_format(F.date_add(F.to_date("o_orderdate"), 1), "yyyy-MM-dd")).alias("finished_at"),
        (F.col("o_orderstatus") == "P").alias("interrupted"), F.when(F.col("o_orderpriority") == "5-LOW", "disk full").alias("error"))


RUN_SQL = """
WITH runs AS (SELECT o_custkey AS log, o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS started_at, CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS finished_at,
  o_orderstatus = 'P' AS interrupted, CASE WHEN o_orderpriority = '5-LOW' THEN 'disk full' END AS error FROM orders)
"""


@query("win_previous_unfinished", RUN_SQL + """SELECT log, run_id, started_at, lag(CASE WHEN finished_at IS NULL THEN started_at END) OVER (PARTITION BY log ORDER BY started_at, run_id) AS unfinished_start FROM runs""")
def win_previous_unfinished(spark, sf):
    return previous_unfinished(_runs(spark, sf)).select("log", "run_id", "started_at", "unfinished_start")


@query("log_finish", RUN_SQL + """SELECT log, run_id, finished_at, CASE WHEN finished_at IS NULL THEN NULL WHEN interrupted THEN 'Stopped: interrupted' WHEN error IS NOT NULL THEN concat('Stopped by an error: ', error) ELSE 'finished' END AS ending FROM runs""")
def log_finish(spark, sf):
    return finish_rows(_runs(spark, sf)).select("log", "run_id", "finished_at", "ending")


@query("fn_one_line", "SELECT p_partkey, concat(p_name, ' / ', p_brand, ' / ', p_type) AS line FROM part")
def fn_one_line(spark, sf):
    text = F.concat(F.lit("\n "), "p_name", F.lit(" \n\n"), "p_brand", F.lit("\r\n\t "), "p_type", F.lit("\n"))
    return table(spark, sf, "part").select("p_partkey", one_line(text).alias("line"))


@query("fn_general_number", "SELECT l_orderkey, l_linenumber, l_extendedprice, printf('%g', l_extendedprice) AS price, printf('%g', l_discount / 1000) AS discount, printf('%g', l_extendedprice * 1000) AS thousand FROM lineitem")
def fn_general_number(spark, sf):
    """Prices with six significant digits."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", general_number(F.col("l_extendedprice")).alias("price"),
        general_number(F.col("l_discount") / 1000).alias("discount"), general_number(F.col("l_extendedprice") * 1000).alias("thousand"))
