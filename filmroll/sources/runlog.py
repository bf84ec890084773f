"""The run log as an append-only table: one row per frame as it finishes, one per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.functions.text import fixed, general_number, one_line
from filmroll.operators.ordering import number_within

RESULT_WORD = {"develop": "developed", "print": "printed", "export": "exported"}


def _rounded(value: Column, unit: Column | float) -> Column:
    """Rounded to a multiple of 1 / unit as SQL's round does: the product, a tie away from zero. Rounding the shortest decimal of the
    value itself differs where the product isn't the tie that it looks like."""
    return F.round(value * unit) / unit


def _places(value: Column, digits: int) -> Column:
    return fixed(_rounded(value, 10.0 ** digits), digits)


def human_time(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.rint(s).cast("bigint")
    minutes = F.floor(whole / 60)
    return (F.when(seconds.isNull(), F.lit(None).cast("string")).when(_rounded(s, 10.0) < 60, F.concat(_places(s, 1), F.lit("s")))
            .when(minutes < 60, F.format_string("%dm%02ds", minutes, whole % 60))
            .otherwise(F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60)))


def log_rows(results: DataFrame, kind: str) -> DataFrame:
    """A frame's line: result word, grade (or flat scale), exposure, gain, time and notes on one line."""
    failed = F.col("error").isNotNull()
    grade = (F.when(F.col("linear_scale").isNotNull(), F.concat(F.lit("flat x"), _three_digits(F.col("linear_scale"))))
             .when(F.col("grade").isNotNull(), F.concat(
                 _places(F.col("grade"), 2),
                 F.when(F.coalesce("grade_fitted", F.lit(False)), "").otherwise(" (pinned)"))))
    exposure = F.when(F.col("linear_scale").isNull() & F.col("grade").isNotNull(), F.concat(
        F.when(F.col("exposure") < 0, "-").otherwise("+"), _places(F.abs("exposure"), 2)))
    notes = F.concat_ws("; ", one_line(F.col("error")), one_line(F.col("warning")))
    return results.select(
        "roll_id", "frame_id", "name", F.when(failed, "failed").otherwise(RESULT_WORD[kind]).alias("result"),
        F.when(~failed, grade).alias("grade"), F.when(~failed, exposure).alias("exposure"),
        F.when(~failed, _places(F.coalesce("gain", F.lit(1.0)), 2)).alias("gain"),
        human_time(F.col("seconds")).alias("time"), notes.alias("notes"))


def _three_digits(value: Column) -> Column:
    unit = F.pow(F.lit(10.0), 2 - F.floor(F.log10(F.abs(value))))
    return general_number(_rounded(value, unit))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def finish_rows(runs: DataFrame) -> DataFrame:
    """How each run ended: (log, run_id, started_at, finished_at, interrupted, error)."""
    ended = F.col("finished_at").isNotNull()
    return runs.withColumn("ending", F.when(~ended, F.lit(None).cast("string"))
                           .when(F.col("interrupted"), "Stopped: interrupted")
                           .when(F.col("error").isNotNull(), F.concat(F.lit("Stopped by an error: "), F.col("error")))
                           .otherwise("finished"))


def previous_unfinished(runs: DataFrame) -> DataFrame:
    """For every run, the start of the run before it in the same log if that one never finished."""
    numbered = number_within(runs, ["log"], ["started_at", "run_id"])
    before = numbered.select("log", (F.col("n") + 1).alias("n"), F.when(
        F.col("finished_at").isNull(), F.col("started_at")).alias("unfinished_start"))
    return numbered.join(before, ["log", "n"], "left").drop("n")
