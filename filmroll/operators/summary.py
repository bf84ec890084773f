"""What happened to each roll, from its frames' results.

`results` holds roll_id, frame_id, name, error, warning, seconds, grade, exposure, linear_scale,
grade_fitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.constants import GRADE_CAP_SLACK, LOW_GRADE_FRAMES, LOW_GRADE_MARGIN, MAX_GRADE, MAX_NAMES
from filmroll.operators.ordering import listed_names
from filmroll.operators.quantiles import exact_quantiles
from filmroll.session import attach

ROLL = ["roll_id"]


def _fitted(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNull() & F.col("grade").isNotNull() & F.coalesce("grade_fitted", F.lit(False)))


def roll_summary(results: DataFrame) -> DataFrame:
    """Range and median of fitted grades, frames at the cap, exposure range, flat scale range. Only
    frames without an error count; grades and exposures only where the grade was fitted."""
    developed = F.col("error").isNull()
    fitted = developed & F.col("grade").isNotNull() & F.coalesce("grade_fitted", F.lit(False))
    grade, exposure = F.when(fitted, F.col("grade")), F.when(fitted, F.col("exposure"))
    scale = F.when(developed, F.col("linear_scale"))
    out = results.groupBy(*ROLL).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(developed).alias("developed"), F.count(grade).alias("fitted"),
        F.min(grade).alias("grade_min"), F.max(grade).alias("grade_max"),
        F.count_if(fitted & (F.col("grade") >= MAX_GRADE - GRADE_CAP_SLACK)).alias("at_cap"),
        F.min(exposure).alias("exposure_min"), F.max(exposure).alias("exposure_max"),
        F.min(scale).alias("scale_min"), F.max(scale).alias("scale_max"))
    return out.join(grade_medians(results).drop("n"), ROLL, "left")


def grade_medians(results: DataFrame) -> DataFrame:
    return exact_quantiles(_fitted(results), ROLL, "grade", {"grade_median": 0.5})


def low_grades(results: DataFrame) -> DataFrame:
    """Frames whose fitted grade is well under their roll's median, on rolls with enough of them."""
    joined = attach(_fitted(results), grade_medians(results), ROLL, label="medians")
    low = F.round(F.col("grade_median") - F.col("grade"), 6) >= LOW_GRADE_MARGIN
    return joined.where((F.col("n") >= LOW_GRADE_FRAMES) & low).select("roll_id", "frame_id", "name", "grade", "grade_median")


def warning_groups(results: DataFrame) -> DataFrame:
    """Warnings grouped by message with the frame's own name or path taken off, in order of first appearance
    (`first_frame`, `first_part`), naming the first few frames."""
    parts = results.where(F.col("warning").isNotNull()).select(
        *ROLL, "frame_id", "name", F.posexplode(F.split("warning", "; ")).alias("part", "_text"))
    # a frame's warning may begin with its name or with its whole path
    head = F.substring_index("_text", ": ", 1)
    by_path = (head != F.col("_text")) & (F.substring_index(head, "/", -1) == F.col("name"))
    message = (F.when(F.startswith("_text", F.concat(F.col("name"), F.lit(": "))), F.expr("substring(_text, length(name) + 3)"))
               .when(by_path, F.expr("substring(_text, length(substring_index(_text, ': ', 1)) + 3)")).otherwise(F.col("_text")))
    rows = parts.withColumn("message", message).where(F.col("message") != "")
    named = listed_names(rows, [*ROLL, "message"], "name", ["frame_id", "part"], MAX_NAMES, " and %d more")
    first = rows.groupBy(*ROLL, "message").agg(F.min(F.struct("frame_id", "part")).alias("_f"))
    return named.join(first, [*ROLL, "message"]).select(
        *ROLL, "message", F.col("count").alias("frames"), "names",
        F.col("_f.frame_id").alias("first_frame"), F.col("_f.part").alias("first_part"))


def run_totals(results: DataFrame, kept: DataFrame) -> DataFrame:
    """One line per roll and one for the whole run (`whole_run` = 1): developed, failed, kept."""
    rows = results.select(*ROLL, F.when(F.col("error").isNull(), "developed").otherwise("failed").alias("state")).unionByName(
        kept.select(*ROLL, F.lit("kept").alias("state")))
    return rows.rollup(*ROLL).agg(
        F.grouping("roll_id").cast("int").alias("whole_run"),
        *[F.count_if(F.col("state") == s).alias(s) for s in ("developed", "failed", "kept")])


def common_decision(provenance: DataFrame) -> DataFrame:
    """Film stock and kind of output a roll's frames share; NULL unless every frame names the same."""
    def shared(column: str):
        return F.when((F.count_if(F.col(column).isNull()) == 0) & (F.min(column) == F.max(column)), F.min(column))

    return provenance.groupBy(*ROLL).agg(
        F.count(F.lit(1)).alias("frames"), shared("film_stock").alias("film_stock"), shared("output").alias("output"))
