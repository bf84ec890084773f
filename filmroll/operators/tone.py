"""Print fit: each frame's exposure and grade, its flat scale, and which of them it uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import (
    FLAT_PERCENTILE, FLAT_TARGET, MAX_GRADE, PAPER_HIGHLIGHT_DENSITY, PAPER_SHADOW_FRACTION,
    PRINT_HIGHLIGHT, PRINT_SHADOW)
from filmroll.functions.density import log_luminance
from filmroll.functions.pixel import Curve, is_finite
from filmroll.operators.pixels import FRAME
from filmroll.operators.quantiles import exact_quantiles, largest_group
from filmroll.session import attach


def density_range(positive: DataFrame, at_most: int | None = None) -> DataFrame:
    """Per frame: robust ends of its density range, measured on luminance. `at_most` bounds the pixels of a frame, where known."""
    measured = positive.select(*FRAME, log_luminance(F.col("r"), F.col("g"), F.col("b")).alias("_d"))
    return exact_quantiles(measured, FRAME, "_d", {"d_lo": PRINT_SHADOW, "d_hi": PRINT_HIGHLIGHT}, at_most)


def paper_range(curves: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Per curve (rows `keys`, i, v; v rising with i): the inputs where it first reaches the paper's
    last separable shadow tone and its first visible highlight tone, between entries linearly."""
    ends = curves.groupBy(*keys).agg(F.min("v").alias("_min"), F.max("i").alias("_last"))
    aims = ends.select(
        *keys, "_last", F.lit(10.0 ** -PAPER_HIGHLIGHT_DENSITY).alias("_highlight_v"),
        F.pow(F.lit(10.0), F.log10("_min") * PAPER_SHADOW_FRACTION).alias("_shadow_v"))
    aimed = attach(curves, aims, keys, label="aims")

    def crossing(point: str) -> list[Column]:
        reached = F.col("v") >= F.col(f"_{point}_v")  # numbers, not rows of them, so that they are hashed and not sorted
        at, under = F.when(reached, F.col("i")), F.when(~reached, F.col("i"))
        return [F.min(at).alias(f"_{point}_i"), F.min_by("v", at).alias(f"_{point}_at"), F.max_by("v", under).alias(f"_{point}_under")]

    found = aimed.groupBy(*keys).agg(
        F.first("_last").alias("_last"), *[F.first(f"_{p}_v").alias(f"_{p}_v") for p in ("shadow", "highlight")],
        *crossing("shadow"), *crossing("highlight"))
    step = F.lit(high - low) / F.col("_last")

    def at(point: str) -> Column:
        hit, under, aim = F.col(f"_{point}_at"), F.col(f"_{point}_under"), F.col(f"_{point}_v")
        share = (aim - under) / F.when(hit > under, hit - under)
        return F.when(hit.isNull() | under.isNull(), F.lit(low)).otherwise(
            (F.col(f"_{point}_i") - 1 + share) * step + low).alias(f"{point}_point")

    return found.select(*keys, at("shadow"), at("highlight"))


def curve_range(curve: Curve) -> tuple[float, float]:
    """`paper_range` of the one curve a plan prints on."""
    import numpy as np

    values = np.asarray(curve.values)
    step = (curve.high - curve.low) / (len(values) - 1)

    def first_at(aim: float) -> float:
        hit = int(np.argmax(values >= aim))
        if hit == 0:
            return curve.low
        return curve.low + (hit - 1 + (aim - values[hit - 1]) / (values[hit] - values[hit - 1])) * step

    return (first_at(10.0 ** (PAPER_SHADOW_FRACTION * np.log10(values.min()))),
            first_at(10.0 ** -PAPER_HIGHLIGHT_DENSITY))


def fit_print(ranges: DataFrame, curve: Curve, grade: Column | None = None) -> DataFrame:
    """Exposure and grade that put each frame's density range on the paper's. A pinned `grade` leaves
    only the exposure to fit. A range that isn't a number gives an error instead of a print."""
    shadow, highlight = curve_range(curve)
    pin = F.lit(None).cast("double") if grade is None else grade
    span = F.col("d_hi") - F.col("d_lo")
    fitted = F.when(span > 0, F.least(F.lit(highlight - shadow) / F.when(span > 0, span), F.lit(MAX_GRADE))
                    ).otherwise(F.lit(MAX_GRADE))
    ok = is_finite(F.col("d_lo")) & is_finite(F.col("d_hi"))
    out = ranges.withColumns({
        "error": F.when(~F.coalesce(ok, F.lit(False)), "couldn't fit the print: the density range isn't a valid number"),
        "grade": F.when(ok, F.coalesce(pin, fitted)),
        "grade_fitted": pin.isNull()})
    g = F.col("grade")
    return out.withColumn("exposure", F.when(g == 0, F.lit(curve.pivot) - F.col("d_hi")).otherwise(
        F.lit(highlight - curve.pivot) / F.when(g != 0, g) + curve.pivot - F.col("d_hi")))


def linear_scale(positive: DataFrame) -> DataFrame:
    """Per frame: the flat scale that puts a robust highlight, over all channels pooled, at 0.8. A highlight that
    isn't a number gives an error instead of a scale."""
    pooled = positive.select(*FRAME, F.explode(F.array("r", "g", "b")).alias("_v"))
    q = exact_quantiles(pooled, FRAME, "_v", {"highlight": FLAT_PERCENTILE}, 3 * largest_group(positive, FRAME))
    h = F.col("highlight")
    ok = F.coalesce(is_finite(h), F.lit(False))
    return q.select(*FRAME, h, F.when(ok, F.when(h > 0, F.lit(FLAT_TARGET) / F.when(h > 0, h)).otherwise(F.lit(1.0))).alias("linear_scale"),
                    F.when(~ok, "no flat scale: the brightest values aren't valid numbers").alias("error"))


def resolve_tone(frames: DataFrame, fits: DataFrame, scales: DataFrame) -> DataFrame:
    """What each frame is printed with, or why it can't be (`error`, where nothing pinned or saved helps). `frames` carries `mode` ("paper" / "linear") and optional
    `pinned_exposure`, `pinned_grade`, `saved_exposure`, `saved_grade`: a pin beats a saved value,
    which beats the fit. `fits` must have been made with the same grades pinned."""
    def said(df: DataFrame, name: str) -> Column:
        return (F.col("error") if "error" in df.columns else F.lit(None).cast("string")).alias(name)

    joined = frames.join(fits.select(*FRAME, "exposure", "grade", said(fits, "_fit_error")), FRAME, "left").join(
        scales.select(*FRAME, "linear_scale", said(scales, "_scale_error")), FRAME, "left")
    paper = F.col("mode") == "paper"
    chosen = F.coalesce("pinned_grade", "saved_grade")
    out = joined.select(
        *FRAME, "mode",
        F.when(paper, F.coalesce("pinned_exposure", "saved_exposure", "exposure")).alias("exposure"),
        F.when(paper, F.coalesce(chosen, F.col("grade"))).alias("grade"),
        F.when(~paper, F.col("linear_scale")).alias("linear_scale"),
        F.when(paper, chosen.isNull()).alias("grade_fitted"), "_fit_error", "_scale_error")
    unfit = F.when(paper, F.col("exposure").isNull() | F.col("grade").isNull()).otherwise(F.col("linear_scale").isNull())
    reason = F.coalesce(F.when(paper, F.col("_fit_error")).otherwise(F.col("_scale_error")), F.lit("the frame has no fit"))
    return out.withColumn("error", F.when(unfit, reason)).drop("_fit_error", "_scale_error")
