"""Per-pixel operators over `pixels` (roll_id, frame_id, y, x, r, g, b) and per-frame parameters."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import NONFINITE_LIMIT
from filmroll.functions.colour import working_to_srgb
from filmroll.functions.density import floored
from filmroll.functions.pixel import (
    RGB, Curve, balanced, chroma, is_finite, map_rgb, matrix_rgb, srgb_encode, to_8bit)
from filmroll.functions.text import fixed
from filmroll.session import attach, known_bytes

FRAME = ["roll_id", "frame_id"]
PLACE = ["y", "x"]
PROFILE = ["wb_r", "wb_g", "wb_b", "s_r", "s_g", "s_b"]
IDENTITY = dict.fromkeys(PROFILE, 1.0)


class Stage(Enum):
    FULL = "full"
    INVERT_ONLY = "invert-only"
    DENSITY_ONLY = "density-only"


def to_working(df: DataFrame, matrix=None, matrices: DataFrame | None = None) -> DataFrame:
    """Linear RGB -> working space: one 3x3 for all, or one per `source` joined from `matrices`
    (source, m ARRAY of nine). A source without a matrix is in the working space already."""
    if matrices is None:
        return matrix_rgb(df, matrix)
    joined = attach(df, matrices, ["source"], "left", "matrices")
    r, g, b = (F.col(c) for c in RGB)
    return joined.withColumns({
        c: F.when(F.col("m").isNull(), F.col(c)).otherwise(
            r * F.get("m", F.lit(3 * i)) + g * F.get("m", F.lit(3 * i + 1)) + b * F.get("m", F.lit(3 * i + 2)))
        for i, c in enumerate(RGB)}).drop("m")


def clean_nonfinite(df: DataFrame) -> DataFrame:
    """NaN, infinite or missing values become 0; `bad` marks the pixel once, however many channels it hit."""
    fine = {c: F.coalesce(is_finite(F.col(c)), F.lit(False)) for c in RGB}
    return df.withColumns({"bad": ~(fine["r"] & fine["g"] & fine["b"]),
                           **{c: F.when(ok, F.col(c)).otherwise(F.lit(0.0)) for c, ok in fine.items()}})


def frame_report(cleaned: DataFrame) -> DataFrame:
    """`nonfinite_report`, with each frame's number of pixels."""
    counts = cleaned.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("bad").alias("bad_pixels"), F.avg(F.col("bad").cast("double")).alias("share"))
    failed = F.col("share") > NONFINITE_LIMIT
    return counts.withColumns({
        "failed": failed,
        "message": F.when(failed, F.concat(
            fixed(F.col("share") * 100, 1), F.lit("% of its pixels aren't valid numbers")))
        .when(F.col("bad_pixels") == 1, F.lit("1 pixel wasn't a valid number and was treated as clear film"))
        .when(F.col("bad_pixels") > 1, F.concat(
            F.col("bad_pixels").cast("string"),
            F.lit(" pixels weren't valid numbers and were treated as clear film")))})


def nonfinite_report(cleaned: DataFrame) -> DataFrame:
    """Per frame: bad pixels, their share, whether the frame failed, and what to say about it."""
    return frame_report(cleaned).drop("pixels")


def apply_gain(df: DataFrame, gains: DataFrame) -> DataFrame:
    """Multiply by the frame's scan gain; 1 where it has none."""
    joined = attach(df, gains.select(*FRAME, "gain"), FRAME, "left", "gains", size=known_bytes(gains))
    return map_rgb(joined, lambda c: c * F.coalesce(F.col("gain"), F.lit(1.0))).drop("gain")


def with_profile(df: DataFrame, profile: dict[str, float] | DataFrame, on: list[str] = FRAME) -> DataFrame:
    """Put the six calibration columns next to each pixel; NULL where there is no calibration, so that what is
    computed from them is NULL too and no pixel comes out looking valid."""
    if isinstance(profile, dict):
        return df.withColumns({k: F.lit(float(v)) for k, v in profile.items()})
    return attach(df, profile.select(*on, *PROFILE), on, "left", "profiles", size=known_bytes(profile))


def _wb(c: str) -> Column:
    return F.col(f"wb_{c}")


def _scale(c: str) -> Column:
    return F.col(f"s_{c}")


def white_balance(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c) * _wb(c) for c in RGB})


def density_balance(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.pow(floored(F.col(c)), _scale(c)) for c in RGB})


def invert(df: DataFrame) -> DataFrame:
    return map_rgb(df, lambda c: F.lit(1.0) / floored(c))


def to_positive(df: DataFrame) -> DataFrame:
    """White balance, density balance, inversion: one projection."""
    return df.withColumns({c: F.lit(1.0) / floored(balanced(F.col(c), _wb(c), _scale(c))) for c in RGB})


def develop(df: DataFrame, stage: Stage, profile: dict[str, float] | DataFrame) -> DataFrame:
    """Negative to positive as far as the stage goes; the calibration is ignored by INVERT_ONLY."""
    if stage is Stage.INVERT_ONLY:
        return to_positive(with_profile(df, IDENTITY))
    calibrated = with_profile(df, profile)
    if stage is Stage.DENSITY_ONLY:
        return density_balance(white_balance(calibrated))
    return to_positive(calibrated)


def with_tone(df: DataFrame, frame_tone: DataFrame, how: str = "left") -> DataFrame:
    return attach(df, frame_tone.select(*FRAME, "exposure", "grade", "linear_scale"), FRAME, how, "tone", size=known_bytes(frame_tone))


def print_paper(df: DataFrame, curve: Curve) -> DataFrame:
    """Needs `exposure` and `grade` (see `with_tone`)."""
    return map_rgb(df, lambda c: curve.lookup(
        (F.log10(floored(c)) + F.col("exposure") - curve.pivot) * F.col("grade") + curve.pivot))


def print_flat(df: DataFrame) -> DataFrame:
    """Needs `linear_scale`; nothing is clipped."""
    return map_rgb(df, lambda c: c * F.col("linear_scale"))


def unscale_flat(df: DataFrame, provenance: DataFrame) -> DataFrame:
    """Undo the scale a flat positive was written with, where it is recorded."""
    joined = attach(df, provenance.select(*FRAME, F.col("linear_scale").alias("_scale")), FRAME, "left", "scales")
    usable = F.col("_scale") > 0
    return map_rgb(joined, lambda c: F.when(usable, c / F.when(usable, F.col("_scale"))).otherwise(c)).drop("_scale")


def printable_pins(provenance: DataFrame, exposure: Column) -> DataFrame:
    """A pinned exposure only means something on a frame whose flat scale is recorded; elsewhere it is
    dropped with a warning and fitted instead."""
    known = F.coalesce(F.col("linear_scale") > 0, F.lit(False))
    return provenance.withColumns({
        "pinned_exposure": F.when(known, exposure),
        "warning": F.when(~known & exposure.isNotNull(), F.lit(
            "no recorded flat scale, so a pinned exposure can't be reproduced: fitting it instead"))})


def to_srgb8(df: DataFrame) -> DataFrame:
    """Working space -> 8-bit sRGB, clipped to the displayable range."""
    return map_rgb(matrix_rgb(df, working_to_srgb()), lambda c: to_8bit(srgb_encode(c)))


def with_chroma(df: DataFrame) -> DataFrame:
    return df.withColumn("chroma", chroma(F.col("r"), F.col("g"), F.col("b")))


def valid_pixels(df: DataFrame) -> DataFrame:
    """All channels finite and at least one positive."""
    r, g, b = (F.col(c) for c in RGB)
    return df.where(is_finite(r) & is_finite(g) & is_finite(b) & (F.greatest(r, g, b) > 0))


def stride_sample(df: DataFrame, k: int) -> DataFrame:
    """Every k-th row and column."""
    return df.where((F.col("x") % k == 0) & (F.col("y") % k == 0))
