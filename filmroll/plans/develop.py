"""Whole runs composed from operators: one plan for any number of rolls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.functions.pixel import RGB, Curve
from filmroll.operators import auto, pixels as px, tone
from filmroll.session import attach, known_bytes, materialize, store

FRAME = px.FRAME


def frame_tones(positive: DataFrame, curve: Curve, grade: Column | None = None, at_most: int | None = None) -> DataFrame:
    """Each frame's fitted exposure and grade, or the error that kept it from a fit."""
    fits = tone.fit_print(tone.density_range(positive, at_most), curve, grade)
    return fits.withColumn("linear_scale", F.lit(None).cast("double"))


@dataclass(frozen=True)
class Developed:
    """What became of a run: the printed pixels of the frames that could be developed, and a row for every frame: pixels,
    bad_pixels, message, exposure, grade and `error`, the reason where it has no print."""
    frames: DataFrame
    outcomes: DataFrame

    def errors(self) -> DataFrame:
        return self.outcomes.where("error IS NOT NULL").select(*FRAME, "error")


def develop(negatives: DataFrame, profile: dict[str, float] | DataFrame, curve: Curve, gains: DataFrame | None = None,
            on: list[str] = FRAME, unknown: str = "the frame has no calibration") -> Developed:
    """Negatives to prints: clean, match exposure, balance and invert, fit every frame, print. The pixels are read once to
    count them and the bad ones, once to fit, and once to print; a frame is refused for the first reason of: too many pixels that
    aren't numbers, no whole calibration (`unknown`), a density range that can't be fitted."""
    cleaned = px.clean_nonfinite(negatives)
    report, facts = store(px.frame_report(cleaned), "report", largest=F.max("pixels"))
    error = F.when(F.col("failed"), F.col("message"))
    if isinstance(profile, DataFrame):
        report_ = attach(report, profile.select(*on, F.concat_ws("", *[F.when(F.col(c).isNull(), "x") for c in px.PROFILE]).alias("_lack")), on, "left", "profiles")
        error = error.when(F.coalesce(F.col("_lack") != "", F.lit(True)), unknown)
    else:
        report_ = report
    early = materialize(report_.select(*FRAME, "pixels", "bad_pixels", "message", error.alias("error")), "early")
    frames = attach(cleaned.drop("bad"), early.where("error IS NOT NULL").select(*FRAME), FRAME, "left_anti", "refused", size=known_bytes(early))
    if gains is not None:
        frames = px.apply_gain(frames, gains)
    positive = px.to_positive(px.with_profile(frames, profile, on))
    tones = materialize(frame_tones(positive, curve, at_most=int(facts["largest"] or 0)).select(*FRAME, "exposure", "grade", "linear_scale", "error"), "tones")
    fitted = materialize(tones.where("error IS NULL").drop("error"), "fitted")
    outcomes = early.join(tones.select(*FRAME, "exposure", "grade", F.col("error").alias("_late")), FRAME, "left")
    return Developed(px.print_paper(px.with_tone(positive, fitted, "inner"), curve),
                     outcomes.withColumn("error", F.coalesce("error", "_late")).drop("_late"))


def printed(positive: DataFrame, curve: Curve) -> DataFrame:
    """Frames that could be fitted, printed."""
    tones = materialize(frame_tones(positive, curve).where("error IS NULL").select(*FRAME, "exposure", "grade", "linear_scale"), "tones")
    return px.print_paper(px.with_tone(positive, tones, "inner"), curve)


def develop_errors(negatives: DataFrame, profile: dict[str, float] | DataFrame, curve: Curve) -> DataFrame:
    """One row per frame that can't be developed, with the first reason."""
    return develop(negatives, profile, curve).errors()


def usable_frames(negatives: DataFrame) -> DataFrame:
    """Cleaned pixels without the frames too broken to develop; `nonfinite_report` says which and why."""
    cleaned = px.clean_nonfinite(negatives)
    failed = px.nonfinite_report(cleaned).where("failed").select(*FRAME)
    return attach(cleaned.drop("bad"), failed, FRAME, "left_anti", "failed")


def print_frames(negatives: DataFrame, profile: dict[str, float] | DataFrame, curve: Curve, gains: DataFrame | None = None) -> DataFrame:
    """The prints of `develop`."""
    return develop(negatives, profile, curve, gains).frames


def print_summary(negatives: DataFrame, profile, curve: Curve) -> DataFrame:
    """Per frame: the print decision and the mean printed value of each channel."""
    printed = print_frames(negatives, profile, curve)
    return printed.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("pixels"), F.first("exposure").alias("exposure"), F.first("grade").alias("grade"),
        *[F.avg(c).alias(f"mean_{c}") for c in RGB])


def roll_profiles(negatives: DataFrame, stride: int, gains: DataFrame | None = None) -> DataFrame:
    """One automatic calibration per roll, from every stride-th row and column of its usable frames."""
    sample = px.stride_sample(usable_frames(negatives), stride)
    if gains is not None:
        sample = px.apply_gain(sample, gains)
    return auto.roll_estimate(materialize(auto.auto_estimate(materialize(sample, "sample")), "estimates"))  # read twice, to size and to halve


def develop_all(negatives: DataFrame, curve: Curve, stride: int, gains: DataFrame | None = None) -> Developed:
    """A batch run: every roll calibrated from its own frames, every frame printed with its roll's. Frames of a roll that got no
    calibration are told of, like all others that have no print."""
    rolls = materialize(roll_profiles(negatives, stride, gains), "rolls")
    return develop(negatives, rolls, curve, gains, ["roll_id"], "no frame of its roll gave a calibration")


def develop_rolls(negatives: DataFrame, curve: Curve, stride: int, gains: DataFrame | None = None) -> DataFrame:
    return develop_all(negatives, curve, stride, gains).frames
