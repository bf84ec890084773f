"""Was a roll digitised consistently, and the one correction that can be made when it was not.

`meta` holds roll_id, frame_id, name, t, f, iso (NULL without EXIF), wb ARRAY<DOUBLE>, wb_kind STRING
("multipliers", "camera reference (D65)" or NULL) and tonal_modules ARRAY<STRING>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import CAMERA_REFERENCE, EXPOSURE_TOLERANCE_STOPS, WHITE_BALANCE_TOLERANCE
from filmroll.functions.scan import describe_scan, relative_exposure, stops
from filmroll.operators.pixels import FRAME, PROFILE
from filmroll.session import attach

ROLL = ["roll_id"]
CHANNELS = ("r", "g", "b")


def _light() -> Column:
    return relative_exposure(F.col("t"), F.col("f"), F.col("iso"))


def _described(meta: DataFrame) -> DataFrame:
    known = F.col("t").isNotNull()
    own_wb = F.col("wb_kind") == "multipliers"
    rounded = F.array_join(F.transform("wb", lambda v: F.format_string("%.4f", F.round(v, 4))), " ")
    return meta.withColumns({
        "exposure_group": F.when(known, describe_scan(F.col("t"), F.col("f"), F.col("iso"))),
        "rel": F.when(known, _light()),
        "wb_group": F.when(own_wb, rounded).when(F.col("wb_kind") == CAMERA_REFERENCE, F.col("wb_kind")),
        "tonal": F.coalesce(F.size("tonal_modules") > 0, F.lit(False)),
        **{f"wb_{c}": F.when(own_wb, F.get("wb", F.lit(i))) for i, c in enumerate(CHANNELS)}})


_ENDS = ["rel", *[f"wb_{c}" for c in CHANNELS]]
_COUNTS = ["frames", "by_name", "tonal_frames", "missing_exif"]


def scan_tallies(meta: DataFrame) -> DataFrame:
    """What `report_of` needs of each roll's settings: rows per pair of groups that can be merged with others."""
    rows = _described(meta)
    return rows.groupBy(*ROLL, "exposure_group", "wb_group").agg(
        *[f(c).alias(f"{n}_{c}") for c in _ENDS for n, f in (("min", F.min), ("max", F.max))], F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col("wb_group") == CAMERA_REFERENCE).alias("by_name"), F.count_if("tonal").alias("tonal_frames"),
        F.count_if(F.col("t").isNull()).alias("missing_exif"))


def merged_tallies(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy(*ROLL, "exposure_group", "wb_group").agg(
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in _ENDS for n, f in (("min", F.min), ("max", F.max))], *[F.sum(c).alias(c) for c in _COUNTS])


def report_of(tallies: DataFrame) -> DataFrame:
    """Per roll: exposure and white-balance groups, their spread, frames with tone modules on or
    without EXIF, and the three verdicts."""
    spread = [F.coalesce(F.max(f"max_wb_{c}") / F.min(f"min_wb_{c}") - 1.0, F.lit(0.0)).alias(f"wb_spread_{c}") for c in CHANNELS]
    out = tallies.groupBy(*ROLL).agg(
        F.sum("frames").alias("frames"),
        F.count_distinct("exposure_group").alias("exposure_groups"),
        F.coalesce(stops(F.max("max_rel"), F.min("min_rel")), F.lit(0.0)).alias("spread_stops"),
        F.count_distinct("wb_group").alias("wb_groups"), *spread,
        F.sum("by_name").alias("_by_name"), F.sum("tonal_frames").alias("tonal_frames"), F.sum("missing_exif").alias("missing_exif"))
    widest = F.greatest(*[F.col(f"wb_spread_{c}") for c in CHANNELS])
    return out.withColumns({
        "exposure_inconsistent": F.col("spread_stops") > EXPOSURE_TOLERANCE_STOPS,
        "wb_inconsistent": ((F.col("_by_name") > 0) & (F.col("wb_groups") > 1)) | (widest > WHITE_BALANCE_TOLERANCE),
        "tone_modules_on": F.col("tonal_frames") > 0}).drop("_by_name")


def scan_report(meta: DataFrame) -> DataFrame:
    return report_of(scan_tallies(meta))


def setting_groups(meta: DataFrame, column: str) -> DataFrame:
    """Frames per exposure ("exposure_group") or white-balance ("wb_group") group."""
    return _described(meta).where(F.col(column).isNotNull()).groupBy(*ROLL, column).agg(
        F.count(F.lit(1)).alias("frames"), F.min("name").alias("first_name"))


def main_groups(meta: DataFrame, column: str) -> DataFrame:
    """The largest group of each roll; on a tie, the one holding the first name."""
    groups = setting_groups(meta, column)
    best = groups.groupBy(*ROLL).agg(F.min(F.struct((-F.col("frames")).alias("order"), "first_name", column)).alias("_m"))
    return best.select(*ROLL, F.col(f"_m.{column}").alias(f"main_{column}"))


def frame_flags(meta: DataFrame) -> DataFrame:
    """Frames scanned differently from the rest of their roll, with every reason on one line."""
    report = scan_report(meta).select(*ROLL, "frames", "missing_exif", "exposure_inconsistent", "wb_inconsistent")
    per_roll = report.join(main_groups(meta, "exposure_group"), ROLL, "left").join(main_groups(meta, "wb_group"), ROLL, "left")
    rows = attach(_described(meta), per_roll, ROLL, "left", "mains")
    odd_exposure = F.col("exposure_inconsistent") & (F.col("exposure_group") != F.col("main_exposure_group"))
    odd_wb = F.col("wb_inconsistent") & (F.col("wb_group") != F.col("main_wb_group"))
    reasons = F.concat_ws(
        "; ",
        F.when(odd_exposure, F.concat(F.lit("digitized at "), F.col("exposure_group"), F.lit(", most of the roll at "), F.col("main_exposure_group"))),
        F.when(odd_wb, "exported with a different raw white balance from most of the roll"),
        F.when(F.col("tonal"), F.concat(F.lit("tone/colour modules active in the raw editor ("), F.array_join("tonal_modules", ", "), F.lit(")"))),
        F.when(F.col("t").isNull() & (F.col("missing_exif") < F.col("frames")), "no camera EXIF, so it can't be checked against the others"))
    return rows.select(*FRAME, "name", reasons.alias("flags")).where(F.col("flags") != "")


def choose_reference(rolls: DataFrame, explicit: DataFrame, recorded: DataFrame, common: DataFrame) -> DataFrame:
    """The scan exposure each roll is matched to: a named frame's, else the one its profile recorded,
    else the roll's most common. The three tables are (roll_id, ref_exposure)."""
    out = rolls.select(*ROLL)
    for name, table in (("explicit", explicit), ("profile", recorded), ("common", common)):
        out = out.join(table.select(*ROLL, F.col("ref_exposure").alias(name)), ROLL, "left")
    return out.select(*ROLL, F.coalesce("explicit", "profile", "common").alias("ref_exposure"),
                      F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("profile").isNotNull(), "profile")
                      .when(F.col("common").isNotNull(), "common").alias("origin"))


def scan_match(meta: DataFrame, reference: DataFrame) -> DataFrame:
    """Each frame's gain to its roll's reference exposure; frames without EXIF keep 1 and are marked."""
    joined = attach(meta, reference.select(*ROLL, "ref_exposure"), ROLL, "left", "reference")
    gain = F.coalesce(F.col("ref_exposure") / F.when(F.col("t").isNotNull(), _light()), F.lit(1.0))
    return joined.select(*FRAME, gain.alias("gain"), (F.abs(gain - 1.0) > 1e-9).alias("adjusted"),
                         F.col("t").isNull().alias("missing_exif"))


def choose_calibration(frames: DataFrame, fits: DataFrame, rolls: DataFrame, own: DataFrame,
                       gains: DataFrame) -> DataFrame:
    """The calibration each frame develops with: its roll's accepted fit, else the roll's estimate, else
    the frame's own estimate, which was measured on the frame as scanned and so takes no gain."""
    def struct(df: DataFrame, on: list[str], name: str) -> DataFrame:
        return df.select(*on, F.struct(*PROFILE).alias(name))

    rows = frames.select(*FRAME).join(struct(own, FRAME, "_own"), FRAME, "left").join(gains.select(*FRAME, "gain"), FRAME, "left")
    rows = attach(rows, struct(fits.where(F.col("reason").isNull()), ROLL, "_fit"), ROLL, "left", "fits")
    rows = attach(rows, struct(rolls, ROLL, "_roll"), ROLL, "left", "rolls")
    chosen = F.coalesce("_fit", "_roll", "_own")
    shared = F.col("_fit").isNotNull() | F.col("_roll").isNotNull()
    return rows.select(
        *FRAME, *[chosen[c].alias(c) for c in PROFILE],
        F.when(F.col("_fit").isNotNull(), "fit").when(F.col("_roll").isNotNull(), "roll")
        .when(F.col("_own").isNotNull(), "own").alias("origin"),
        F.when(shared, F.coalesce("gain", F.lit(1.0))).otherwise(F.lit(1.0)).alias("gain"))


def unique_inputs(files: DataFrame) -> DataFrame:
    """A file named twice counts once; same-named files of different folders are labelled apart."""
    from filmroll.functions.text import base_name, parent

    files = files.dropDuplicates(["path"])
    rows = files.withColumn("name", base_name(F.col("path")))
    repeats = rows.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    out = attach(rows, repeats, ["name"], "left", "repeats")
    return out.withColumn("label", F.when(F.col("_n") > 1, F.concat(
        base_name(parent(F.col("path"))), F.lit("/"), F.col("name"))).otherwise(F.col("name"))).drop("_n")
