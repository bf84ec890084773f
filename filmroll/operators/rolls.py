"""Roll bookkeeping: which files are frames, their numbers and output names, what to develop.

`files` holds path, folder, name, is_dir, is_contact_sheet and description (a file's embedded text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import TIFF_SUFFIXES
from filmroll.functions.text import base_name, file_kind, natural_key, output_name, stem
from filmroll.operators.ordering import number_within
from filmroll.session import attach
from filmroll.sources.provenance import provenance_record

OTHER_KINDS = ("JPEG", "PNG", "non-TIFF file", "raw file")


def classify(files: DataFrame, accepted: tuple[str, ...] = TIFF_SUFFIXES) -> DataFrame:
    """Adds `kind`. A file that carries a provenance record is a positive, not a scan."""
    positive = provenance_record(F.col("description")).isNotNull()
    return files.withColumn("kind", file_kind(
        F.col("name"), F.col("is_dir"), F.coalesce(F.col("is_contact_sheet"), F.lit(False)), positive, accepted))


def scans(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("kind") == "scan")


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.concat(F.lit("1 "), F.lit(one))).when(n > 1, F.concat(n.cast("string"), F.lit(" " + many)))


def skipped_counts(classified: DataFrame) -> DataFrame:
    """Per folder: what a listing left out, by reason, and the line that says so."""
    kinds = {"macos": "macos", "hidden_only": "hidden", "contact_sheets": "contact sheet", "folders": "folder",
             "positives": "positive", **{k.lower().replace(" ", "_").replace("-", "_"): k for k in OTHER_KINDS}}
    out = classified.groupBy("folder").agg(*[F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()])
    hidden = F.col("hidden_only") + F.col("macos")
    out = out.withColumn("hidden", hidden).drop("hidden_only")
    only_macos = F.col("macos") == F.col("hidden")
    line = F.concat_ws(
        ", ",
        F.when(only_macos, _counted(F.col("hidden"), "hidden macOS file", "hidden macOS files"))
        .otherwise(_counted(F.col("hidden"), "hidden file", "hidden files")),
        _counted(F.col("contact_sheets"), "contact sheet", "contact sheets"),
        *[_counted(F.col(k.lower().replace(" ", "_").replace("-", "_")), k, k + "s") for k in OTHER_KINDS],
        _counted(F.col("folders"), "folder", "folders"), _counted(F.col("positives"), "positive", "positives"))
    return out.withColumn("description", line)


def natural_order(df: DataFrame, name: str = "name") -> DataFrame:
    """Sorted so that numbers inside names count as numbers."""
    return df.orderBy(natural_key(F.col(name)))


def frame_numbers(frames: DataFrame, group: str = "folder") -> DataFrame:
    """Natural-order frame number `n` over all of a roll's scans, developed or not."""
    keyed = frames.withColumn("_key", natural_key(F.col("name")))
    return number_within(keyed, [group], ["_key", "path"]).drop("_key")


def roll_names(folders: DataFrame, top: str) -> DataFrame:
    """A roll is named for the folder directly under `top`; rolls sharing one take their whole path
    below it, joined with " - "."""
    below = F.when(F.col("folder") == top, F.lit("")).otherwise(F.expr(f"substring(folder, {len(top) + 2})"))
    head = F.when(below == "", base_name(F.lit(top))).otherwise(F.substring_index(below, "/", 1))
    rows = folders.select("folder", below.alias("_below"), head.alias("_head"))
    sizes = rows.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    joined = attach(rows, sizes, ["_head"], "left", "heads")
    name = F.when((F.col("_n") == 1) | (F.col("_below") == ""), F.col("_head")).otherwise(
        F.regexp_replace("_below", "/", " - "))
    return joined.select("folder", name.alias("roll_name"))


def hidden_folder(folder: Column, top: str) -> Column:
    """Whether a folder, or one between it and `top`, has a name that starts with a dot."""
    return F.substring(folder, len(top) + 1, 2**31 - 1).rlike(r"/\.")


def _placed(folders: DataFrame, destinations: DataFrame) -> DataFrame:
    return folders.join(destinations.select("folder").distinct().withColumn("_to", F.lit(True)), "folder", "left").withColumn("_to", F.coalesce("_to", F.lit(False)))


def exclude_destinations(folders: DataFrame, destinations: DataFrame, top: str = "") -> DataFrame:
    """Folders that are rolls: they hold scans, aren't hidden, and are not where this run writes. `folders` comes from
    the listing with `scans` and `positives` counts; one left with positives only is earlier output."""
    return _placed(folders.where((F.col("scans") > 0) & ~hidden_folder(F.col("folder"), top)), destinations).where(~F.col("_to")).drop("_to")


def skipped_folders(folders: DataFrame, destinations: DataFrame, top: str = "") -> DataFrame:
    """One row: how many folders are no rolls because they hold earlier output only, or are where this run writes. Hidden ones
    aren't entered, so they aren't counted."""
    seen = _placed(folders.where(~hidden_folder(F.col("folder"), top)), destinations)
    return seen.agg(F.count_if((F.col("scans") == 0) & (F.col("positives") > 0)).alias("earlier_outputs"),
                    F.count_if((F.col("scans") > 0) & F.col("_to")).alias("destinations"))


def roll_clashes(planned: DataFrame) -> DataFrame:
    """Output folders, compared without case, that more than one roll with frames to develop would be written to. `planned`:
    folder, roll_name, output_dir, jobs."""
    written = planned.where((F.col("jobs") > 0) & F.col("output_dir").isNotNull())
    return written.groupBy(F.lower("output_dir").alias("output_key")).agg(
        F.count(F.lit(1)).alias("rolls"), F.min(F.struct("folder", "roll_name"))["roll_name"].alias("first_roll"),
        F.max(F.struct("folder", "roll_name"))["roll_name"].alias("last_roll")).where(F.col("rolls") > 1)


def plan_jobs(numbered: DataFrame, out_dir: Column, template: str, roll: Column, stock: Column,
              extension: str | None = None) -> DataFrame:
    """One job per scan: its output path, or why its name can't be used."""
    name, problem = output_name(template, stem(F.col("name")), roll, F.col("n"), stock)
    ext = suffix_as_typed(F.col("name")) if extension is None else F.lit(extension)
    return numbered.withColumns({"output_path": F.concat(out_dir, F.lit("/"), name, ext), "problem": problem})


def suffix_as_typed(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def skip_existing(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Resume: only the frames whose output is not there yet."""
    return jobs.join(existing.select(F.col("path").alias("output_path")).distinct(), "output_path", "left_anti")


def kept_frames(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    return jobs.join(existing.select(F.col("path").alias("output_path")).distinct(), "output_path", "left_semi")


def existing_report(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Per folder: frames planned and how many outputs exist already."""
    known = existing.select(F.col("path").alias("output_path"), F.lit(True).alias("_there")).distinct()
    return jobs.join(known, "output_path", "left").groupBy("folder").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.coalesce("_there", F.lit(False))).alias("existing"))


def output_is_input(jobs: DataFrame) -> DataFrame:
    """Jobs that would write over one of this run's scans."""
    inputs = jobs.select(F.col("path").alias("output_path")).distinct()
    return jobs.join(inputs, "output_path", "left_semi")


def output_clashes(jobs: DataFrame) -> DataFrame:
    """Output paths, compared without case, that several scans would be written to."""
    return jobs.groupBy(F.lower("output_path").alias("output_key")).agg(
        F.count(F.lit(1)).alias("inputs"), F.min("path").alias("first_input"), F.max("path").alias("last_input")
    ).where(F.col("inputs") > 1)


def all_jobs(*rolls: DataFrame) -> DataFrame:
    """One job table over many rolls."""
    out = rolls[0]
    for more in rolls[1:]:
        out = out.unionByName(more)
    return out


def new_points(points: DataFrame, in_profile: DataFrame) -> DataFrame:
    """Points not in the profile in use."""
    return points.exceptAll(in_profile)


