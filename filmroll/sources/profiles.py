"""Calibration profiles kept as JSON files, and changes to the profile table."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from filmroll.constants import EDITABLE_FIELDS
from filmroll.functions.pixel import is_finite
from filmroll.functions.text import base_name, stem
from filmroll.session import materialize
from filmroll.sources.versions import Head, Versions

SCAN = "struct<exposure_time:double,f_number:double,iso:double>"
ANCHOR = f"struct<frame:string,x:int,y:int,rgb:array<double>,scan:{SCAN}>"
PROFILE = (f"struct<white_balance:array<double>,density_scale:array<double>,name:string,film_stock:string,"
           f"process:string,scanner:string,created_at:string,source:string,notes:string,"
           f"tone:struct<exposure:double,contrast:double>,scan:{SCAN},anchors:array<{ANCHOR}>>")
SIDECARS = ("tone", "scan", "anchors")
BODY = ("white_balance", "density_scale", "film_stock", "process", "scanner", "created_at", "source", "notes", *SIDECARS)


WRITTEN = "file="
HIDDEN = r"^\.|^_(?!metadata|common_metadata)[^=]*$|\._COPYING_$"  # as Spark's readers have it


def read_profiles(spark: SparkSession, glob: str) -> DataFrame:
    """Every profile file under `glob` (a path whose names may have `*`, `?`, `[a-z]` and `{a,b}`), hidden ones aside; or those that
    `write_profiles` wrote. Tasks list the folders and read the files, so that the driver knows of no file. Only in a store that
    pyarrow can't open it's Spark that lists them, in the driver."""
    try:
        base, parts = _parted(_absolute(spark, glob))
        _opened(base)
    except (pa.ArrowException, OSError):
        found = spark.read.option("recursiveFileLookup", "true").text(glob, wholetext=True)
        named = F.url_decode(F.replace(base_name(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B")))
        return parse_profiles(_named(found.select(named.alias("name"), F.col("value").alias("text"))))
    read = _files(spark, base, parts).repartition(_tasks(spark), "path").mapInArrow(partial(_read, base), "path string, content binary")
    return parse_profiles(_named(read.select(base_name(F.col("path")).alias("name"), F.col("content").cast("string").alias("text"))))


def _named(found: DataFrame) -> DataFrame:
    name = F.col("name")
    written = F.coalesce(F.try_url_decode(F.substring(name, len(WRITTEN) + 1, 1 << 16)), name)
    return found.select(F.when(name.startswith(WRITTEN), written).otherwise(name).alias("file"), "text").where(~F.col("file").startswith("."))


def _parted(glob: str) -> tuple[str, list[str]]:
    """The folder or file that a glob starts from, and a pattern for each name below it."""
    names = glob.rstrip("/").split("/")
    first = next((i for i, name in enumerate(names) if re.search(r"[*?\[{\\]", name)), len(names))
    return "/".join(names[:first]) or "/", [_pattern(name) for name in names[first:]]


def _pattern(name: str) -> str:
    """A name of a glob as a regular expression."""
    out, nested = "", 0
    for t in re.findall(r"\\.|\[[^\]]+\]|.", name):
        nested += (t == "{") - (t == "}")
        out += {"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(t) or (
            "|" if t == "," and nested else t.replace("[!", "[^") if len(t) > 2 else re.escape(t[-1]))
    return f"(?s)^{out}$"


def _files(spark: SparkSession, base: str, parts: list[str]) -> DataFrame:
    """path of every file, found a level of folders at a time. Only a level's being empty is told to the driver."""
    fs, root = _opened(base)
    kind = fs.get_file_info(root).type
    level = spark.createDataFrame([(root,)], "path string")
    if kind == FileType.File and not parts:
        return level
    if kind != FileType.Directory:
        raise FileNotFoundError(base)
    found = []
    while not level.isEmpty():
        listed = level.repartition(_tasks(spark)).mapInArrow(partial(_list, base), "path string, is_dir boolean")
        name, depth = base_name(F.col("path")), len(found)
        if depth < len(parts):  # a folder that is asked for may be hidden, and a file is one when all of the glob is used
            listed = listed.where(name.rlike(parts[depth]) & (F.col("is_dir") | (F.lit(depth + 1 == len(parts)) & ~name.rlike(HIDDEN))))
        else:
            listed = listed.where(~name.rlike(HIDDEN))
        listed = materialize(listed, "listed")
        if depth < len(parts) and listed.isEmpty():
            raise FileNotFoundError(f"nothing in {base} is like {parts}")
        found.append(listed.where("NOT is_dir").select("path"))
        level = listed.where("is_dir").select("path")
    return reduce(DataFrame.union, found)


def _entries(fs: FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    if isinstance(fs, LocalFileSystem):  # one by one, also in a folder of very many
        with os.scandir(folder) as found:
            yield from ((e.path, e.is_dir()) for e in found if e.is_dir() or e.is_file())  # a link may lead nowhere
    else:
        yield from ((e.path, e.type == FileType.Directory) for e in fs.get_file_info(FileSelector(folder)))


def _list(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, _ = _opened(base)
    for b in batches:
        for folder in b.column("path").to_pylist():
            for some in batched(_entries(fs, folder), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.bool_()))], ["path", "is_dir"])


BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def _read(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fs, _ = _opened(base)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    paths, contents, held = [], [], 0
    for b in batches:
        for path in b.column("path").to_pylist():
            with fs.open_input_stream(path) as file:
                content = file.read()
            paths.append(path)
            contents.append(content)
            held += len(content)
            if len(paths) == BATCH_ROWS or held > BATCH_BYTES:
                yield out()
                paths, contents, held = [], [], 0
    if paths:
        yield out()


def write_profiles(files: DataFrame, path: str) -> None:
    """(file, text) as a file per profile, as `read_profiles` takes them, in folders by hash. Tasks write them straight to the shared
    folder: Spark's own writer makes a folder and starts two processes for each. A task that is run again writes the same files."""
    path = _absolute(files.sparkSession, path)
    fs, root = _opened(path)
    if fs.get_file_info(root).type != FileType.NotFound:
        raise FileExistsError(f"{path} holds profiles already")
    fs.create_dir(root)
    rows = files.select("file", "text", F.pmod(F.xxhash64("file"), F.lit(FOLDERS)).alias("folder"))
    rows.repartition(_tasks(files.sparkSession), "folder").foreachPartition(partial(_write, path))


FOLDERS = 256


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _absolute(spark: SparkSession, path: str) -> str:
    """A path of this machine as it is, others with their store, which is Spark's own where none is told."""
    store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:/"
    if path.startswith("/") and not store.startswith("file:"):
        return store.rstrip("/") + path
    return re.sub(r"^file:(//)?(?=/)", "", path)


def _opened(path: str) -> tuple[FileSystem, str]:
    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


def _write(path: str, rows: Iterator[Row]) -> None:
    fs, root = _opened(path)
    made = set()
    for r in rows:
        folder = f"{root}/{r.folder}"
        if folder not in made:
            fs.create_dir(folder)
            made.add(folder)
        with fs.open_output_stream(f"{folder}/{WRITTEN}{quote(r.file, safe='')}") as out:
            out.write((r.text or "").encode())


def _three(name: str, keys: Column) -> Column:
    value = F.col(f"_p.{name}")
    fine = (F.size(value) == 3) & F.forall(value, lambda v: F.coalesce(is_finite(v) & (v > 0), F.lit(False)))
    return (F.when(~F.array_contains(keys, name), f"no {name} given")
            .when(~F.coalesce(fine, F.lit(False)), f"{name}: three numbers above zero are needed"))


def parse_profiles(files: DataFrame) -> DataFrame:
    """(file, text) -> profile columns, with `problem` saying what is wrong with a damaged one. Every
    file gives a row."""
    # a bare NaN or Infinity is read as a number and refused as one; the structure checks know no such token
    plain = F.regexp_replace("text", r"(?<=[\[,:\s])(-?Infinity|NaN)(?=\s*[,\]}])", "-1")
    rows = files.select("file", plain.alias("_plain"), F.from_json("text", PROFILE).alias("_p"), F.json_object_keys(plain).alias("_keys"))
    invalid = F.try_parse_json("_plain").isNull()
    problem = F.coalesce(
        F.when(invalid, "unreadable: not JSON"),
        F.when(F.col("_keys").isNull(), "unreadable: JSON, but no object"),
        _three("white_balance", F.col("_keys")), _three("density_scale", F.col("_keys")))
    fine = problem.isNull()

    def vector(name: str) -> Column:
        v = F.col(f"_p.{name}")
        return F.when(fine, F.struct(*[F.get(v, F.lit(i)).alias(c) for i, c in enumerate(("r", "g", "b"))])).alias(name)

    texts = [F.when(fine, F.col(f"_p.{c}")).alias(c) for c in ("film_stock", "process", "scanner", "notes")]
    return rows.select(
        stem(F.col("file")).alias("file"), F.when(fine, F.col("_p.name")).alias("name"),
        vector("white_balance"), vector("density_scale"), *texts,
        F.when(fine, F.try_to_timestamp("_p.created_at")).alias("created_at"),
        F.when(fine, F.when(F.array_contains("_keys", "source"), F.col("_p.source")).otherwise("manual")).alias("source"),
        *[F.when(fine, F.col(f"_p.{c}")).alias(c) for c in SIDECARS], problem.alias("problem"))


def tone_overrides(profiles: DataFrame) -> DataFrame:
    """The exposure and grade a profile suggests, where it has any; `tone_problem` where they're unusable."""
    exposure, contrast = F.col("tone.exposure"), F.col("tone.contrast")
    numbers = F.coalesce(is_finite(exposure) & is_finite(contrast), F.lit(False))
    problem = F.when(~numbers, "tone without finite numbers for exposure and contrast").when(
        ~((contrast > 0) & (contrast <= 2)), "tone with a contrast outside (0, 2]")
    return profiles.where(F.col("tone").isNotNull()).select(
        "file", F.when(problem.isNull(), exposure).alias("exposure"), F.when(problem.isNull(), contrast).alias("contrast"),
        problem.alias("tone_problem"))


def scan_references(profiles: DataFrame) -> DataFrame:
    """The scan exposure a profile was made at, where recorded."""
    whole = F.col("scan.exposure_time").isNotNull() & F.col("scan.f_number").isNotNull() & F.col("scan.iso").isNotNull()
    return profiles.where(F.col("scan").isNotNull()).select(
        "file", *[F.when(whole, F.col(f"scan.{k}")).alias(c) for k, c in (("exposure_time", "t"), ("f_number", "f"), ("iso", "iso"))],
        F.when(~whole, "scan settings that are incomplete").alias("scan_problem"))


def profile_points(profiles: DataFrame) -> DataFrame:
    """One row per stored neutral point; a profile without any keeps one row of NULLs."""
    rows = profiles.select("file", F.posexplode_outer("anchors").alias("i", "_a"))
    return rows.select(
        "file", "i", F.col("_a.frame").alias("frame"), F.col("_a.x").alias("x"), F.col("_a.y").alias("y"),
        *[F.get("_a.rgb", F.lit(k)).alias(c) for k, c in enumerate(("r", "g", "b"))],
        F.col("_a.scan.exposure_time").alias("t"), F.col("_a.scan.f_number").alias("f"), F.col("_a.scan.iso").alias("iso"))


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def apply_changes(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """The profile table after a set of changes, at most one per name (compared without case).

    `changes`: name, action (save / rename / edit / delete), new_name, overwrite, fields MAP<STRING,
    STRING> and the profile body. Saving replaces an existing profile only with `overwrite` and keeps
    its file; renaming and editing keep the sidecars. Each row tells its `outcome`; a change that can't be
    made is "refused" with a `problem`, and leaves its profile as it was."""
    old = profiles.select(_key(F.col("file")).alias("key"), F.struct("file", "name", *BODY).alias("_old"))
    new = changes.select(_key(F.col("name")).alias("key"), F.struct(*changes.columns).alias("_new"))
    rows = old.join(new, "key", "full_outer")
    act, there = F.col("_new.action"), F.col("_old").isNotNull()
    target = F.when(act == "rename", _key(F.col("_new.new_name"))).when(act == "save", F.col("key"))

    # a rename needs its new name free: not held by another profile and not claimed twice. Only renames are joined, since
    # all other rows would meet at one NULL target
    rows = rows.withColumn("target", target)
    claims = rows.where(act == "rename").groupBy("target").agg(F.count(F.lit(1)).alias("claims"))
    held = rows.where(there | (act == "save")).select(F.col("key").alias("target"), F.lit(True).alias("held")).distinct()
    moving = F.coalesce((act == "rename") & F.col("target").isNotNull(), F.lit(False))
    moved = rows.where(moving).join(claims, "target", "left").join(held, "target", "left")
    rows = moved.unionByName(rows.where(~moving), allowMissingColumns=True)
    self_rename = F.col("target") == F.col("key")
    unknown = F.array_except(F.map_keys("_new.fields"), F.array(*[F.lit(f) for f in EDITABLE_FIELDS]))
    problem = (
        F.when(act.isNull(), F.lit(None).cast("string"))
        .when((act == "save") & there & ~F.coalesce(F.col("_new.overwrite"), F.lit(False)), "refused: the name is taken")
        .when((act != "save") & ~there, "refused: no such profile")
        .when((act == "rename") & ~self_rename & (F.coalesce("held", F.lit(False)) | (F.col("claims") > 1)),
              "refused: the new name is taken")
        .when((act == "edit") & (F.size(unknown) > 0), F.concat(F.lit("refused, not editable: "), F.array_join(F.array_sort(unknown), ", "))))
    done = problem.isNull() & act.isNotNull()
    saved, edited, renamed = done & (act == "save"), done & (act == "edit"), done & (act == "rename")

    def body(c: str) -> Column:
        value = F.when(saved, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        if c in EDITABLE_FIELDS:
            value = F.when(edited & F.map_contains_key("_new.fields", F.lit(c)), F.try_element_at("_new.fields", F.lit(c))).otherwise(value)
        return value.alias(c)

    return rows.select(
        F.when(renamed, F.trim("_new.new_name")).otherwise(F.coalesce("_old.file", F.trim("_new.name"))).alias("file"),
        F.when(renamed, F.trim("_new.new_name")).when(saved, F.trim("_new.name")).otherwise(F.col("_old.name")).alias("name"),
        *[body(c) for c in BODY],
        F.when(act.isNull(), "kept").when(~done, "refused").when(saved & there, "replaced").when(saved, "saved")
        .when(renamed, "renamed").when(edited, "edited").otherwise("deleted").alias("outcome"), problem.alias("problem"),
        there.alias("existed"))


def snapshot(applied: DataFrame) -> DataFrame:
    """The table to write back: everything that still exists."""
    gone = (F.col("outcome") == "deleted") | ((F.col("outcome") == "refused") & ~F.col("existed"))
    return applied.where(~gone).select("file", "name", *BODY)


STORED = ("file string, name string, white_balance struct<r:double,g:double,b:double>, density_scale struct<r:double,g:double,b:double>, film_stock string, "
          "process string, scanner string, created_at timestamp, source string, notes string, tone struct<exposure:double,contrast:double>, "
          f"scan {SCAN}, anchors array<{ANCHOR}>")
_WHOLE = "_store"


def stored_profiles(spark: SparkSession, path: str, version: Head | None = None) -> DataFrame:
    return Versions(spark, path).read("profiles", STORED, version)


def save_profiles(profiles: DataFrame, path: str, expected: Head | None = None) -> Head:
    """The whole profile table as the next version of the store at `path`. `expected`: the version it was made from (the newest, if
    not given); a writer that another has overtaken is refused."""
    held = Versions(profiles.sparkSession, path)
    staged = held.stage(profiles.select("file", "name", *BODY).withColumn(_WHOLE, F.lit("all")), "profiles", _WHOLE, also=("all",))
    return held.commit([staged], expected or held.head())


def upsert_profiles(spark: SparkSession, path: str, changes: DataFrame) -> tuple[DataFrame, Head]:
    """Apply changes to the store and write its next version: what became of each profile and change, and that version."""
    head = Versions(spark, path).head()
    applied = materialize(apply_changes(stored_profiles(spark, path, head), changes), "applied")
    return applied, save_profiles(snapshot(applied), path, head)
