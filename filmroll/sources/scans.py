"""Camera settings from EXIF maps and processing state from raw-editor histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import (
    CAMERA_REFERENCE, CAMERA_REFERENCE_PRESET, CAMERA_REFERENCE_VERSION, NON_TONAL_MODULES)
from filmroll.functions.scan import hex_float, hex_int
from filmroll.functions.text import let

ENTRY_FIELDS = {"op": "operation", "instance": "multi_priority", "enabled": "enabled",
                "params": "params", "modversion": "modversion"}


def scan_settings(meta: DataFrame, exif: str = "exif") -> DataFrame:
    """Adds t, f, iso from a MAP<STRING, STRUCT<num, den>> (den NULL for a plain number); all three are
    NULL unless every one is present and not zero."""
    def number(name: str) -> Column:
        value = F.try_element_at(exif, F.lit(name))
        return F.when(value["den"].isNull(), value["num"].cast("double")).when(
            value["den"] != 0, value["num"] / F.when(value["den"] != 0, value["den"]))

    iso = F.coalesce(*[F.try_element_at(exif, F.lit(k))["num"] for k in ("ISOSpeedRatings", "PhotographicSensitivity")]).cast("double")
    read = F.struct(number("ExposureTime").alias("t"), number("FNumber").alias("f"), iso.alias("iso"))
    whole = let(read, lambda s: F.when((s["t"] != 0) & (s["f"] != 0) & (s["iso"] != 0), s))
    return meta.withColumn("_s", whole).select("*", "_s.t", "_s.f", "_s.iso").drop("_s")


def _entries(xmp: Column, prefix: str) -> Column:
    """The history's entries up to its end mark, as an array; NULL without a history or an end mark."""
    end = F.regexp_extract_all(xmp, F.lit(rf'{prefix}:history_end="(\d+)"'), F.lit(1))
    body = F.regexp_extract_all(xmp, F.lit(rf"(?s)<{prefix}:history>(.*?)</{prefix}:history>"), F.lit(1))
    items = F.regexp_extract_all(F.get(body, F.lit(0)), F.lit(r"(?s)<rdf:li(.*?)/>"), F.lit(1))

    def attribute(item: Column, name: str) -> Column:
        found = F.regexp_extract(item, rf'{prefix}:{name}="([^"]*)"', 1)
        return F.nullif(found, F.lit(""))

    read = F.transform(items, lambda item, pos: F.struct(
        pos.alias("pos"), *[attribute(item, a).alias(k) for k, a in ENTRY_FIELDS.items()]))
    kept = F.filter(read, lambda e: (e["pos"] < F.get(end, F.lit(0)).cast("int")) & e["op"].isNotNull())
    filled = F.transform(kept, lambda e: e.withField("instance", F.coalesce(e["instance"], F.lit("0"))))
    return F.when((F.size(end) > 0) & (F.size(body) > 0), filled)


def edit_history(meta: DataFrame, xmp: str = "xmp", prefix: str = "darktable") -> DataFrame:
    """One row per history entry that counts, in order."""
    keep = [c for c in meta.columns if c != xmp]
    # outer, then filtered: a plain explode would have the history parsed once more to skip empty ones
    rows = meta.select(*keep, F.explode_outer(_entries(F.col(xmp), prefix)).alias("_e")).where(F.col("_e").isNotNull())
    return rows.select(*keep, "_e.pos", *[F.col(f"_e.{k}").alias(k) for k in ENTRY_FIELDS])


def history_state(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last entry of every module instance; a maximum, so it combines before the shuffle."""
    rest = [c for c in history.columns if c not in (*keys, "op", "instance", *order)]
    last = history.groupBy(*keys, "op", "instance").agg(
        F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, "op", "instance", *[F.col(f"_last.{c}").alias(c) for c in (*order, *rest)])


def edit_state(meta: DataFrame, xmp: str = "xmp", prefix: str = "darktable") -> DataFrame:
    """Adds wb_kind, wb and tonal_modules: the state each history ends in. The history sits in one row,
    so it is folded there without a shuffle: sorted by module and place, each module's last entry has no other of it behind."""
    first = ("op", "instance", "pos")
    turned = F.transform(_entries(F.col(xmp), prefix), lambda e: F.struct(*[e[k].alias(k) for k in (*first, *[k for k in ENTRY_FIELDS if k not in first])]))
    rows = meta.withColumn("_h", F.array_sort(turned))

    def last(e: Column, i: Column) -> Column:
        after = F.get("_h", i + 1)
        return after.isNull() | (after["op"] != e["op"]) | (after["instance"] != e["instance"])

    rows = rows.withColumn("_final", F.filter("_h", last))
    on = F.filter("_final", lambda e: F.coalesce(e["enabled"] == "1", F.lit(False)))
    tonal = F.array_sort(F.array_distinct(F.array_except(
        F.transform(on, lambda e: e["op"]), F.array(*[F.lit(m) for m in NON_TONAL_MODULES]))))
    balance = F.get(F.filter(on, lambda e: (e["op"] == "temperature") & (e["instance"] == "0")), F.lit(0))
    rows = rows.withColumns({"tonal_modules": tonal, "_p": balance["params"], "_v": balance["modversion"]})
    readable = F.col("_p").rlike("^([0-9a-f]{2}){12,}$")
    by_name = (F.col("_v") == CAMERA_REFERENCE_VERSION) & (F.length("_p") >= 40) & (
        hex_int(F.col("_p"), 33) == CAMERA_REFERENCE_PRESET)
    by_name = F.coalesce(by_name, F.lit(False))
    return rows.withColumns({
        "wb_kind": F.when(readable, F.when(by_name, CAMERA_REFERENCE).otherwise("multipliers")),
        "wb": F.when(readable & ~by_name, F.array(*[hex_float(F.col("_p"), 1 + 8 * k) for k in range(3)])),
    }).drop("_h", "_final", "_p", "_v")
