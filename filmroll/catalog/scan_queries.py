"""How rolls were digitised."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import META_SQL, exif, frame_meta, table, with_sql
from filmroll.functions.scan import describe_scan, hex_float, hex_int, relative_exposure, stops
from filmroll.operators import scans
from filmroll.operators.ordering import listed_names
from filmroll.operators.points import reference_scan
from filmroll.sources.scans import edit_history, edit_state, history_state, scan_settings

M = with_sql(META_SQL)


@query("src_exif", M + "SELECT roll_id, frame_id, name, orders, round(t, 9) AS t, f, iso FROM frame_meta")
def src_exif(spark, sf):
    return rounded(scan_settings(exif(spark, sf)).drop("exif"), 9)


@query("agg_reference_scan", M + "SELECT roll_id, round(t, 9) AS t, f, iso, round(ref_exposure, 9) AS ref_exposure, frames FROM reference")
def agg_reference_scan(spark, sf):
    return rounded(reference_scan(frame_meta(spark, sf)), 9)


@query("join_scan_match", M + "SELECT roll_id, frame_id, round(gain, 6) AS gain, abs(gain - 1) > 1e-9 AS adjusted, missing_exif FROM gains")
def join_scan_match(spark, sf):
    meta = frame_meta(spark, sf)
    return rounded(scans.scan_match(meta, reference_scan(meta)))


@query("join_reference_choice", M + """
SELECT r.roll_id, round(CASE WHEN r.roll_id % 4 = 3 THEN 0.05e0 WHEN r.roll_id % 2 = 1 THEN 0.04e0 ELSE ref_exposure END, 6) AS ref_exposure,
  CASE WHEN r.roll_id % 4 = 3 THEN 'explicit' WHEN r.roll_id % 2 = 1 THEN 'profile' WHEN ref_exposure IS NOT NULL THEN 'common' END AS origin
FROM (SELECT DISTINCT roll_id FROM frame_meta) r LEFT JOIN reference c ON r.roll_id = c.roll_id""")
def join_reference_choice(spark, sf):
    meta = frame_meta(spark, sf)
    rolls = meta.select("roll_id").distinct()
    explicit = rolls.where("roll_id % 4 = 3").withColumn("ref_exposure", F.lit(0.05))
    recorded = rolls.where("roll_id % 2 = 1").withColumn("ref_exposure", F.lit(0.04))
    return rounded(scans.choose_reference(rolls, explicit, recorded, reference_scan(meta)))


WB_SQL = """, w AS (SELECT *, CASE WHEN wb_kind = 'multipliers' THEN concat(printf('%.4f', wb1), ' ', printf('%.4f', wb2), ' ', printf('%.4f', wb3)) ELSE wb_kind END AS wb_group,
  CASE WHEN wb_kind = 'multipliers' THEN wb1 END AS m1, CASE WHEN wb_kind = 'multipliers' THEN wb2 END AS m2, CASE WHEN wb_kind = 'multipliers' THEN wb3 END AS m3 FROM lit),
report AS (
  SELECT roll_id, count(*) AS frames, count(DISTINCT CASE WHEN t IS NOT NULL THEN setting END) AS exposure_groups,
    coalesce(abs(log2(max(rel) / min(rel))), 0e0) AS spread_stops, count(DISTINCT wb_group) AS wb_groups, coalesce(max(m1) / min(m1) - 1, 0e0) AS wb_spread_r,
    coalesce(max(m2) / min(m2) - 1, 0e0) AS wb_spread_g, coalesce(max(m3) / min(m3) - 1, 0e0) AS wb_spread_b, count_if(tonal) AS tonal_frames,
    count_if(t IS NULL) AS missing_exif, count_if(wb_kind LIKE 'camera%') AS named FROM w GROUP BY roll_id),
verdict AS (SELECT *, spread_stops > 0.05 AS exposure_inconsistent, (named > 0 AND wb_groups > 1) OR greatest(wb_spread_r, wb_spread_g, wb_spread_b) > 0.005 AS wb_inconsistent, tonal_frames > 0 AS tone_modules_on FROM report)
"""


@query("agg_scan_report", M + WB_SQL + "SELECT roll_id, frames, exposure_groups, round(spread_stops, 6) AS spread_stops, wb_groups, round(wb_spread_r, 6) AS wb_spread_r, round(wb_spread_g, 6) AS wb_spread_g, round(wb_spread_b, 6) AS wb_spread_b, tonal_frames, missing_exif, exposure_inconsistent, wb_inconsistent, tone_modules_on FROM verdict")
def agg_scan_report(spark, sf):
    return rounded(scans.scan_report(frame_meta(spark, sf)))


MAIN_SQL = """, eg AS (SELECT roll_id, setting, count(*) AS n, min(name) AS first_name FROM w WHERE t IS NOT NULL GROUP BY roll_id, setting),
wg AS (SELECT roll_id, wb_group, count(*) AS n, min(name) AS first_name FROM w WHERE wb_group IS NOT NULL GROUP BY roll_id, wb_group),
em AS (SELECT roll_id, setting AS main FROM (SELECT *, row_number() OVER (PARTITION BY roll_id ORDER BY n DESC, first_name) AS k FROM eg) WHERE k = 1),
wm AS (SELECT roll_id, wb_group AS main FROM (SELECT *, row_number() OVER (PARTITION BY roll_id ORDER BY n DESC, first_name) AS k FROM wg) WHERE k = 1)
"""


@query("win_main_group", M + WB_SQL + MAIN_SQL + "SELECT e.roll_id, e.main AS main_exposure_group, m.main AS main_wb_group FROM em e JOIN wm m ON e.roll_id = m.roll_id")
def win_main_group(spark, sf):
    meta = frame_meta(spark, sf)
    return scans.main_groups(meta, "exposure_group").join(scans.main_groups(meta, "wb_group"), "roll_id")


@query("win_frame_flags", M + WB_SQL + MAIN_SQL + """, flagged AS (
  SELECT w.roll_id, w.frame_id, w.name, concat_ws('; ',
    CASE WHEN exposure_inconsistent AND t IS NOT NULL AND setting <> em.main THEN concat('digitized at ', setting, ', most of the roll at ', em.main) END,
    CASE WHEN wb_inconsistent AND wb_group <> wm.main THEN 'exported with a different raw white balance from most of the roll' END,
    CASE WHEN tonal THEN 'tone/colour modules active in the raw editor (exposure, sigmoid)' END,
    CASE WHEN t IS NULL AND missing_exif < frames THEN 'no camera EXIF, so it can''t be checked against the others' END) AS flags
  FROM w JOIN verdict v ON w.roll_id = v.roll_id LEFT JOIN em ON w.roll_id = em.roll_id LEFT JOIN wm ON w.roll_id = wm.roll_id)
SELECT * FROM flagged WHERE flags <> ''""")
def win_frame_flags(spark, sf):
    return scans.frame_flags(frame_meta(spark, sf))


@query("top_group", M + WB_SQL + MAIN_SQL + "SELECT roll_id, setting AS exposure_group, n AS frames, first_name FROM eg")
def top_group(spark, sf):
    """Exposure groups, the largest first."""
    return scans.setting_groups(frame_meta(spark, sf), "exposure_group").orderBy("roll_id", F.desc("frames"), "first_name")


@query("limit_names", M + WB_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY roll_id, setting ORDER BY name) AS k, count(*) OVER (PARTITION BY roll_id, setting) AS n FROM w WHERE t IS NOT NULL)
SELECT roll_id, setting AS exposure_group, max(n) AS "count", concat(string_agg(name, ', ' ORDER BY k) FILTER (WHERE k <= 6), CASE WHEN max(n) > 6 THEN concat(', … (+', max(n) - 6, ' more)') ELSE '' END) AS names
FROM k GROUP BY roll_id, setting""")
def limit_names(spark, sf):
    """The first six frames of every exposure group, and how many more."""
    from filmroll.constants import MAX_CHECK_NAMES

    meta = frame_meta(spark, sf).where(F.col("t").isNotNull()).withColumn(
        "exposure_group", describe_scan(F.col("t"), F.col("f"), F.col("iso"))).withColumn("_name", F.col("name"))
    return listed_names(meta, ["roll_id", "exposure_group"], "name", ["_name"], MAX_CHECK_NAMES, ", … (+%d more)")


@query("fn_relative_exposure", M + "SELECT roll_id, frame_id, round(rel, 9) AS rel FROM lit")
def fn_relative_exposure(spark, sf):
    meta = frame_meta(spark, sf)
    return rounded(meta.select("roll_id", "frame_id", relative_exposure(F.col("t"), F.col("f"), F.col("iso")).alias("rel")), 9)


@query("fn_stops", "SELECT l_orderkey, l_linenumber, l_extendedprice, round(abs(log2(l_extendedprice / 1000e0 / l_quantity)), 6) AS stops FROM lineitem")
def fn_stops(spark, sf):
    """Stops between each item's price and its quantity in thousands."""
    return rounded(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", stops(F.col("l_extendedprice") / 1000.0, F.col("l_quantity")).alias("stops")))


@query("fn_describe_scan", "SELECT s_suppkey, s, concat(CASE WHEN t < 1 THEN concat('1/', CAST(round_even(1e0 / t, 0) AS BIGINT)) ELSE concat(printf('%g', t), 's') END, ' f/', printf('%g', f), ' ISO', printf('%g', iso)) AS setting "
       "FROM (SELECT s_suppkey, s, (s_suppkey % 90 + 1) / (s * 10e0) AS t, (s_suppkey % 23 + 10) / 10e0 AS f, CASE WHEN s = 7 THEN 1600000e0 ELSE 100e0 * s END AS iso FROM supplier, range(1, 9) r(s))")
def fn_describe_scan(spark, sf):
    """Every supplier's eight settings in words."""
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint"))).alias("s"))
    t = (F.col("s_suppkey") % 90 + 1) / (F.col("s") * 10.0)
    f = (F.col("s_suppkey") % 23 + 10) / 10.0
    iso = F.when(F.col("s") == 7, 1600000.0).otherwise(F.col("s") * 100.0)
    return rows.select("s_suppkey", "s", describe_scan(t, f, iso).alias("setting"))


# --- edit histories ---------------------------------------------------------------------------

FLOATS = {0: ("00000040", 2.0), 1: ("0000c03f", 1.5), 2: ("0000a03f", 1.25), 3: ("9a99d93f", 1.7000000476837158)}
MODULES = {"view": "exposure", "signup": "filmicrgb", "error": "denoiseprofile", "click": "crop", "purchase": "colorbalancergb"}


def documents(spark, sf):
    """An edit history per event, as XMP text; some without an end mark."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").select("event_id", "event_type", k.alias("k"))
    op = F.get(F.from_json(F.lit("[]"), "array<string>"), F.lit(0))
    for kind, module in MODULES.items():
        op = F.when(F.col("event_type") == kind, module).otherwise(op)
    number = F.get(F.array(*[F.lit(h) for h, _ in FLOATS.values()]), F.col("k") % 4)
    preset = F.when(F.col("k") % 3 == 0, "04000000").otherwise("00000000")

    def item(num, operation, enabled, params, version, instance):
        text = [F.lit(f'\n <rdf:li darktable:num="{num}" darktable:operation="'), operation, F.lit('" darktable:enabled="'), enabled,
                F.lit('" darktable:modversion="'), version, F.lit('" darktable:params="'), params]
        text += [F.lit('" darktable:multi_priority="'), instance] if instance is not None else []
        return F.concat(*text, F.lit('"/>'))

    one, zero = F.lit("1"), F.lit("0")
    items = [item(0, F.lit("rawprepare"), one, F.lit("00"), one, zero),
             item(1, F.lit("temperature"), one, F.concat(number, F.lit("0000803f0000c03f00000000"), preset), F.lit("4"), zero),
             item(2, op, (F.col("event_id") % 2).cast("string"), F.lit("gz02"), one, None),
             item(3, op, (F.col("k") % 2).cast("string"), F.lit("gz03"), one, F.when(F.col("k") % 3 == 0, "0").otherwise("1")),
             item(4, F.lit("temperature"), F.when(F.col("k") % 5 == 0, "0").otherwise("1"), F.concat(number, F.lit("0000803f0000a03f")), F.lit("3"), zero),
             item(5, F.lit("sigmoid"), one, F.lit("gz05"), one, zero)]
    end = F.when(F.col("k") % 20 == 7, "").otherwise(F.concat(F.lit(' darktable:history_end="'), (F.col("k") % 5 + 2).cast("string"), F.lit('"')))
    xmp = F.concat(F.lit("<rdf:Description"), end, F.lit(">\n<darktable:history><rdf:Seq>"), *items, F.lit("\n</rdf:Seq></darktable:history></rdf:Description>"))
    return rows.select(F.col("event_id").alias("frame_id"), xmp.alias("xmp"))


HISTORY_SQL = """
WITH ev AS (SELECT event_id AS frame_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE event_type WHEN 'view' THEN 'exposure' WHEN 'signup' THEN 'filmicrgb' WHEN 'error' THEN 'denoiseprofile' WHEN 'click' THEN 'crop' ELSE 'colorbalancergb' END AS op FROM events),
h AS (SELECT frame_id, k, op, ['00000040', '0000c03f', '0000a03f', '9a99d93f'][k % 4 + 1] AS num FROM ev WHERE k % 20 <> 7),
entries AS (
  SELECT frame_id, 0 AS pos, 'rawprepare' AS op, '0' AS instance, '1' AS enabled, '00' AS params, '1' AS modversion, k FROM h
  UNION ALL SELECT frame_id, 1, 'temperature', '0', '1', concat(num, '0000803f0000c03f00000000', CASE WHEN k % 3 = 0 THEN '04000000' ELSE '00000000' END), '4', k FROM h
  UNION ALL SELECT frame_id, 2, op, '0', CAST(frame_id % 2 AS VARCHAR), 'gz02', '1', k FROM h
  UNION ALL SELECT frame_id, 3, op, CASE WHEN k % 3 = 0 THEN '0' ELSE '1' END, CAST(k % 2 AS VARCHAR), 'gz03', '1', k FROM h
  UNION ALL SELECT frame_id, 4, 'temperature', '0', CASE WHEN k % 5 = 0 THEN '0' ELSE '1' END, concat(num, '0000803f0000a03f'), '3', k FROM h
  UNION ALL SELECT frame_id, 5, 'sigmoid', '0', '1', 'gz05', '1', k FROM h),
history AS (SELECT * EXCLUDE (k) FROM entries WHERE pos < k % 5 + 2),
final AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY frame_id, op, instance ORDER BY pos DESC) = 1)
"""


@query("src_xmp_history", HISTORY_SQL + "SELECT frame_id, pos, op, instance, enabled, params, modversion FROM history")
def src_xmp_history(spark, sf):
    return edit_history(documents(spark, sf))


@query("src_xmp_state", HISTORY_SQL + """, tone AS (
  SELECT frame_id, list_sort(list_distinct(list(op))) AS mods FROM final WHERE enabled = '1' AND op IN ('exposure', 'filmicrgb', 'colorbalancergb', 'sigmoid') GROUP BY frame_id),
bal AS (SELECT f.frame_id, params, modversion, k FROM final f JOIN ev ON f.frame_id = ev.frame_id WHERE f.op = 'temperature' AND enabled = '1')
SELECT e.frame_id, CASE WHEN e.k % 20 = 7 THEN NULL ELSE array_to_string(coalesce(mods, []), ',') END AS tonal_modules,
  CASE WHEN b.frame_id IS NULL THEN NULL WHEN modversion = '4' AND b.k % 3 = 0 THEN 'camera reference (D65)' ELSE 'multipliers' END AS wb_kind,
  CASE WHEN b.frame_id IS NOT NULL AND NOT (modversion = '4' AND b.k % 3 = 0) THEN round([2e0, 1.5e0, 1.25e0, 1.7000000476837158e0][b.k % 4 + 1], 9) END AS wb_r,
  CASE WHEN b.frame_id IS NOT NULL AND NOT (modversion = '4' AND b.k % 3 = 0) THEN CASE WHEN modversion = '4' THEN 1.5e0 ELSE 1.25e0 END END AS wb_b
FROM ev e LEFT JOIN tone t ON e.frame_id = t.frame_id LEFT JOIN bal b ON e.frame_id = b.frame_id""")
def src_xmp_state(spark, sf):
    state = edit_state(documents(spark, sf))
    return rounded(state.select(
        "frame_id", F.array_join("tonal_modules", ",").alias("tonal_modules"), "wb_kind",
        F.get("wb", F.lit(0)).alias("wb_r"), F.get("wb", F.lit(2)).alias("wb_b")), 9)


@query("set_tonal_modules", HISTORY_SQL + "SELECT frame_id, op FROM final WHERE enabled = '1' AND op IN ('exposure', 'filmicrgb', 'colorbalancergb', 'sigmoid') GROUP BY ALL")
def set_tonal_modules(spark, sf):
    """Enabled modules that reshape tone, one row each."""
    return edit_state(documents(spark, sf)).select("frame_id", F.explode_outer("tonal_modules").alias("op")).where(F.col("op").isNotNull())


@query("win_history_state", """
SELECT user_id, event_type AS op, CAST(event_id % 3 AS VARCHAR) AS instance, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY ts DESC, event_id DESC) = 1""")
def win_history_state(spark, sf):
    """The last entry per user, kind and instance of an event history kept as a table."""
    rows = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("op"), (F.col("event_id") % 3).cast("string").alias("instance"), "ts", "event_id", "value")
    return history_state(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("fn_hex_float", "SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS value, CAST(o_custkey AS BIGINT) - 700 AS number FROM orders")
def fn_hex_float(spark, sf):
    """Prices and keys written as little-endian hex and read back."""
    def little_endian(big):
        return F.concat(*[F.substring(big, at, 2) for at in (7, 5, 3, 1)])

    price = F.col("o_totalprice").cast("float").cast("double")
    exponent = F.floor(F.log2(price)).cast("bigint")
    bits = (exponent + 127) * (2 ** 23) + (price / F.pow(F.lit(2.0), exponent.cast("double")) * 2 ** 23 - 2 ** 23).cast("bigint")
    key = F.col("o_custkey") - 700
    rows = table(spark, sf, "orders").select(
        "o_orderkey", little_endian(F.lpad(F.lower(F.hex(bits)), 8, "0")).alias("f"),
        little_endian(F.lower(F.lpad(F.hex(F.when(key < 0, key + 2 ** 32).otherwise(key)), 8, "0"))).alias("i"))
    return rows.select("o_orderkey", hex_float(F.col("f"), 1).alias("value"), hex_int(F.col("i"), 1).alias("number"))
