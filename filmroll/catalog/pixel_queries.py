"""Per-pixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import (
    META_SQL, PIXEL_SQL, PROFILE, curve, exif, frame_meta, pixels, positives, samples, scanned, table, with_sql)
from filmroll.functions.colour import rec2020_to_pcs, source_to_working, working_to_srgb
from filmroll.functions.pixel import RGB, map_rgb
from filmroll.operators import pixels as px
from filmroll.operators.points import reference_scan
from filmroll.operators.scans import scan_match
from filmroll.plans.develop import frame_tones
from filmroll.session import materialize, shared_path
from filmroll.sources.pixels import read_pixels

P = with_sql(PIXEL_SQL)
PM = with_sql(PIXEL_SQL, META_SQL)
AT = ["roll_id", "frame_id", "y", "x"]
REC2020 = source_to_working(rec2020_to_pcs())


def rgb_sql(digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in RGB)


def matrix_sql(m) -> str:
    return ", ".join(f"r * {float(a)!r} + g * {float(b)!r} + b * {float(c)!r} AS {n}" for (a, b, c), n in zip(m, RGB))


@query("src_pixels", P + f"SELECT roll_id, frame_id, y, x, round(r / 4294967295e0, 9) AS r, round(g / 4294967295e0, 9) AS g, round(b / 4294967295e0, 9) AS b FROM samples")
def src_pixels(spark, sf):
    """Raw samples, written and read back."""
    path = shared_path(spark, "samples")
    samples(spark, sf).write.parquet(path)
    return rounded(read_pixels(spark, path, "uint32"), 9)


@query("px_working_space", P + f"SELECT roll_id, frame_id, y, x, {rgb_sql()} FROM (SELECT roll_id, frame_id, y, x, {matrix_sql(REC2020)} FROM pixels)")
def px_working_space(spark, sf):
    return rounded(px.to_working(pixels(spark, sf), REC2020))


@query("px_working_space_by_source", P + f""", src AS (
  SELECT *, CASE WHEN roll_id % 2 = 0 THEN 'rec2020' ELSE 'working' END AS source FROM pixels)
SELECT roll_id, frame_id, y, x, source, {rgb_sql()} FROM (
  SELECT roll_id, frame_id, y, x, source, {matrix_sql(REC2020)} FROM src WHERE source = 'rec2020'
  UNION ALL SELECT roll_id, frame_id, y, x, source, r, g, b FROM src WHERE source <> 'rec2020')""")
def px_working_space_by_source(spark, sf):
    flat = [float(v) for v in REC2020.reshape(-1)]
    rows = pixels(spark, sf).withColumn("source", F.when(F.col("roll_id") % 2 == 0, "rec2020").otherwise("working"))
    matrices = spark.createDataFrame([("rec2020", flat)], "source string, m array<double>")
    return rounded(px.to_working(rows, matrices=matrices).select(*AT, "source", *RGB))


@query("px_clean", P + f"SELECT roll_id, frame_id, y, x, isnan(r) AS bad, round(CASE WHEN isnan(r) THEN 0e0 ELSE r END, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM scanned")
def px_clean(spark, sf):
    return rounded(px.clean_nonfinite(scanned(spark, sf)))


@query("px_clean_after_matrix", P + f""", mixed AS (SELECT roll_id, frame_id, y, x, {matrix_sql(REC2020)} FROM scanned)
SELECT roll_id, frame_id, y, x, isnan(r) AS bad, {", ".join(f"round(CASE WHEN isnan({c}) THEN 0e0 ELSE {c} END, 6) AS {c}" for c in RGB)} FROM mixed""")
def px_clean_after_matrix(spark, sf):
    """One bad channel spreads over the matrix: the whole pixel becomes 0."""
    return rounded(px.clean_nonfinite(px.to_working(scanned(spark, sf), REC2020)))


NONFINITE = """
SELECT roll_id, frame_id, bad_pixels, round(share, 9) AS share, share > 0.01 AS failed,
  CASE WHEN share > 0.01 THEN concat(printf('%.1f', share * 100), '% of its pixels aren''t valid numbers')
       WHEN bad_pixels = 1 THEN '1 pixel wasn''t a valid number and was treated as clear film'
       WHEN bad_pixels > 1 THEN concat(bad_pixels, ' pixels weren''t valid numbers and were treated as clear film') END AS message
FROM (SELECT roll_id, frame_id, count_if(isnan(r)) AS bad_pixels, avg(CASE WHEN isnan(r) THEN 1e0 ELSE 0e0 END) AS share FROM {src} GROUP BY roll_id, frame_id)"""


@query("agg_nonfinite", P + NONFINITE.format(src="scanned"))
def agg_nonfinite(spark, sf):
    return rounded(px.nonfinite_report(px.clean_nonfinite(scanned(spark, sf))), 9)


@query("agg_nonfinite_broken", P + NONFINITE.format(src="(SELECT roll_id, frame_id, CASE WHEN x = 3 OR isnan(r) THEN CAST('nan' AS DOUBLE) ELSE r END AS r FROM scanned)"))
def agg_nonfinite_broken(spark, sf):
    """A broken export: a whole column of every frame is not a number, so every frame fails."""
    broken = scanned(spark, sf).withColumn("r", F.when(F.col("x") == 3, F.lit(float("nan"))).otherwise(F.col("r")))
    return rounded(px.nonfinite_report(px.clean_nonfinite(broken)), 9)


def _gains(spark, sf):
    meta = frame_meta(spark, sf)
    return scan_match(meta, reference_scan(meta))


@query("px_scan_gain", PM + "SELECT p.roll_id, p.frame_id, y, x, round(r * gain, 6) AS r, round(g * gain, 6) AS g, round(b * gain, 6) AS b FROM pixels p JOIN gains k ON p.roll_id = k.roll_id AND p.frame_id = k.frame_id")
def px_scan_gain(spark, sf):
    return rounded(px.apply_gain(pixels(spark, sf), _gains(spark, sf)).select(*AT, *RGB))


def _calibrated(spark, sf):
    return px.with_profile(pixels(spark, sf), PROFILE)


@query("px_white_balance", P + "SELECT roll_id, frame_id, y, x, round(r * 0.73e0, 6) AS r, round(g, 6) AS g, round(b * 1.05e0, 6) AS b FROM pixels")
def px_white_balance(spark, sf):
    return rounded(px.white_balance(_calibrated(spark, sf)).select(*AT, *RGB))


@query("px_density_balance", P + "SELECT roll_id, frame_id, y, x, round(pow(greatest(r, 1e-7), 1.12e0), 6) AS r, round(greatest(g, 1e-7), 6) AS g, round(pow(greatest(b, 1e-7), 0.78e0), 6) AS b FROM pixels")
def px_density_balance(spark, sf):
    return rounded(px.density_balance(_calibrated(spark, sf)).select(*AT, *RGB))


@query("px_invert", P + "SELECT roll_id, frame_id, y, x, round(1e0 / greatest(r, 1e-7), 4) AS r, round(1e0 / greatest(g, 1e-7), 4) AS g, round(1e0 / greatest(b, 1e-7), 4) AS b FROM pixels")
def px_invert(spark, sf):
    return rounded(px.invert(pixels(spark, sf)), 4)


@query("px_positive", P + f"SELECT roll_id, frame_id, y, x, {rgb_sql(4)} FROM positives")
def px_positive(spark, sf):
    return rounded(px.to_positive(_calibrated(spark, sf)).select(*AT, *RGB), 4)


@query("px_stage_select", P + f"""
SELECT 'full' AS stage, roll_id, frame_id, y, x, {rgb_sql(4)} FROM positives
UNION ALL SELECT 'invert-only', roll_id, frame_id, y, x, round(1e0 / greatest(r, 1e-7), 4), round(1e0 / greatest(g, 1e-7), 4), round(1e0 / greatest(b, 1e-7), 4) FROM pixels
UNION ALL SELECT 'density-only', roll_id, frame_id, y, x, {rgb_sql(4)} FROM balanced""")
def px_stage_select(spark, sf):
    parts = [px.develop(pixels(spark, sf), stage, PROFILE).select(F.lit(stage.value).alias("stage"), *AT, *RGB) for stage in px.Stage]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)


CURVE_SQL = """
curve AS (
  SELECT list(v / top ORDER BY i) AS c FROM (
    SELECT i, pow(10e0, -(2.1e0 / (1e0 + exp(4e0 * (3e0 * i / 1023e0 - 1.5e0))))) AS v FROM range(1024) t(i)),
    (SELECT pow(10e0, -(2.1e0 / (1e0 + exp(6e0)))) AS top))
"""


def lookup_sql(at: str) -> str:
    """Interpolated table lookup, clamped at both ends."""
    t = f"(least(greatest(({at}) / 3e0, 0e0), 1e0) * 1023)"
    lo = f"c[CAST(floor({t}) AS INTEGER) + 1]"
    hi = f"c[least(CAST(floor({t}) AS INTEGER) + 2, 1024)]"
    return f"({lo} + ({t} - floor({t})) * ({hi} - {lo}))"


@query("px_curve_lookup", with_sql(PIXEL_SQL, CURVE_SQL) + "SELECT roll_id, frame_id, y, x, " + ", ".join(
    f"round({lookup_sql(f'-log10(greatest({c}, 1e-7)) + 0.5e0')}, 6) AS {c}" for c in RGB) + " FROM pixels, curve")
def px_curve_lookup(spark, sf):
    paper = curve()
    return rounded(map_rgb(pixels(spark, sf), lambda c: paper.lookup(-F.log10(F.greatest(c, F.lit(1e-7))) + 0.5)))


TONE_SQL = """
paper AS (
  SELECT min(i) FILTER (WHERE v >= pow(10e0, -0.04e0)) AS ih, min(i) FILTER (WHERE v >= shadow_v) AS is_, any_value(shadow_v) AS shadow_v
  FROM (SELECT unnest(c) AS v, unnest(range(1024)) AS i FROM curve), (SELECT pow(10e0, 0.9e0 * log10(list_min(c))) AS shadow_v FROM curve)),
paper_points AS (
  SELECT (ih - 1 + (pow(10e0, -0.04e0) - c[ih]) / (c[ih + 1] - c[ih])) * 3e0 / 1023 AS hp,
         (is_ - 1 + (shadow_v - c[is_]) / (c[is_ + 1] - c[is_])) * 3e0 / 1023 AS sp FROM paper, curve),
ranges AS (
  SELECT roll_id, frame_id, count(*) AS n, quantile_cont(d, 0.001) AS d_lo, quantile_cont(d, 0.995) AS d_hi FROM (
    SELECT roll_id, frame_id, log10(greatest(r * 0.2722287168e0 + g * 0.6740817658e0 + b * 0.0536895174e0, 1e-7)) AS d FROM positives)
  GROUP BY roll_id, frame_id),
fit_grade AS (SELECT *, CASE WHEN d_hi - d_lo <= 0 THEN 1e0 ELSE least((hp - sp) / (d_hi - d_lo), 1e0) END AS grade FROM ranges, paper_points),
frame_tone AS (SELECT roll_id, frame_id, n, d_lo, d_hi, grade, (hp - 1.5e0) / grade + 1.5e0 - d_hi AS exposure FROM fit_grade),
flat AS (
  SELECT roll_id, frame_id, quantile_cont(v, 0.999) AS highlight FROM (
    SELECT roll_id, frame_id, unnest([r, g, b]) AS v FROM positives) GROUP BY roll_id, frame_id)
"""
PRINT_SQL = with_sql(PIXEL_SQL, CURVE_SQL, TONE_SQL) + """, printed AS (
  SELECT p.roll_id, p.frame_id, p.y, p.x, exposure, grade, """ + ", ".join(
    lookup_sql(f"(log10(greatest({c}, 1e-7)) + exposure - 1.5e0) * grade + 1.5e0") + f" AS {c}" for c in RGB) + """
  FROM positives p JOIN frame_tone t ON p.roll_id = t.roll_id AND p.frame_id = t.frame_id, curve)
"""


def _tones(spark, sf):
    return materialize(frame_tones(positives(spark, sf), curve()), "tones")


@query("px_print", PRINT_SQL + f"SELECT roll_id, frame_id, y, x, {rgb_sql()} FROM printed")
def px_print(spark, sf):
    toned = px.with_tone(positives(spark, sf), _tones(spark, sf))
    return rounded(px.print_paper(toned, curve()).select(*AT, *RGB))


@query("px_flat", with_sql(PIXEL_SQL, CURVE_SQL, TONE_SQL) + """
SELECT p.roll_id, p.frame_id, y, x, round(r * s, 5) AS r, round(g * s, 5) AS g, round(b * s, 5) AS b FROM positives p JOIN (
  SELECT roll_id, frame_id, CASE WHEN highlight <= 0 THEN 1e0 ELSE 0.8e0 / highlight END AS s FROM flat) f ON p.roll_id = f.roll_id AND p.frame_id = f.frame_id""")
def px_flat(spark, sf):
    from filmroll.operators.tone import linear_scale

    scale = linear_scale(positives(spark, sf)).withColumns({"exposure": F.lit(None).cast("double"), "grade": F.lit(None).cast("double")})
    return rounded(px.print_flat(px.with_tone(positives(spark, sf), scale)).select(*AT, *RGB), 5)


def _flat_records(spark, sf):
    """Flat files' recorded scales: by frame, missing on some and unusable on others."""
    frame = F.col("frame_id")
    scale = F.when(frame % 4 == 0, F.lit(None).cast("double")).when(frame % 4 == 1, -1.0).otherwise(frame % 7 / 10.0 + 0.25)
    return exif(spark, sf).select("roll_id", "frame_id", scale.alias("linear_scale"))


SCALE_SQL = "CASE WHEN frame_id % 4 >= 2 THEN frame_id % 7 / 10e0 + 0.25e0 ELSE 1e0 END"


@query("px_unflat", P + f"SELECT roll_id, frame_id, y, x, " + ", ".join(f"round({c} / ({SCALE_SQL}), 6) AS {c}" for c in RGB) + " FROM pixels")
def px_unflat(spark, sf):
    return rounded(px.unscale_flat(pixels(spark, sf), _flat_records(spark, sf)).select(*AT, *RGB))


@query("px_unflat_pins", with_sql(META_SQL) + f"""
SELECT roll_id, frame_id, CASE WHEN frame_id % 4 >= 2 THEN 0.25e0 END AS pinned_exposure,
  CASE WHEN frame_id % 4 < 2 THEN 'no recorded flat scale, so a pinned exposure can''t be reproduced: fitting it instead' END AS warning FROM frame_meta""")
def px_unflat_pins(spark, sf):
    return px.printable_pins(_flat_records(spark, sf), F.lit(0.25)).select("roll_id", "frame_id", "pinned_exposure", "warning")


def _linear(m) -> str:
    return ", ".join(f"r * {float(a)!r} + g * {float(b)!r} + b * {float(c)!r} AS {n}" for (a, b, c), n in zip(m, RGB))


@query("px_srgb8", PRINT_SQL + f""", lin AS (SELECT roll_id, frame_id, y, x, {_linear(working_to_srgb())} FROM printed)
SELECT roll_id, frame_id, y, x, """ + ", ".join(
    f"CAST(round_even(least(greatest(CASE WHEN {c} <= 0.0031308e0 THEN {c} * 12.92e0 ELSE 1.055e0 * pow(greatest({c}, 0e0), 1e0 / 2.4e0) - 0.055e0 END, 0e0), 1e0) * 255e0, 0) AS INTEGER) AS {c}" for c in RGB) + " FROM lin")
def px_srgb8(spark, sf):
    toned = px.with_tone(positives(spark, sf), _tones(spark, sf))
    return px.to_srgb8(px.print_paper(toned, curve())).select(*AT, *RGB)


@query("px_chroma", P + "SELECT roll_id, frame_id, y, x, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0e0 END, 6) AS chroma FROM pixels")
def px_chroma(spark, sf):
    return rounded(px.with_chroma(pixels(spark, sf)).select(*AT, "chroma"))


@query("px_saturation", P + """, med AS (SELECT roll_id, frame_id, quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb FROM pixels GROUP BY roll_id, frame_id)
SELECT p.roll_id, p.frame_id, y, x, round((greatest(r / mr, g / mg, b / mb) - least(r / mr, g / mg, b / mb)) / greatest(r / mr, g / mg, b / mb), 6) AS saturation
FROM pixels p JOIN med m ON p.roll_id = m.roll_id AND p.frame_id = m.frame_id""")
def px_saturation(spark, sf):
    from filmroll.operators.auto import bin_medians, local_saturation

    whole = pixels(spark, sf).withColumn("bin", F.lit(0))
    return rounded(local_saturation(whole, bin_medians(whole)).select(*AT, "saturation"))


@query("px_valid", P + f"SELECT roll_id, frame_id, y, x, {rgb_sql()} FROM scanned WHERE NOT isnan(r) AND greatest(r, g, b) > 0")
def px_valid(spark, sf):
    return rounded(px.valid_pixels(scanned(spark, sf)))


@query("px_stride", P + f"SELECT roll_id, frame_id, y, x, {rgb_sql()} FROM pixels WHERE x % 8 = 0 AND y % 8 = 0")
def px_stride(spark, sf):
    return rounded(px.stride_sample(pixels(spark, sf), 8))


@query("fn_density", P + "SELECT roll_id, frame_id, y, x, " + ", ".join(f"round(log10(1e0 / greatest({c}, 1e-7)), 6) AS {c}" for c in RGB) + " FROM pixels")
def fn_density(spark, sf):
    from filmroll.functions.density import density

    return rounded(map_rgb(pixels(spark, sf), density))


@query("fn_map_rgb", P + "SELECT roll_id, frame_id, y, x, round(sqrt(r), 6) AS r, round(sqrt(g), 6) AS g, round(sqrt(b), 6) AS b FROM pixels")
def fn_map_rgb(spark, sf):
    """A caller's own function of a channel."""
    return rounded(map_rgb(pixels(spark, sf), F.sqrt))


def _frame_profiles(spark, sf):
    """A calibration per frame: red and blue white balance step with the frame number."""
    frame = F.col("frame_id")
    return exif(spark, sf).select(
        "roll_id", "frame_id", (frame % 5 * 0.02 + 0.7).alias("wb_r"), F.lit(1.0).alias("wb_g"), (frame % 3 * 0.05 + 1.0).alias("wb_b"),
        F.lit(1.12).alias("s_r"), F.lit(1.0).alias("s_g"), F.lit(0.78).alias("s_b"))


@query("join_frame_params", PM + """
SELECT p.roll_id, p.frame_id, y, x, round(1e0 / greatest(pow(greatest(r * gain * (p.frame_id % 5 * 0.02e0 + 0.7e0), 1e-7), 1.12e0), 1e-7), 4) AS r,
  round(1e0 / greatest(g * gain, 1e-7), 4) AS g, round(1e0 / greatest(pow(greatest(b * gain * (p.frame_id % 3 * 0.05e0 + 1e0), 1e-7), 0.78e0), 1e-7), 4) AS b
FROM pixels p JOIN gains k ON p.roll_id = k.roll_id AND p.frame_id = k.frame_id""")
def join_frame_params(spark, sf):
    matched = px.apply_gain(pixels(spark, sf), _gains(spark, sf))
    return rounded(px.to_positive(px.with_profile(matched, _frame_profiles(spark, sf))).select(*AT, *RGB), 4)


@query("plan_develop_errors", P + """, bad AS (SELECT roll_id, frame_id, avg(CASE WHEN isnan(r) THEN 1e0 ELSE 0e0 END) AS share FROM scanned GROUP BY roll_id, frame_id),
said AS (SELECT roll_id, frame_id, CASE WHEN share > 0.01 THEN printf('%.1f', share * 100) || '% of its pixels aren''t valid numbers'
  WHEN frame_id % 7 IN (3, 5) THEN 'the frame has no calibration' END AS error FROM bad)
SELECT * FROM said WHERE error IS NOT NULL""")
def plan_develop_errors(spark, sf):
    """Frames that can't be developed and why: some have no calibration, some a part of one."""
    from filmroll.plans.develop import develop_errors

    frames = scanned(spark, sf).select("roll_id", "frame_id").distinct().where("frame_id % 7 <> 3")
    profile = frames.withColumns({k: F.when((F.col("frame_id") % 7 != 5) | (F.lit(k) != "s_b"), F.lit(float(v))) for k, v in PROFILE.items()})
    return develop_errors(scanned(spark, sf), materialize(profile, "profile"), curve())


@query("plan_outcomes", P + """, bad AS (SELECT roll_id, frame_id, count(*) AS pixels, count_if(isnan(r)) AS bad_pixels, avg(CASE WHEN isnan(r) THEN 1e0 ELSE 0e0 END) AS share FROM scanned GROUP BY roll_id, frame_id),
flat AS (SELECT roll_id + 1000 AS roll_id, frame_id, pixels, CAST(0 AS BIGINT) AS bad_pixels FROM bad)
SELECT roll_id, frame_id, pixels, bad_pixels, CASE WHEN share > 0.01 THEN printf('%.1f', share * 100) || '% of its pixels aren''t valid numbers' WHEN roll_id % 3 = 1 THEN 'no calibration' END AS error,
  share <= 0.01 AND roll_id % 3 <> 1 AS printed FROM bad
UNION ALL SELECT roll_id, frame_id, pixels, bad_pixels, CASE WHEN (roll_id - 1000) % 3 = 1 THEN 'no calibration' ELSE 'unfittable' END, false FROM flat""")
def plan_outcomes(spark, sf):
    """A row for every frame of a run, with the reason where it has no print: broken ones, rolls without a calibration, and
    frames whose calibration has a number that isn't one, of which there is one beside each other."""
    from filmroll.plans.develop import develop

    rows = scanned(spark, sf)
    # in the run a roll has an even number and its double the odd one after it, so that they never share one, however many there are
    own, double = (F.col("roll_id") * 2).alias("roll_id"), (F.col("roll_id") * 2 + 1).alias("roll_id")
    roll, doubled = F.shiftright("roll_id", 1), F.pmod("roll_id", F.lit(2)) == 1
    both = rows.select(own, "frame_id", "y", "x", *RGB).union(rows.select(double, "frame_id", "y", "x", *[F.lit(0.5).alias(c) for c in RGB]))
    rolls = both.select("roll_id").distinct().where(roll % 3 != 1).withColumns(
        {k: F.when(doubled & (F.lit(k) == "wb_r"), F.lit(float("nan"))).otherwise(F.lit(float(v))) for k, v in PROFILE.items()})
    run = develop(both, materialize(rolls, "rolls"), curve(), on=["roll_id"], unknown="no calibration")
    prints = run.frames.select("roll_id", "frame_id").distinct().withColumn("printed", F.lit(True))
    error = F.when(doubled & F.col("error").isNotNull() & (F.col("error") != "no calibration"), "unfittable").otherwise(F.col("error"))
    return run.outcomes.join(prints, ["roll_id", "frame_id"], "left").select(
        F.when(doubled, roll + 1000).otherwise(roll).alias("roll_id"), "frame_id", "pixels", "bad_pixels", error.alias("error"), F.coalesce("printed", F.lit(False)).alias("printed"))


@query("plan_print_frames", PRINT_SQL + """, failed AS (SELECT roll_id, frame_id FROM scanned GROUP BY roll_id, frame_id HAVING avg(CASE WHEN isnan(r) THEN 1e0 ELSE 0e0 END) > 0.01)
SELECT p.roll_id, p.frame_id, count(*) AS pixels, round(any_value(exposure), 6) AS exposure, round(any_value(grade), 6) AS grade,
  round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b
FROM printed p ANTI JOIN failed f ON p.roll_id = f.roll_id AND p.frame_id = f.frame_id GROUP BY p.roll_id, p.frame_id""")
def plan_print_frames(spark, sf):
    """The whole way from scan to print for every frame that isn't broken."""
    from filmroll.plans.develop import print_summary

    return rounded(print_summary(scanned(spark, sf), PROFILE, curve()))
