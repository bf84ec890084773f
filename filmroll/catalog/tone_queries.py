"""Print fit and automatic calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.pixel_queries import CURVE_SQL, TONE_SQL, lookup_sql
from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import META_SQL, PIXEL_SQL, curve, frame_meta, papers, pixels, positives, with_sql
from filmroll.operators import auto, tone
from filmroll.operators import pixels as px
from filmroll.operators.ordering import top_per_group
from filmroll.operators.points import reference_scan
from filmroll.operators.scans import scan_match
from filmroll.plans.develop import roll_profiles
from filmroll.session import materialize

TONE = with_sql(PIXEL_SQL, CURVE_SQL, TONE_SQL)
FRAME = ["roll_id", "frame_id"]


@query("agg_density_range", TONE + "SELECT roll_id, frame_id, n, round(d_lo, 6) AS d_lo, round(d_hi, 6) AS d_hi FROM ranges")
def agg_density_range(spark, sf):
    return rounded(tone.density_range(positives(spark, sf)))


@query("agg_density_range_large", TONE + """SELECT 0::BIGINT AS roll_id, 0::BIGINT AS frame_id, count(*) AS n, round(quantile_cont(d, 0.001), 6) AS low, round(quantile_cont(d, 0.999), 6) AS high
FROM (SELECT log10(greatest(r * 0.2722287168e0 + g * 0.6740817658e0 + b * 0.0536895174e0, 1e-7)) AS d FROM positives)""")
def agg_density_range_large(spark, sf):
    """All pixels as one frame, counted instead of gathered."""
    from filmroll.functions.density import log_luminance
    from filmroll.operators.quantiles import exact_quantiles

    one = positives(spark, sf).select(F.lit(0).cast("bigint").alias("roll_id"), F.lit(0).cast("bigint").alias("frame_id"),
                                      log_luminance(F.col("r"), F.col("g"), F.col("b")).alias("d"))
    return rounded(exact_quantiles(one, FRAME, "d", {"low": 0.001, "high": 0.999}))


@query("agg_paper_range", """
WITH papers AS (
  SELECT s_suppkey, i, pow(10e0, (s_acctbal / 20000e0 + 2e0) / (exp(6e0) + 1e0) - (s_acctbal / 20000e0 + 2e0) / (exp((i * 3e0 / 1023e0 - 1.5e0) * 4e0) + 1e0)) AS v
  FROM supplier, range(1024) t(i)),
aims AS (SELECT s_suppkey, pow(10e0, 0.9e0 * log10(min(v))) AS shadow_v, pow(10e0, -0.04e0) AS high_v FROM papers GROUP BY s_suppkey),
steps AS (SELECT s_suppkey, i, v, lag(v) OVER (PARTITION BY s_suppkey ORDER BY i) AS u FROM papers),
hits AS (
  SELECT s.s_suppkey, (i - 1 + (shadow_v - u) / (v - u)) * 3e0 / 1023 AS sp, NULL AS hp FROM steps s JOIN aims a ON s.s_suppkey = a.s_suppkey WHERE v >= shadow_v AND u < shadow_v
  UNION ALL SELECT s.s_suppkey, NULL, (i - 1 + (high_v - u) / (v - u)) * 3e0 / 1023 FROM steps s JOIN aims a ON s.s_suppkey = a.s_suppkey WHERE v >= high_v AND u < high_v)
SELECT s_suppkey, round(max(sp), 6) AS shadow_point, round(max(hp), 6) AS highlight_point FROM hits GROUP BY s_suppkey""")
def agg_paper_range(spark, sf):
    return rounded(tone.paper_range(papers(spark, sf), ["s_suppkey"], 0.0, 3.0))


@query("agg_fit_print", TONE + "SELECT roll_id, frame_id, round(exposure, 6) AS exposure, round(grade, 6) AS grade, true AS grade_fitted FROM frame_tone")
def agg_fit_print(spark, sf):
    fits = tone.fit_print(tone.density_range(positives(spark, sf)), curve())
    return rounded(fits.select(*FRAME, "exposure", "grade", "grade_fitted"))


PIN_SQL = "CASE WHEN frame_id % 3 = 0 THEN 0e0 WHEN frame_id % 3 = 1 THEN 0.7e0 END"


@query("agg_fit_print_pinned", TONE + f"""
SELECT roll_id, frame_id, round(CASE WHEN g = 0 THEN 1.5e0 - d_hi ELSE (hp - 1.5e0) / g + 1.5e0 - d_hi END, 6) AS exposure, round(g, 6) AS grade, pin IS NULL AS grade_fitted
FROM (SELECT *, coalesce(pin, grade) AS g FROM (SELECT *, {PIN_SQL} AS pin FROM fit_grade))""")
def agg_fit_print_pinned(spark, sf):
    """Grades pinned on some frames, one of them to 0."""
    pin = F.when(F.col("frame_id") % 3 == 0, 0.0).when(F.col("frame_id") % 3 == 1, 0.7)
    fits = tone.fit_print(tone.density_range(positives(spark, sf)), curve(), pin)
    return rounded(fits.select(*FRAME, "exposure", "grade", "grade_fitted"))


@query("agg_linear_scale", TONE + "SELECT roll_id, frame_id, round(highlight, 6) AS highlight, round(CASE WHEN highlight <= 0 THEN 1e0 ELSE 0.8e0 / highlight END, 9) AS linear_scale FROM flat")
def agg_linear_scale(spark, sf):
    return tone.linear_scale(positives(spark, sf)).select(*FRAME, F.round("highlight", 6).alias("highlight"), F.round("linear_scale", 9).alias("linear_scale"))


@query("agg_resolve_tone", TONE + """, asked AS (
  SELECT roll_id, frame_id, CASE WHEN frame_id % 5 = 4 THEN 'linear' ELSE 'paper' END AS mode,
    CASE WHEN frame_id % 4 = 1 THEN 0.3e0 END AS pe, CASE WHEN frame_id % 6 = 2 THEN 0.9e0 END AS pg,
    CASE WHEN frame_id % 3 = 1 THEN -0.2e0 END AS se, CASE WHEN frame_id % 3 = 1 THEN 0.8e0 END AS sg FROM ranges),
fit AS (SELECT a.*, coalesce(pg, sg, grade) AS g, hp, d_hi FROM asked a JOIN fit_grade f ON a.roll_id = f.roll_id AND a.frame_id = f.frame_id)
SELECT f.roll_id, f.frame_id, mode, round(CASE WHEN mode = 'paper' THEN coalesce(pe, se, (hp - 1.5e0) / g + 1.5e0 - d_hi) END, 6) AS exposure,
  round(CASE WHEN mode = 'paper' THEN g END, 6) AS grade, round(CASE WHEN mode = 'linear' THEN 0.8e0 / highlight END, 6) AS linear_scale,
  CASE WHEN mode = 'paper' THEN coalesce(pg, sg) IS NULL END AS grade_fitted, CAST(NULL AS VARCHAR) AS error
FROM fit f JOIN flat l ON f.roll_id = l.roll_id AND f.frame_id = l.frame_id""")
def agg_resolve_tone(spark, sf):
    ranges = materialize(tone.density_range(positives(spark, sf)), "ranges")
    frame = F.col("frame_id")
    asked = ranges.select(
        *FRAME, F.when(frame % 5 == 4, "linear").otherwise("paper").alias("mode"),
        F.when(frame % 4 == 1, 0.3).alias("pinned_exposure"), F.when(frame % 6 == 2, 0.9).alias("pinned_grade"),
        F.when(frame % 3 == 1, -0.2).alias("saved_exposure"), F.when(frame % 3 == 1, 0.8).alias("saved_grade"))
    fits = tone.fit_print(ranges.join(asked, FRAME), curve(), F.coalesce("pinned_grade", "saved_grade"))
    return rounded(tone.resolve_tone(asked, fits, tone.linear_scale(positives(spark, sf))))  # `error` is NULL here


AUTO_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY roll_id, frame_id ORDER BY (r + g + b) / 3e0, y, x) - 1 AS k, count(*) OVER (PARTITION BY roll_id, frame_id) AS n
  FROM pixels WHERE greatest(r, g, b) > 0),
sized AS (SELECT *, greatest(1, least(20, n // 200)) AS bins FROM ranked),
binned AS (
  SELECT *, CAST(CASE WHEN k < (n % bins) * (n // bins + 1) THEN k // (n // bins + 1) ELSE (k - n % bins) // (n // bins) END AS INTEGER) AS bin FROM sized),
medians AS (
  SELECT roll_id, frame_id, bin, count(*) AS n, quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb
  FROM binned GROUP BY roll_id, frame_id, bin),
judged AS (
  SELECT p.*, (greatest(r / mr, g / mg, b / mb) - least(r / mr, g / mg, b / mb)) / greatest(r / mr, g / mg, b / mb) AS saturation
  FROM binned p JOIN medians m ON p.roll_id = m.roll_id AND p.frame_id = m.frame_id AND p.bin = m.bin),
threshold AS (SELECT roll_id, frame_id, quantile_cont(saturation, 0.5) AS threshold FROM judged GROUP BY roll_id, frame_id),
candidates AS (SELECT j.*, threshold FROM judged j JOIN threshold t ON j.roll_id = t.roll_id AND j.frame_id = t.frame_id WHERE saturation <= threshold),
extremes AS (
  SELECT roll_id, frame_id, count(*) AS n, quantile_cont(r, 0.999) AS rs, quantile_cont(g, 0.999) AS gs, quantile_cont(b, 0.999) AS bs,
    quantile_cont(r, 0.001) AS rh, quantile_cont(g, 0.001) AS gh, quantile_cont(b, 0.001) AS bh
  FROM candidates GROUP BY roll_id, frame_id HAVING count(*) >= 2),
spans AS (
  SELECT *, log10(greatest(rs, 1e-7)) - log10(greatest(rh, 1e-7)) AS sr, log10(greatest(gs, 1e-7)) - log10(greatest(gh, 1e-7)) AS sg,
    log10(greatest(bs, 1e-7)) - log10(greatest(bh, 1e-7)) AS sb FROM extremes),
estimates AS (
  SELECT roll_id, frame_id, n, pow(10e0, -log10(greatest(rs, 1e-7)) + log10(greatest(gs, 1e-7)) / (sg / sr)) AS wb_r, 1e0 AS wb_g,
    pow(10e0, -log10(greatest(bs, 1e-7)) + log10(greatest(gs, 1e-7)) / (sg / sb)) AS wb_b, sg / sr AS s_r, 1e0 AS s_g, sg / sb AS s_b,
    least(abs(sr), abs(sg), abs(sb)) AS min_span FROM spans WHERE sr <> 0 AND sg <> 0 AND sb <> 0),
rolls AS (
  SELECT roll_id, count(*) AS votes, pow(10e0, quantile_cont(log10(wb_r), 0.5)) AS wb_r, 1e0 AS wb_g, pow(10e0, quantile_cont(log10(wb_b), 0.5)) AS wb_b,
    quantile_cont(s_r, 0.5) AS s_r, 1e0 AS s_g, quantile_cont(s_b, 0.5) AS s_b FROM estimates GROUP BY roll_id),
axes AS (
  SELECT e.roll_id, e.frame_id, votes, c.s_r * (log10(e.wb_r) + 1.2e0 / e.s_r - log10(c.wb_r)) AS br, 1.2e0 AS bg,
    c.s_b * (log10(e.wb_b) + 1.2e0 / e.s_b - log10(c.wb_b)) AS bb FROM estimates e JOIN rolls c ON e.roll_id = c.roll_id),
devs AS (SELECT roll_id, frame_id, votes, br - (br + bg + bb) / 3e0 AS d_r, bg - (br + bg + bb) / 3e0 AS d_g, bb - (br + bg + bb) / 3e0 AS d_b FROM axes)
"""
AUTO = with_sql(PIXEL_SQL, AUTO_SQL)


def pack_sql(r: str, g: str, b: str) -> str:
    """The filter pack of a deviation."""
    top = f"greatest({r}, {g}, {b})"
    dials = ", ".join(f"{{'cc': CAST(floor(({top} - {c}) * 100e0 + 0.5e0) AS INTEGER), 'p': {p}, 'f': '{f}'}}" for p, (f, c) in enumerate((("Y", b), ("M", g), ("C", r))))
    shown = f"list_filter([{dials}], lambda d: d.cc > 0)"
    order = f"list_transform(list_sort(list_transform({shown}, lambda d: {{'a': -d.cc, 'p': d.p, 'f': d.f}})), lambda d: concat(-d.a, d.f))"
    return f"CASE WHEN len({shown}) = 0 THEN 'neutral' ELSE concat('CC ', array_to_string({order}, ' + ')) END"


def word_sql(r: str, g: str, b: str) -> str:
    angle = f"((degrees(atan2(({r} + {g}) / 2e0 - {b}, {r} - {g})) + 360e0) % 360e0)"
    return f"CASE WHEN {angle} < 120 THEN 'warm' WHEN {angle} < 180 THEN 'green' WHEN {angle} < 300 THEN 'cool' ELSE 'magenta' END"


CC_SQL = "(greatest(d_r, d_g, d_b) - least(d_r, d_g, d_b)) * 100e0"
PROFILE_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in ("wb_r", "wb_g", "wb_b", "s_r", "s_g", "s_b"))


@query("win_density_bins", AUTO + "SELECT roll_id, frame_id, y, x, bin FROM binned")
def win_density_bins(spark, sf):
    return auto.density_bins(px.valid_pixels(pixels(spark, sf))).select(*FRAME, "y", "x", "bin")


@query("win_density_bins_ties", AUTO.replace("FROM pixels WHERE", "FROM (SELECT roll_id, frame_id, y, x, round(r, 1) AS r, round(g, 1) AS g, round(b, 1) AS b FROM pixels) WHERE")
       + "SELECT roll_id, frame_id, y, x, bin FROM binned")
def win_density_bins_ties(spark, sf):
    """Coarse samples: bins are cut inside long runs of equal luminance."""
    coarse = rounded(pixels(spark, sf), 1)
    return auto.density_bins(px.valid_pixels(coarse)).select(*FRAME, "y", "x", "bin")


@query("agg_local_median", AUTO + "SELECT roll_id, frame_id, bin, n, round(mr, 6) AS r_mid, round(mg, 6) AS g_mid, round(mb, 6) AS b_mid FROM medians")
def agg_local_median(spark, sf):
    return rounded(auto.bin_medians(auto.density_bins(px.valid_pixels(pixels(spark, sf)))))


@query("agg_candidates", AUTO + "SELECT roll_id, frame_id, y, x, round(saturation, 6) AS saturation, round(threshold, 6) AS threshold FROM candidates")
def agg_candidates(spark, sf):
    return rounded(auto.neutral_candidates(pixels(spark, sf)).select(*FRAME, "y", "x", "saturation", "threshold"))


@query("agg_extremes", AUTO + "SELECT roll_id, frame_id, n, " + ", ".join(f"round({c}{k[0]}, 6) AS {c}_{k}" for c in "rgb" for k in ("shadow", "highlight")) + " FROM extremes")
def agg_extremes(spark, sf):
    return rounded(auto.candidate_extremes(materialize(auto.neutral_candidates(pixels(spark, sf)), "candidates")))


@query("agg_solve_two", with_sql(PIXEL_SQL) + """, ends AS (
  SELECT roll_id, frame_id, max(r) AS rs, max(g) AS gs, max(b) AS bs, min(r) AS rh, min(g) AS gh, min(b) AS bh FROM pixels GROUP BY roll_id, frame_id),
spans AS (SELECT *, log10(rs) - log10(greatest(rh, 1e-7)) AS sr, log10(gs) - log10(greatest(gh, 1e-7)) AS sg, log10(bs) - log10(greatest(bh, 1e-7)) AS sb FROM ends)
SELECT roll_id, frame_id, round(pow(10e0, -log10(rs) + log10(gs) / (sg / sr)), 6) AS wb_r, 1e0 AS wb_g, round(pow(10e0, -log10(bs) + log10(gs) / (sg / sb)), 6) AS wb_b,
  round(sg / sr, 6) AS s_r, 1e0 AS s_g, round(sg / sb, 6) AS s_b, round(least(abs(sr), abs(sg), abs(sb)), 6) AS min_span FROM spans""")
def agg_solve_two(spark, sf):
    """Two-point solution between each frame's thinnest and densest values."""
    ends = pixels(spark, sf).groupBy(*FRAME).agg(
        *[F.max(c).alias(f"{c}_shadow") for c in "rgb"], *[F.min(c).alias(f"{c}_highlight") for c in "rgb"])
    return rounded(auto.solve_two_point(ends))


@query("agg_auto_frame", AUTO + f"SELECT roll_id, frame_id, n, {PROFILE_OUT}, round(min_span, 6) AS min_span FROM estimates")
def agg_auto_frame(spark, sf):
    return rounded(auto.auto_estimate(pixels(spark, sf)))


def _estimates(spark, sf):
    return materialize(auto.auto_estimate(pixels(spark, sf)), "estimates")


FLAT_ROLLS = "(SELECT roll_id, frame_id, y, x, CASE WHEN frame_id % 10 = 3 THEN pow(r, 0.05e0) ELSE r END AS r, CASE WHEN frame_id % 10 = 3 THEN pow(g, 0.05e0) ELSE g END AS g, CASE WHEN frame_id % 10 = 3 THEN pow(b, 0.05e0) ELSE b END AS b FROM pixels)"


@query("agg_separation", AUTO.replace("FROM pixels WHERE", f"FROM {FLAT_ROLLS} WHERE") + "SELECT roll_id, frame_id, round(min_span, 6) AS min_span FROM estimates WHERE min_span < 0.1")
def agg_separation(spark, sf):
    """Some frames are made very flat, so that their estimates are weak."""
    flat = F.col("frame_id") % 10 == 3
    rows = pixels(spark, sf).withColumns({c: F.when(flat, F.pow(c, F.lit(0.05))).otherwise(F.col(c)) for c in "rgb"})
    return rounded(auto.weak_estimates(auto.auto_estimate(rows)).select(*FRAME, "min_span"))


@query("agg_roll_median", AUTO + f"SELECT roll_id, votes, {PROFILE_OUT} FROM rolls")
def agg_roll_median(spark, sf):
    return rounded(auto.roll_estimate(_estimates(spark, sf)))


@query("agg_roll_median_stride", AUTO.replace("FROM pixels WHERE", "FROM pixels WHERE x % 2 = 0 AND y % 2 = 0 AND") + f"SELECT roll_id, votes, {PROFILE_OUT} FROM rolls")
def agg_roll_median_stride(spark, sf):
    """The roll estimate from every second row and column."""
    return rounded(roll_profiles(pixels(spark, sf), 2))


@query("agg_gain_shift", with_sql(PIXEL_SQL, AUTO_SQL, META_SQL) + """
SELECT e.roll_id, e.frame_id, round(wb_r * pow(gain, 1e0 / s_r - 1e0), 6) AS wb_r, 1e0 AS wb_g, round(wb_b * pow(gain, 1e0 / s_b - 1e0), 6) AS wb_b, round(s_r, 6) AS s_r, round(s_b, 6) AS s_b
FROM estimates e JOIN gains k ON e.roll_id = k.roll_id AND e.frame_id = k.frame_id""")
def agg_gain_shift(spark, sf):
    meta = frame_meta(spark, sf)
    shifted = auto.at_scan_gain(_estimates(spark, sf), scan_match(meta, reference_scan(meta)))
    return rounded(shifted.select(*FRAME, "wb_r", "wb_g", "wb_b", "s_r", "s_b"))


WARM = "(SELECT roll_id, frame_id, y, x, CASE WHEN frame_id % 12 = 5 THEN r * 1.4e0 ELSE r END AS r, g, CASE WHEN frame_id % 12 = 5 THEN b / 1.3e0 ELSE b END AS b FROM pixels)"
WARM_AUTO = AUTO.replace("FROM pixels WHERE", f"FROM {WARM} WHERE")


def _differences(spark, sf):
    """Some frames are lit differently from the rest."""
    other = F.col("frame_id") % 12 == 5
    rows = pixels(spark, sf).withColumns({
        "r": F.when(other, F.col("r") * 1.4).otherwise(F.col("r")), "b": F.when(other, F.col("b") / 1.3).otherwise(F.col("b"))})
    estimates = materialize(auto.auto_estimate(rows), "estimates")
    return materialize(auto.colour_difference(auto.roll_estimate(estimates), estimates), "differences")


DIFF_OUT = f"round({CC_SQL}, 6) AS cc, {pack_sql('d_r', 'd_g', 'd_b')} AS pack, {word_sql('d_r', 'd_g', 'd_b')} AS word"


@query("agg_colour_diff", WARM_AUTO + f"SELECT roll_id, frame_id, votes, round(d_r, 6) AS d_r, round(d_g, 6) AS d_g, round(d_b, 6) AS d_b, {DIFF_OUT} FROM devs")
def agg_colour_diff(spark, sf):
    return rounded(_differences(spark, sf))


@query("agg_differing", WARM_AUTO + f"SELECT roll_id, frame_id, {DIFF_OUT} FROM devs WHERE votes >= 6 AND {CC_SQL} > 10")
def agg_differing(spark, sf):
    return rounded(auto.differing_frames(_differences(spark, sf)).select(*FRAME, "cc", "pack", "word"))


@query("top_differing", WARM_AUTO + f"""
SELECT roll_id, frame_id, CAST(k AS INTEGER) AS place, round(cc, 6) AS cc FROM (
  SELECT *, row_number() OVER (PARTITION BY roll_id ORDER BY cc DESC, frame_id) AS k FROM (SELECT roll_id, frame_id, votes, round({CC_SQL}, 9) AS cc FROM devs)
  WHERE votes >= 6 AND cc > 10) WHERE k <= 4""")
def top_differing(spark, sf):
    """The four frames furthest off on each roll."""
    found = auto.differing_frames(_differences(spark, sf)).withColumn("cc", F.round("cc", 9))
    top = top_per_group(found, ["roll_id"], [F.desc("cc"), "frame_id"], 4)
    return rounded(top.select(*FRAME, F.col("_rank").alias("place"), "cc").orderBy(*FRAME))


DIALS = "SELECT roll_id, frame_id, y, x, log10(greatest(r, 1e-7)) AS d_r, log10(greatest(g, 1e-7)) AS d_g, log10(greatest(b, 1e-7)) AS d_b FROM pixels"


@query("fn_describe_cast", with_sql(PIXEL_SQL) + f"SELECT roll_id, frame_id, y, x, round({CC_SQL}, 4) AS cc, {pack_sql('d_r', 'd_g', 'd_b')} AS pack FROM ({DIALS})")
def fn_describe_cast(spark, sf):
    """Every pixel's channel densities named as a filter pack."""
    from filmroll.functions.density import cast_cc, cast_pack, density

    d = [-density(F.col(c)) for c in "rgb"]
    return rounded(pixels(spark, sf).select(*FRAME, "y", "x", cast_cc(*d).alias("cc"), cast_pack(*d).alias("pack")), 4)


@query("fn_cast_word", with_sql(PIXEL_SQL) + f"SELECT roll_id, frame_id, y, x, {word_sql('d_r', 'd_g', 'd_b')} AS word FROM ({DIALS})")
def fn_cast_word(spark, sf):
    from filmroll.functions.density import cast_word, density

    return pixels(spark, sf).select(*FRAME, "y", "x", cast_word(*[-density(F.col(c)) for c in "rgb"]).alias("word"))


@query("agg_wedge", with_sql(PIXEL_SQL, META_SQL) + """
SELECT p.roll_id, count(*) AS n, round(quantile_cont(-log10(greatest(g * gain, 1e-7)), 0.005), 6) AS wedge_low, round(quantile_cont(-log10(greatest(g * gain, 1e-7)), 0.995), 6) AS wedge_high
FROM pixels p JOIN gains k ON p.roll_id = k.roll_id AND p.frame_id = k.frame_id GROUP BY p.roll_id""")
def agg_wedge(spark, sf):
    from filmroll.operators.points import wedge_range

    meta = frame_meta(spark, sf)
    return rounded(wedge_range(pixels(spark, sf), scan_match(meta, reference_scan(meta))))


DEVELOP_SQL = with_sql(PIXEL_SQL[:PIXEL_SQL.index(",\nbalanced AS")], META_SQL) + """, failed AS (SELECT roll_id, frame_id FROM scanned GROUP BY roll_id, frame_id HAVING avg(CASE WHEN isnan(r) THEN 1e0 ELSE 0e0 END) > 0.01),
gained AS (SELECT p.roll_id, p.frame_id, y, x, r * gain AS r, g * gain AS g, b * gain AS b FROM pixels p JOIN gains k ON p.roll_id = k.roll_id AND p.frame_id = k.frame_id
  ANTI JOIN failed f ON p.roll_id = f.roll_id AND p.frame_id = f.frame_id),
""" + AUTO_SQL.replace("FROM pixels WHERE", "FROM gained WHERE x % 2 = 0 AND y % 2 = 0 AND").strip() + """,
positives AS (
  SELECT p.roll_id, frame_id, y, x, 1e0 / greatest(pow(greatest(r * wb_r, 1e-7), s_r), 1e-7) AS r, 1e0 / greatest(greatest(g, 1e-7), 1e-7) AS g, 1e0 / greatest(pow(greatest(b * wb_b, 1e-7), s_b), 1e-7) AS b
  FROM gained p JOIN rolls c ON p.roll_id = c.roll_id),
""" + CURVE_SQL.strip() + ",\n" + TONE_SQL.strip()


@query("plan_develop_rolls", DEVELOP_SQL + "\nSELECT p.roll_id, p.frame_id, count(*) AS pixels, " + ", ".join(
    "round(avg(" + lookup_sql(f"(log10(greatest({c}, 1e-7)) + exposure - 1.5e0) * grade + 1.5e0") + f"), 6) AS mean_{c}" for c in "rgb")
    + " FROM positives p JOIN frame_tone t ON p.roll_id = t.roll_id AND p.frame_id = t.frame_id, curve GROUP BY p.roll_id, p.frame_id")
def plan_develop_rolls(spark, sf):
    """A batch run: match exposures, estimate every roll, print every frame; mean print per frame."""
    from filmroll.catalog.tables import scanned
    from filmroll.plans.develop import develop_rolls

    meta = frame_meta(spark, sf)
    gains = materialize(scan_match(meta, reference_scan(meta)), "gains")
    printed = develop_rolls(scanned(spark, sf), curve(), 2, gains)
    return rounded(printed.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("pixels"), *[F.avg(c).alias(f"mean_{c}") for c in "rgb"]))
