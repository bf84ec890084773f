"""Calibration from picked points."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmroll.catalog.pixel_queries import lookup_sql, CURVE_SQL, TONE_SQL
from filmroll.catalog.registry import query, rounded
from filmroll.catalog.tables import META_SQL, PIXEL_SQL, POINT_SQL, PROFILE, curve, frame_meta, pixels, points, positives, with_sql
from filmroll.catalog.tone_queries import AUTO_SQL, CC_SQL, pack_sql
from filmroll.operators import geometry, points as pt, scans
from filmroll.plans.develop import frame_tones
from filmroll.session import materialize

PT = with_sql(PIXEL_SQL, META_SQL, POINT_SQL)


def _dens(spark, sf):
    return materialize(pt.point_densities(points(spark, sf), pt.reference_scan(frame_meta(spark, sf))), "densities")


@query("agg_points_per_frame", PT + "SELECT roll_id, frame_id, count(*) AS points FROM points GROUP BY roll_id, frame_id")
def agg_points_per_frame(spark, sf):
    return pt.point_counts(points(spark, sf))


@query("agg_can_fit", PT + "SELECT roll_id, count(*) AS n, round(max(dg) - min(dg), 6) AS span, count(*) >= 2 AND max(dg) - min(dg) >= 0.1 AS can_fit FROM dens GROUP BY roll_id")
def agg_can_fit(spark, sf):
    return rounded(pt.can_fit(_dens(spark, sf)))


@query("agg_fit_points", PT + """
SELECT roll_id, n, round(pow(10e0, ar), 6) AS wb_r, 1e0 AS wb_g, round(pow(10e0, ab), 6) AS wb_b, round(1e0 / kr, 6) AS s_r, 1e0 AS s_g, round(1e0 / kb, 6) AS s_b, CAST(NULL AS VARCHAR) AS reason FROM fits""")
def agg_fit_points(spark, sf):
    return rounded(pt.fit_points(_dens(spark, sf)).select("roll_id", "n", "wb_r", "wb_g", "wb_b", "s_r", "s_g", "s_b", "reason"))


FRAME_FITS = """, fs AS (
  SELECT frame_id AS roll_id, count(*) AS n, avg(dr) AS mr, avg(dg) AS mg, avg(db) AS mb, var_pop(dg) * count(*) AS sxx, covar_pop(dr, dg) * count(*) AS sr, covar_pop(db, dg) * count(*) AS sb, max(dg) - min(dg) AS span FROM dens GROUP BY frame_id),
fk AS (SELECT *, CASE WHEN sxx > 0 THEN sr / sxx END AS kr, CASE WHEN sxx > 0 THEN sb / sxx END AS kb FROM fs),
refused AS (SELECT *, CASE WHEN n < 2 THEN 'need at least two neutral points' WHEN span = 0 THEN 'neutral points must differ in density'
  WHEN kr <= 0 THEN 'a channel''s density falls as green rises' WHEN NOT (1e0 / kr BETWEEN 0.2e0 AND 5e0) THEN 'the points don''t pin down the red layer'
  WHEN kb <= 0 THEN 'a channel''s density falls as green rises' WHEN NOT (1e0 / kb BETWEEN 0.2e0 AND 5e0) THEN 'the points don''t pin down the blue layer' END AS reason FROM fk)
"""


@query("agg_fit_points_by_frame", PT + FRAME_FITS + """
SELECT roll_id, n, CASE WHEN reason IS NULL THEN round(pow(10e0, mr - kr * mg), 6) END AS wb_r, CASE WHEN reason IS NULL THEN round(pow(10e0, mb - kb * mg), 6) END AS wb_b,
  CASE WHEN reason IS NULL THEN round(1e0 / kr, 6) END AS s_r, CASE WHEN reason IS NULL THEN round(1e0 / kb, 6) END AS s_b, reason FROM refused""")
def agg_fit_points_by_frame(spark, sf):
    """Every frame's points on their own: few, so that some fits are refused."""
    own = _dens(spark, sf).withColumn("roll_id", F.col("frame_id"))
    return rounded(pt.fit_points(own).select("roll_id", "n", "wb_r", "wb_b", "s_r", "s_b", "reason"))


DEV_SQL = """, bal AS (
  SELECT d.roll_id, d.frame_id, d.i, (dr - ar) / kr AS br, dg AS bg, (db - ab) / kb AS bb FROM dens d JOIN fits f ON d.roll_id = f.roll_id),
dev AS (SELECT roll_id, frame_id, i, br - (br + bg + bb) / 3e0 AS d_r, bg - (br + bg + bb) / 3e0 AS d_g, bb - (br + bg + bb) / 3e0 AS d_b FROM bal)
"""


@query("agg_residuals", PT + DEV_SQL + f"SELECT roll_id, frame_id, i, round(d_r, 6) AS e_r, round(d_g, 6) AS e_g, round(d_b, 6) AS e_b, round({CC_SQL}, 6) AS cc, {pack_sql('d_r', 'd_g', 'd_b')} AS pack FROM dev")
def agg_residuals(spark, sf):
    dens = _dens(spark, sf)
    return rounded(pt.residuals(dens, pt.fit_points(dens)))


CAST_SQL = "100e0 * (1e0 / kr + 1e0 / kb) * 0.005e0 * sqrt(1e0 / n + (pos - mg) * (pos - mg) / sxx)"


@query("agg_predicted_error", PT + f'SELECT f.roll_id, round(pos, 6) AS "at", round({CAST_SQL}, 6) AS cc FROM (SELECT roll_id, dg AS pos FROM dens) d JOIN fits f ON d.roll_id = f.roll_id')
def agg_predicted_error(spark, sf):
    """The predicted cast at every picked density."""
    dens = _dens(spark, sf)
    return rounded(pt.predicted_cast(pt.fit_points(dens), dens.select("roll_id", F.col("d_g").alias("at"))))


LOO_SQL = """, others AS (
  SELECT a.roll_id, a.frame_id, a.i, a.dr, a.dg, a.db, b.dr AS r2, b.dg AS g2, b.db AS b2 FROM dens a JOIN dens b ON a.roll_id = b.roll_id AND a.i <> b.i),
loo AS (
  SELECT roll_id, frame_id, i, any_value(dr) AS dr, any_value(dg) AS dg, any_value(db) AS db, count(*) AS m, max(g2) - min(g2) AS span,
    regr_slope(r2, g2) AS kr, regr_slope(b2, g2) AS kb, regr_intercept(r2, g2) AS ar, regr_intercept(b2, g2) AS ab FROM others GROUP BY roll_id, frame_id, i),
lb AS (SELECT *, (dr - ar) / kr AS br, dg AS bg, (db - ab) / kb AS bb FROM loo WHERE kr > 0 AND kb > 0 AND 1e0 / kr BETWEEN 0.2e0 AND 5e0 AND 1e0 / kb BETWEEN 0.2e0 AND 5e0),
ld AS (SELECT *, br - (br + bg + bb) / 3e0 AS d_r, bg - (br + bg + bb) / 3e0 AS d_g, bb - (br + bg + bb) / 3e0 AS d_b FROM lb),
agreed AS (SELECT *, (greatest(d_r, d_g, d_b) - least(d_r, d_g, d_b)) * 100e0 AS cc FROM ld WHERE m >= 2 AND span >= 0.1)
"""


@query("join_loo_pairs", PT + LOO_SQL + "SELECT roll_id, frame_id, i, round(1e0 / kr, 6) AS s_r, round(ar, 6) AS a_r, round(1e0 / kb, 6) AS s_b, round(ab, 6) AS a_b, round(span, 6) AS others_span FROM loo")
def join_loo_pairs(spark, sf):
    """The line through all the others, for every point: from sums, without forming the pairs."""
    return rounded(pt.leave_one_out(_dens(spark, sf)).select("roll_id", "frame_id", "i", "s_r", "a_r", "s_b", "a_b", "others_span"))


@query("win_loo", PT + LOO_SQL + "SELECT roll_id, frame_id, i, round(d_r, 6) AS e_r, round(d_g, 6) AS e_g, round(d_b, 6) AS e_b FROM ld")
def win_loo(spark, sf):
    return rounded(pt.agreement(_dens(spark, sf)).select("roll_id", "frame_id", "i", "e_r", "e_g", "e_b"))


BAND_SQL = "CASE WHEN cc > 10 THEN 'red' WHEN cc > 5 THEN 'amber' ELSE 'calm' END"


@query("win_agreement", PT + LOO_SQL + f"SELECT d.roll_id, d.frame_id, d.i, round(cc, 6) AS cc, pack, band FROM dens d LEFT JOIN (SELECT roll_id, i, cc, {pack_sql('d_r', 'd_g', 'd_b')} AS pack, {BAND_SQL} AS band FROM agreed) a ON d.roll_id = a.roll_id AND d.i = a.i")
def win_agreement(spark, sf):
    return rounded(pt.agreement(_dens(spark, sf)).select("roll_id", "frame_id", "i", "cc", "pack", "band"))


@query("win_agreement_by_frame", PT.replace("FROM points p JOIN", "FROM (SELECT * REPLACE (frame_id AS roll_id), roll_id AS real_roll FROM points) p JOIN").replace("ON p.roll_id = k.roll_id AND", "ON p.real_roll = k.roll_id AND")
       + LOO_SQL + f"SELECT d.frame_id, d.i, round(cc, 5) AS cc, pack, band FROM dens d LEFT JOIN (SELECT roll_id, i, cc, {pack_sql('d_r', 'd_g', 'd_b')} AS pack, {BAND_SQL} AS band FROM agreed) a ON d.roll_id = a.roll_id AND d.i = a.i")
def win_agreement_by_frame(spark, sf):
    """Each frame's points among themselves: few enough that some can't be judged."""
    own = _dens(spark, sf).withColumn("roll_id", F.col("frame_id"))
    return rounded(pt.agreement(own).select("frame_id", "i", "cc", "pack", "band"), 5)


WORST_SQL = """, spread AS (
  SELECT c.roll_id, c.frame_id, c.i, c.cc, c.d_r, c.d_g, c.d_b, c.m, sqrt(avg(pow(greatest((p.dr - c.ar) / c.kr, p.dg, (p.db - c.ab) / c.kb) - least((p.dr - c.ar) / c.kr, p.dg, (p.db - c.ab) / c.kb), 2))) * 100e0 AS rms
  FROM agreed c JOIN dens p ON c.roll_id = p.roll_id AND c.i <> p.i WHERE c.cc > 5 GROUP BY ALL),
worst AS (SELECT *, row_number() OVER (PARTITION BY roll_id ORDER BY round(rms, 9), round(cc, 9) DESC, i) AS k FROM spread)
"""
WORST_OUT = f"i, frame_id, round(cc, 5) AS cc, {pack_sql('d_r', 'd_g', 'd_b')} AS pack, {BAND_SQL} AS band, round(rms, 5) AS rms_without FROM worst WHERE k = 1"


@query("win_worst", PT + LOO_SQL + WORST_SQL + "SELECT roll_id, " + WORST_OUT)
def win_worst(spark, sf):
    return rounded(pt.worst_points(pt.agreement(_dens(spark, sf))), 5)


@query("win_worst_by_frame", PT.replace("FROM points p JOIN", "FROM (SELECT * REPLACE (frame_id AS roll_id), roll_id AS real_roll FROM points) p JOIN").replace("ON p.roll_id = k.roll_id AND", "ON p.real_roll = k.roll_id AND")
       + LOO_SQL + WORST_SQL + "SELECT roll_id, " + WORST_OUT)
def win_worst_by_frame(spark, sf):
    """The point to question on each frame, where every point matters to the line."""
    own = _dens(spark, sf).withColumn("roll_id", F.col("frame_id"))
    return rounded(pt.worst_points(pt.agreement(own)), 5)


WEDGE_SQL = """, wedge AS (
  SELECT p.roll_id, quantile_cont(-log10(greatest(g * gain, 1e-7)), 0.005) AS wl, quantile_cont(-log10(greatest(g * gain, 1e-7)), 0.995) AS wh
  FROM pixels p JOIN gains k ON p.roll_id = k.roll_id AND p.frame_id = k.frame_id GROUP BY p.roll_id)
"""
RELIABLE_SQL = """, steps AS (SELECT f.*, wl, wh, s, wl + (wh - wl) * (s / 1000e0) AS pos FROM few f JOIN wedge w ON f.real_roll = w.roll_id, range(1001) t(s)),
casts AS (SELECT *, """ + CAST_SQL + """ AS cc FROM steps),
spans AS (
  SELECT roll_id, max(cc) FILTER (WHERE s = 0 OR s = 1000) AS worst_cc, min(pos) FILTER (WHERE cc <= 5) AS lo, max(pos) FILTER (WHERE cc <= 5) AS hi, arg_min(pos, cc) AS best FROM casts GROUP BY roll_id),
said AS (SELECT roll_id, worst_cc, coalesce(lo, best) AS lo, coalesce(hi, best) AS hi, lo IS NOT NULL AS anywhere FROM spans)
SELECT roll_id, round(worst_cc, 6) AS worst_cc, round(lo, 6) AS reliable_low, round(hi, 6) AS reliable_high, anywhere AS reliable_anywhere, worst_cc > 5 AS limited,
  CASE WHEN worst_cc > 5 AND NOT anywhere THEN 'not reliable anywhere on the roll'
    WHEN worst_cc > 5 AND hi - lo < 0.1 THEN concat('reliable only near D ', printf('%.2f', (lo + hi) / 2))
    WHEN worst_cc > 5 THEN concat('reliable over D ', printf('%.1f', lo), '-', printf('%.1f', hi), ' only') END AS note FROM said"""


@query("agg_reliability", PT + WEDGE_SQL + ", few AS (SELECT *, roll_id AS real_roll FROM fits WHERE n >= 2 AND gmax - gmin >= 0.1)" + RELIABLE_SQL)
def agg_reliability(spark, sf):
    meta = frame_meta(spark, sf)
    gains = scans.scan_match(meta, pt.reference_scan(meta))
    return rounded(pt.fit_reliability(pt.fit_points(_dens(spark, sf)), pt.wedge_range(pixels(spark, sf), gains)))


@query("agg_reliability_by_frame", PT + WEDGE_SQL + FRAME_FITS + """, few AS (
  SELECT f.*, CAST(floor(f.roll_id / 25e0) AS BIGINT) AS real_roll FROM refused f WHERE reason IS NULL AND n >= 2 AND span >= 0.1)""" + RELIABLE_SQL)
def agg_reliability_by_frame(spark, sf):
    """Fits through one frame's few points, judged over their roll's density range."""
    meta = frame_meta(spark, sf)
    gains = scans.scan_match(meta, pt.reference_scan(meta))
    wedge = pt.wedge_range(pixels(spark, sf), gains)
    frames = meta.select(F.col("frame_id"), "roll_id").join(wedge, "roll_id").drop("roll_id").withColumnRenamed("frame_id", "roll_id")
    own = _dens(spark, sf).withColumn("roll_id", F.col("frame_id"))
    return rounded(pt.fit_reliability(pt.fit_points(own), frames))


@query("join_near_duplicate", PT + """
SELECT a.roll_id, a.frame_id, a.i, min(b.i) AS duplicate_of FROM dens a LEFT JOIN dens b ON a.roll_id = b.roll_id AND b.i < a.i AND abs(a.dg - b.dg) < 0.05
  AND abs((a.dr - a.dg) - (b.dr - b.dg)) < 0.02 AND abs((a.db - a.dg) - (b.db - b.dg)) < 0.02 GROUP BY a.roll_id, a.frame_id, a.i""")
def join_near_duplicate(spark, sf):
    return pt.near_duplicates(_dens(spark, sf))


def _saved(spark, sf):
    """Points a profile in use already holds: those picked on the upper half of their frame."""
    return points(spark, sf).where(F.col("y") < 12).select("roll_id", "frame_id", "i")


@query("set_new_points", PT + "SELECT roll_id, frame_id, i FROM points EXCEPT ALL SELECT roll_id, frame_id, i FROM points WHERE y < 12")
def set_new_points(spark, sf):
    from filmroll.operators.rolls import new_points

    return new_points(points(spark, sf).select("roll_id", "frame_id", "i"), _saved(spark, sf))


def _point_files(spark, sf):
    """Points by the file they were picked on; frames of odd rolls have been moved since."""
    place = F.when(F.col("roll_id") % 2 == 1, "/old/f").otherwise("/scans/f")
    return points(spark, sf).select("i", F.concat(place, F.col("frame_id").cast("string"), F.lit(".tif")).alias("path"))


def _loaded(spark, sf):
    meta = frame_meta(spark, sf)
    return meta.where(F.col("orders") > 100).select(F.concat(F.lit("/scans/"), "name", F.lit(".tif")).alias("path"), F.col("frame_id").alias("place"))


def _listed(spark, sf):
    return frame_meta(spark, sf).where(F.col("t").isNull()).select(F.concat(F.lit("/old/"), "name", F.lit(".tif")).alias("path"))


MOVED_SQL = """, pf AS (SELECT i, concat(CASE WHEN roll_id % 2 = 1 THEN '/old/f' ELSE '/scans/f' END, frame_id, '.tif') AS path FROM points),
loaded AS (SELECT concat('/scans/', name, '.tif') AS path, frame_id AS place FROM frame_meta WHERE orders > 100),
listed AS (SELECT concat('/old/', name, '.tif') AS path FROM frame_meta WHERE t IS NULL)
"""


@query("join_missing_frames", PT + MOVED_SQL + "SELECT DISTINCT path FROM pf WHERE path NOT IN (SELECT path FROM loaded) AND path NOT IN (SELECT path FROM listed)")
def join_missing_frames(spark, sf):
    return pt.missing_frames(_point_files(spark, sf), _loaded(spark, sf), _listed(spark, sf))


@query("join_reattach", PT + MOVED_SQL + """
SELECT p.i, p.path, CASE WHEN p.path IN (SELECT path FROM loaded) OR p.path IN (SELECT path FROM listed) THEN p.path ELSE coalesce(l.path, p.path) END AS new_path
FROM pf p LEFT JOIN loaded l ON split_part(p.path, '/', 3) = split_part(l.path, '/', 3)""")
def join_reattach(spark, sf):
    return pt.reattach(_point_files(spark, sf), _loaded(spark, sf), _listed(spark, sf))


# --- pixels around places ---------------------------------------------------------------------

@query("agg_block_mean", with_sql(PIXEL_SQL) + """, sizes AS (SELECT roll_id, frame_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY ALL),
k AS (SELECT *, greatest(1, greatest(h, w) // 14) AS k FROM sizes)
SELECT p.roll_id, p.frame_id, CAST(y // k AS INTEGER) AS ty, CAST(x // k AS INTEGER) AS tx, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b
FROM pixels p JOIN k ON p.roll_id = k.roll_id AND p.frame_id = k.frame_id WHERE y < h // k * k AND x < w // k * k GROUP BY ALL""")
def agg_block_mean(spark, sf):
    return rounded(geometry.thumbnail(pixels(spark, sf), 14))


PATCH_SQL = """, sizes AS (SELECT roll_id, frame_id, max(y) + 1 AS h, max(x) + 1 AS w FROM pixels GROUP BY ALL),
places AS (SELECT p.roll_id, p.frame_id, i, dy, dx, least(greatest(p.y + dy, 0), h - 1) AS y, least(greatest(p.x + dx, 0), w - 1) AS x
  FROM points p JOIN sizes s ON p.roll_id = s.roll_id AND p.frame_id = s.frame_id, range(-3, 4) a(dy), range(-3, 4) b(dx))
"""


@query("px_patch", PT + PATCH_SQL + """
SELECT q.roll_id, q.frame_id, i, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b
FROM places q JOIN pixels p ON q.roll_id = p.roll_id AND q.frame_id = p.frame_id AND q.y = p.y AND q.x = p.x""")
def px_patch(spark, sf):
    return rounded(geometry.patches(points(spark, sf), pixels(spark, sf), 3).select("roll_id", "frame_id", "i", "dy", "dx", "r", "g", "b"))


@query("px_patch_print", with_sql(PIXEL_SQL, META_SQL, POINT_SQL, CURVE_SQL, TONE_SQL) + PATCH_SQL + """
SELECT q.roll_id, q.frame_id, i, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, """ + ", ".join(
    f"round({lookup_sql(f'(log10(greatest({c}, 1e-7)) + exposure - 1.5e0) * grade + 1.5e0')}, 6) AS {c}" for c in "rgb") + """
FROM places q JOIN positives p ON q.roll_id = p.roll_id AND q.frame_id = p.frame_id AND q.y = p.y AND q.x = p.x
JOIN frame_tone t ON q.roll_id = t.roll_id AND q.frame_id = t.frame_id, curve""")
def px_patch_print(spark, sf):
    tones = materialize(frame_tones(positives(spark, sf), curve()), "tones")
    printed = geometry.print_patches(points(spark, sf), pixels(spark, sf), PROFILE, tones, curve(), 3)
    return rounded(printed.select("roll_id", "frame_id", "i", "dy", "dx", "r", "g", "b"))


SNAP_SQL = """, near AS (
  SELECT c.roll_id, c.frame_id, c.i, p.y, p.x, p.r, p.g, p.b FROM points c JOIN pixels p ON c.roll_id = p.roll_id AND c.frame_id = p.frame_id
    AND p.y BETWEEN c.y - 10 AND c.y + 10 AND p.x BETWEEN c.x - 10 AND c.x + 10)
"""


@query("join_snap", PT + SNAP_SQL + "SELECT roll_id, frame_id, i, count(*) AS pixels FROM near GROUP BY ALL")
def join_snap(spark, sf):
    """How many pixels lie around each click: the box join on its own."""
    return geometry.around(points(spark, sf), pixels(spark, sf), 10).groupBy("roll_id", "frame_id", "i").agg(F.count(F.lit(1)).alias("pixels"))


@query("win_snap", PT + SNAP_SQL + """, mid AS (SELECT roll_id, frame_id, i, quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb FROM near GROUP BY ALL),
ordered AS (SELECT n.*, row_number() OVER (PARTITION BY n.roll_id, n.frame_id, n.i ORDER BY sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)), y, x) AS k
  FROM near n JOIN mid m ON n.roll_id = m.roll_id AND n.frame_id = m.frame_id AND n.i = m.i)
SELECT roll_id, frame_id, i, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM ordered WHERE k = 1""")
def win_snap(spark, sf):
    return rounded(geometry.snap(points(spark, sf), pixels(spark, sf)))


# --- which calibration ------------------------------------------------------------------------

@query("join_calibration_choice", with_sql(PIXEL_SQL, AUTO_SQL, META_SQL, POINT_SQL) + """, voted AS (SELECT * FROM rolls WHERE roll_id % 3 <> 1)
SELECT m.roll_id, m.frame_id,
  CASE WHEN m.roll_id % 3 = 0 THEN round(pow(10e0, ar), 6) WHEN v.roll_id IS NOT NULL THEN round(v.wb_r, 6) ELSE round(e.wb_r, 6) END AS wb_r,
  CASE WHEN m.roll_id % 3 = 0 THEN round(1e0 / kb, 6) WHEN v.roll_id IS NOT NULL THEN round(v.s_b, 6) ELSE round(e.s_b, 6) END AS s_b,
  CASE WHEN m.roll_id % 3 = 0 THEN 'fit' WHEN v.roll_id IS NOT NULL THEN 'roll' WHEN e.frame_id IS NOT NULL THEN 'own' END AS origin,
  CASE WHEN m.roll_id % 3 = 0 OR v.roll_id IS NOT NULL THEN round(gain, 6) ELSE 1e0 END AS gain
FROM frame_meta m JOIN gains k ON m.frame_id = k.frame_id LEFT JOIN fits f ON m.roll_id = f.roll_id LEFT JOIN voted v ON m.roll_id = v.roll_id LEFT JOIN estimates e ON m.frame_id = e.frame_id""")
def join_calibration_choice(spark, sf):
    """Rolls by turns have a fit, an automatic estimate only, or neither."""
    from filmroll.operators import auto

    meta = frame_meta(spark, sf)
    estimates = materialize(auto.auto_estimate(pixels(spark, sf)), "estimates")
    fits = pt.fit_points(_dens(spark, sf)).where(F.col("roll_id") % 3 == 0)
    rolls = auto.roll_estimate(estimates).where(F.col("roll_id") % 3 != 1)
    gains = scans.scan_match(meta, pt.reference_scan(meta))
    chosen = scans.choose_calibration(meta, fits, rolls, estimates, gains)
    return rounded(chosen.select("roll_id", "frame_id", "wb_r", "s_b", "origin", "gain"))
