import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from filmroll.operators import geometry
from filmroll.operators import points as pt

SCALE, WB = np.array([1.12, 1.0, 0.78]), np.array([0.73, 1.0, 1.05])
SCHEMA = "roll_id int, frame_id int, i bigint, x int, y int, r double, g double, b double, t double, f double, iso double"


def on_axis(dg, push=(0.0, 0.0, 0.0)):
    return 10.0 ** -(np.log10(WB) + dg / SCALE + np.array(push))


def table(spark, rgbs, roll=0, scan=(1 / 30, 8.0, 100.0), start=0):
    rows = [(roll, 1, start + i, i, 0, *map(float, rgb), *scan) for i, rgb in enumerate(rgbs)]
    return spark.createDataFrame(rows, SCHEMA)


def densities(points):
    return pt.point_densities(points, pt.reference_scan(points))


SIX = [on_axis(d) for d in (0.8, 0.95, 1.1, 1.3, 1.6)] + [on_axis(1.15, (0.06, 0.0, -0.06))]


def test_fit_recovers_the_axis(spark, paths):
    row = pt.fit_points(densities(table(spark, SIX[:5]))).first()
    assert (row.s_r, row.s_b, row.wb_r, row.wb_b) == pytest.approx((1.12, 0.78, 0.73, 1.05), rel=1e-9)


@pytest.mark.parametrize("rgbs, reason", [
    ([on_axis(1.0)], "need at least two"), ([on_axis(1.0)] * 3, "must differ in density"),
    ([(0.1, 0.1, 0.1), (0.2, 0.05, 0.05)], "falls as green rises"), ([(0.1, 0.1, 0.1), (0.0999, 0.05, 0.05)], "red layer"),
    ([(0.1, 0.1, 0.1), (0.05, 0.05, 0.0999)], "blue layer")])
def test_refusals(spark, rgbs, reason):
    row = pt.fit_points(densities(table(spark, rgbs))).first()
    assert reason in row.reason and row.s_r is None


def test_pushed_point_reads_as_known(spark, paths):
    """Known answer: the pushed point is CC 11.4 off, 11Y + 7M, red, and the one to question."""
    dens = densities(table(spark, SIX))
    agreed = pt.agreement(dens)
    row = agreed.where("i = 5").first()
    assert round(row.cc, 1) == 11.4 and row.pack == "CC 11Y + 7M" and row.band == "red"
    assert pt.worst_points(agreed).first().i == 5


def test_exposures_are_evened_out_first(spark):
    bright = table(spark, [v * 2 for v in SIX[:2]], scan=(1 / 15, 8.0, 100.0))
    rest = table(spark, SIX[2:5], start=2)
    row = pt.fit_points(densities(bright.union(rest))).first()
    assert (row.s_r, row.wb_b) == pytest.approx((1.12, 1.05), rel=1e-9)


def test_reference_tie_goes_to_the_brighter(spark):
    meta = spark.createDataFrame([(0, 1 / 30, 8.0, 100.0), (0, 1 / 60, 8.0, 100.0), (0, None, None, None)], "roll_id int, t double, f double, iso double")
    assert pt.reference_scan(meta).first().t == pytest.approx(1 / 30)


def _fit(d):
    out = []
    for c in (0, 2):
        slope, intercept = np.polyfit(d[:, 1], d[:, c], 1)
        if slope <= 0 or not 0.2 <= 1 / slope <= 5:
            return None
        out.append((1 / slope, intercept))
    return out


def _cc(fit, d):
    (sr, ar), (sb, ab) = fit
    bal = np.stack([sr * (d[:, 0] - ar), d[:, 1], sb * (d[:, 2] - ab)], 1)
    return (bal.max(1) - bal.min(1)) * 100


def brute(d):
    """Every point against the others, by trying them one by one."""
    cc, rms = [None] * len(d), {}
    for i in range(len(d)):
        rest = np.delete(d, i, 0)
        fit = _fit(rest) if len(d) >= 3 and np.ptp(rest[:, 1]) >= 0.1 else None
        if fit is None:
            continue
        cc[i] = _cc(fit, d[i:i + 1])[0]
        if cc[i] > 5:
            rms[i] = np.sqrt(np.mean(_cc(fit, rest) ** 2))
    worst = min(rms, key=lambda i: (round(rms[i], 9), -round(cc[i], 9), i)) if rms else None
    return cc, worst, rms


@pytest.mark.parametrize("seed, count, noise", [(1, 3, 0.05), (2, 5, 0.08), (3, 12, 0.05), (5, 250, 0.05)])
def test_agreement_and_worst_equal_brute_force(spark, seed, count, noise, paths):
    rng = np.random.default_rng(seed)
    rgbs = [on_axis(d, (rng.normal(0, noise), 0, rng.normal(0, noise))) for d in rng.uniform(0.5, 2.0, count)]
    agreed = pt.agreement(densities(table(spark, rgbs)))
    got = {r.i: r.cc for r in agreed.collect()}
    cc, worst, rms = brute(-np.log10(np.array(rgbs)))
    for i, want in enumerate(cc):
        assert (got[i] is None) == (want is None)
        assert want is None or got[i] == pytest.approx(want, abs=1e-6)
    row = pt.worst_points(agreed).first()
    assert (row.i if row else None) == worst
    if row:
        assert row.rms_without == pytest.approx(rms[worst], abs=1e-7)


def test_most_points_settle_without_pairs(spark):
    """On a roll with many points the lines hardly differ, so few points need judging line by line."""
    rng = np.random.default_rng(9)
    rgbs = [on_axis(d, (rng.normal(0, 0.05), 0, rng.normal(0, 0.05))) for d in rng.uniform(0.5, 2.0, 600)]
    agreed = pt.agreement(densities(table(spark, rgbs)))
    rows = agreed.select("roll_id", "i", "s_r", "s_b", "a_r", "a_b", "m_r", "m_g", "m_b", "band",
                         *[(F.col(f"d_{c}") - F.col(f"m_{c}")).alias(f"u_{c}") for c in "rgb"])
    lines = rows.where("band <> 'calm'").withColumns({
        "k_r": F.col("s_r"), "c_r": F.col("s_r") * (F.col("m_r") - F.col("a_r")) - F.col("m_g"),
        "k_b": F.col("s_b"), "c_b": F.col("s_b") * (F.col("m_b") - F.col("a_b")) - F.col("m_g")})
    box = lines.groupBy("roll_id").agg(*[agg(p).alias(f"{p}_{s}") for p in ("k_r", "c_r", "k_b", "c_b") for s, agg in (("lo", F.min), ("hi", F.max))])
    placed = rows.join(box, "roll_id").withColumn("pair", pt._settled_pair())
    assert placed.where("pair is null").count() < 60


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    d = np.round(np.stack([rng.uniform(0.9, 1.2, 400) + rng.normal(0, 0.02, 400), rng.uniform(0.9, 1.2, 400), rng.uniform(0.9, 1.2, 400)], 1), 3)
    d[:, 0] = d[:, 1] + rng.normal(0, 0.02, 400)
    d[:, 2] = d[:, 1] + rng.normal(0, 0.02, 400)
    got = {r.i: r.duplicate_of for r in pt.near_duplicates(densities(table(spark, 10.0 ** -d))).collect()}
    seen = -np.log10(np.maximum(10.0 ** -d, 1e-7))
    for i in range(len(d)):
        delta = seen[i] - seen[:i]
        hit = np.flatnonzero((abs(delta[:, 1]) < 0.05) & (abs(delta[:, 0] - delta[:, 1]) < 0.02) & (abs(delta[:, 2] - delta[:, 1]) < 0.02))
        assert got[i] == (hit[0] if len(hit) else None)


@pytest.mark.parametrize("spread, worst", [(0.1, 7.7), (0.3, 2.9), (0.6, 1.8)])
def test_reliability_of_narrow_and_wide_picks(spark, spread, worst):
    """Known answers, from a simulation that agrees to about a third."""
    dens = densities(table(spark, [on_axis(1.0 + k * spread / 2) for k in (-1, 0, 1)]))
    wedge = spark.createDataFrame([(0, 0.4, 1.6)], "roll_id int, wedge_low double, wedge_high double")
    row = pt.fit_reliability(pt.fit_points(dens), wedge).first()
    assert row.worst_cc == pytest.approx(worst, rel=0.35)
    assert row.limited == (row.worst_cc > 5)
    assert row.reliable_low <= 1.0 <= row.reliable_high


def test_wedge_pools_a_roll(spark, paths):
    df = spark.range(5000).select((F.col("id") % 2).alias("roll_id"), (F.col("id") % 7).alias("frame_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"),
                                  *[(F.col("id") % 997 / 1000.0).alias(c) for c in "rgb"])
    got = {r.roll_id: (r.wedge_low, r.wedge_high) for r in pt.wedge_range(df).collect()}
    for roll in (0, 1):
        g = np.array([(i % 997) / 1000 for i in range(5000) if i % 2 == roll])
        assert got[roll] == pytest.approx(tuple(np.percentile(-np.log10(np.maximum(g, 1e-7)), [0.5, 99.5])), rel=1e-9)


def test_snap_of_pairs_as_sql(spark, tmp_path):
    """The median of two pixels is as far from one as from the other, but for the last bit of SQL's pow."""
    duckdb.sql(f"""COPY (SELECT 1 AS roll_id, i // 2 AS frame_id, 0 AS y, CAST(i % 2 AS INTEGER) AS x, hash(i, 1) / 2e19 AS r, hash(i, 2) / 2e19 AS g, hash(i, 3) / 2e19 AS b
      FROM range(40000) t(i)) TO '{tmp_path}/p.parquet'""")
    pixels = spark.read.parquet(f"{tmp_path}/p.parquet")
    clicks = pixels.where("x = 0").select("roll_id", "frame_id", F.lit(0).alias("i"), "y", "x")
    want = duckdb.sql(f"""WITH p AS (SELECT * FROM '{tmp_path}/p.parquet'), m AS (SELECT frame_id, quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb FROM p GROUP BY frame_id)
      SELECT frame_id, x FROM (SELECT frame_id, x, row_number() OVER (PARTITION BY frame_id ORDER BY sqrt(pow(r - mr, 2) + pow(g - mg, 2) + pow(b - mb, 2)), y, x) AS k FROM p JOIN m USING (frame_id)) WHERE k = 1""").fetchall()
    assert {(r.frame_id, r.x) for r in geometry.snap(clicks, pixels).collect()} == set(want)
