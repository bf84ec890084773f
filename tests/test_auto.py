import numpy as np
import pytest
from pyspark.sql import functions as F

from filmroll.constants import DENSITY_BINS, MIN_PIXELS_PER_BIN
from filmroll.operators import auto
from filmroll.operators.pixels import valid_pixels


def image(spark, rgb, width=50, frame=1, roll=0):
    rows = [(roll, frame, i // width, i % width, *map(float, p)) for i, p in enumerate(rgb)]
    return spark.createDataFrame(rows, "roll_id int, frame_id int, y int, x int, r double, g double, b double").repartition(4)


def reference_bins(rgb):
    """Equal-population bins by luminance, row-major on ties."""
    n = len(rgb)
    bins = max(1, min(DENSITY_BINS, n // MIN_PIXELS_PER_BIN))
    order = np.argsort(rgb.mean(axis=1), kind="stable")
    out = np.empty(n, int)
    for k, part in enumerate(np.array_split(order, bins)):
        out[part] = k
    return out


def reference_estimate(rgb):
    bins = reference_bins(rgb)
    sat = np.empty(len(rgb))
    for k in range(bins.max() + 1):
        scaled = rgb[bins == k] / np.median(rgb[bins == k], axis=0)
        sat[bins == k] = (scaled.max(1) - scaled.min(1)) / scaled.max(1)
    chosen = rgb[sat <= np.percentile(sat, 50)]
    shadow, highlight = (-np.log10(np.percentile(chosen, p, axis=0)) for p in (99.9, 0.1))
    scale = (highlight - shadow)[1] / (highlight - shadow)
    wb = 10 ** (shadow - shadow[1] / scale)
    return wb, scale


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(7)
    return rng.uniform(0.01, 0.3, (1961, 3))


def test_two_point_ground_truth(spark):
    ends = spark.createDataFrame([(0, 1, 9, 0.094, 0.131, 0.050, 0.048, 0.054, 0.016)],
                                 "roll_id int, frame_id int, n int, r_shadow double, g_shadow double, b_shadow double, r_highlight double, g_highlight double, b_highlight double")
    row = auto.solve_two_point(ends).first()
    # known answer
    assert (row.wb_r, row.wb_g, row.wb_b) == pytest.approx((2.277304130526006, 1.0, 1.4658041418862766), rel=1e-12)
    assert (row.s_r, row.s_g, row.s_b) == pytest.approx((1.318585760497101, 1.0, 0.7777660280302214), rel=1e-12)
    for end in ((0.094, 0.131, 0.050), (0.048, 0.054, 0.016)):
        wb, s = (row.wb_r, 1.0, row.wb_b), (row.s_r, 1.0, row.s_b)
        out = [(v * w) ** k for v, w, k in zip(end, wb, s)]
        assert max(out) == pytest.approx(min(out), rel=1e-12)


def test_no_span_no_estimate(spark):
    flat = image(spark, [(0.2, 0.3, 0.1)] * 60)
    assert auto.auto_estimate(flat).count() == 0


def test_bins_equal_a_stable_sort(spark, noisy, paths):
    got = {(r.y, r.x): r.bin for r in auto.density_bins(image(spark, noisy)).collect()}
    want = reference_bins(noisy)
    assert [got[(i // 50, i % 50)] for i in range(len(noisy))] == list(want)


def test_bins_cut_inside_a_long_run_of_ties(spark, paths):
    rng = np.random.default_rng(3)
    rgb = np.where(rng.random((1500, 1)) < 0.7, 0.25, np.round(rng.uniform(0.1, 0.4, (1500, 3)), 1))
    got = {(r.y, r.x): r.bin for r in auto.density_bins(image(spark, rgb)).collect()}
    assert [got[(i // 50, i % 50)] for i in range(len(rgb))] == list(reference_bins(rgb))


def test_small_frames_are_moved_once_and_tasks_stay_small(spark, noisy, monkeypatch):
    """Bins, medians and thresholds of a frame share one exchange, whose tasks grow in number with the rows."""
    monkeypatch.setattr(auto, "TASK_ROWS", 100)
    monkeypatch.setattr(auto, "materialize", lambda df, label: df)
    rows = image(spark, noisy)
    assert auto.density_bins(rows).rdd.getNumPartitions() == 20
    found = auto.neutral_candidates(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count(" Join ") == 0 and plan.count("Sort [") == 2
    assert found.count() == len(noisy) // 2 + 1


def test_estimate_equals_numpy(spark, noisy, paths):
    row = auto.auto_estimate(image(spark, noisy)).first()
    wb, scale = reference_estimate(noisy)
    assert (row.wb_r, row.wb_g, row.wb_b) == pytest.approx(wb, rel=1e-9)
    assert (row.s_r, row.s_g, row.s_b) == pytest.approx(scale, rel=1e-9)


def test_coloured_decoys_are_passed_over(spark):
    """Two neutral patches and a few strongly coloured, more extreme pixels."""
    rgb = [(0.094, 0.131, 0.050)] * 1000 + [(0.048, 0.054, 0.016)] * 1000 + [(0.001, 0.5, 0.5)] * 50 + [(0.5, 0.5, 0.001)] * 50
    row = auto.auto_estimate(image(spark, rgb)).first()
    assert (row.s_r, row.s_b) == pytest.approx((1.318585760497101, 0.7777660280302214), rel=1e-6)


def test_bad_pixels_take_no_part(spark, noisy):
    bad = np.vstack([noisy, [[np.nan, 0.1, 0.1], [np.inf, 0.1, 0.1], [-1, -1, 0]]])
    a, b = (auto.auto_estimate(image(spark, rgb)).first() for rgb in (noisy, bad))
    assert a == b
    assert valid_pixels(image(spark, bad)).count() == len(noisy)


def test_gain_shift_equals_estimating_again(spark, noisy):
    frame = image(spark, noisy)
    gains = spark.createDataFrame([(0, 1, 1.7)], "roll_id int, frame_id int, gain double")
    shifted = auto.at_scan_gain(auto.auto_estimate(frame), gains).first()
    again = auto.auto_estimate(frame.withColumns({c: F.col(c) * 1.7 for c in "rgb"})).first()
    assert (shifted.wb_r, shifted.wb_b, shifted.s_r) == pytest.approx((again.wb_r, again.wb_b, again.s_r), rel=1e-9)


def votes(spark, casts):
    """Estimates whose greys print the given CC warm through a neutral roll."""
    rows = [(0, i, 10.0 ** (cc / 200.0), 1.0, 10.0 ** (-cc / 200.0), 1.0, 1.0, 1.0) for i, cc in enumerate(casts)]
    return spark.createDataFrame(rows, "roll_id int, frame_id int, wb_r double, wb_g double, wb_b double, s_r double, s_g double, s_b double")


def test_roll_is_the_median_and_names_outliers(spark, paths):
    estimates = votes(spark, [0, 0, 0, 0, 0, 9.9, 10.1, 12, 30])
    roll = auto.roll_estimate(estimates)
    assert roll.first().wb_r == pytest.approx(1.0) and roll.first().votes == 9
    found = auto.differing_frames(auto.colour_difference(roll, estimates)).orderBy(F.desc("cc")).collect()
    assert [r.frame_id for r in found] == [8, 7, 6]
    assert [round(r.cc, 6) for r in found] == [30, 12, 10.1]
    assert found[0].pack == "CC 30Y + 15M" and found[0].word == "warm"


def test_too_few_votes_to_differ(spark):
    estimates = votes(spark, [0, 0, 0, 0, 30])
    assert auto.differing_frames(auto.colour_difference(auto.roll_estimate(estimates), estimates)).count() == 0


@pytest.mark.parametrize("angle, word", [(0, "warm"), (119.9, "warm"), (120.1, "green"), (179.9, "green"), (180.1, "cool"),
                                         (299.9, "cool"), (300.1, "magenta"), (359.9, "magenta")])
def test_word_edges(spark, angle, word):
    from filmroll.functions.density import cast_word

    a, b = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    d_r, d_g, d_b = a / 2, -a / 2, -b
    row = spark.range(1).select(cast_word(F.lit(float(d_r)), F.lit(float(d_g)), F.lit(float(d_b))).alias("w")).first()
    assert row.w == word


@pytest.mark.parametrize("deviation, pack", [((0.1, 0.0, -0.1), "CC 20Y + 10M"), ((0.0, 0.0, 0.0), "neutral"), ((0.0, 0.004, 0.0), "neutral"),
                                             ((0.05, -0.05, 0.05), "CC 10M"), ((0.1, 0.0, 0.0), "CC 10Y + 10M"), ((0.0, 0.1, 0.0), "CC 10Y + 10C")])
def test_packs(spark, deviation, pack):
    from filmroll.functions.density import cast_pack

    assert spark.range(1).select(cast_pack(*[F.lit(v) for v in deviation]).alias("p")).first().p == pack
