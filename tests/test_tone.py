import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmroll.catalog import load
from filmroll.catalog.tables import curve
from filmroll.operators import pixels as px, tone
from filmroll.functions.colour import pcs_to_working, rgb_to_xyz, working_to_srgb, AP1, ACES_WHITE
from filmroll.functions.pixel import Curve

PAPER = curve()


def neutral(spark, low, high, count=4000):
    """A neutral positive whose density runs evenly from low to high."""
    step = (high - low) / (count - 1)
    v = F.pow(F.lit(10.0), F.col("id") * step + low)
    return spark.range(count).select(F.lit(0).alias("roll_id"), F.lit(1).alias("frame_id"), (F.col("id") / 60).cast("int").alias("y"),
                                     (F.col("id") % 60).cast("int").alias("x"), v.alias("r"), v.alias("g"), v.alias("b"))


def fit(spark, positive, grade=None):
    return tone.fit_print(tone.density_range(positive), PAPER, grade).first()


def test_range_fills_the_paper(spark, paths):
    row = fit(spark, neutral(spark, 0.5, 2.4))
    shadow, highlight = tone.curve_range(PAPER)
    assert row.grade < 1
    land = [(d + row.exposure - PAPER.pivot) * row.grade + PAPER.pivot for d in (row.d_lo, row.d_hi)]
    assert land == pytest.approx([shadow, highlight], abs=1e-9)


def test_soft_scene_is_not_stretched(spark):
    row = fit(spark, neutral(spark, 1.0, 1.3))
    assert row.grade == 1.0
    assert row.d_hi + row.exposure == pytest.approx(tone.curve_range(PAPER)[1])


def test_exposure_absorbs_a_multiply(spark):
    positive = neutral(spark, 0.7, 1.65)
    a, b = fit(spark, positive), fit(spark, positive.withColumns({c: F.col(c) * 3.0 for c in "rgb"}))
    assert b.grade == pytest.approx(a.grade, abs=1e-9)
    assert b.exposure == pytest.approx(a.exposure - math.log10(3.0), abs=1e-9)


def test_pinned_and_zero_grade(spark):
    positive = neutral(spark, 0.7, 1.65)
    pinned = fit(spark, positive, F.lit(0.5))
    assert pinned.grade == 0.5 and not pinned.grade_fitted
    zero = fit(spark, positive, F.lit(0.0))
    assert zero.exposure == pytest.approx(PAPER.pivot - zero.d_hi)


def test_flat_frame_and_bad_range(spark):
    assert fit(spark, neutral(spark, 1.0, 1.0)).grade == 1.0
    ranges = spark.createDataFrame([(0, 1, 5, float("nan"), 1.0)], "roll_id int, frame_id int, n int, d_lo double, d_hi double")
    row = tone.fit_print(ranges, PAPER).first()
    assert row.error and row.grade is None and row.exposure is None


def test_neutral_stays_neutral_and_inside(spark):
    positive = neutral(spark, 0.2, 3.0)
    tones = tone.fit_print(tone.density_range(positive), PAPER).withColumn("linear_scale", F.lit(None).cast("double"))
    printed = px.print_paper(px.with_tone(positive, tones), PAPER)
    row = printed.agg(F.max(F.abs(F.col("r") - F.col("g"))).alias("off"), F.min("g").alias("lo"), F.max("g").alias("hi")).first()
    assert row.off == 0 and 0 <= row.lo and row.hi <= 1


def test_flat_scale(spark, paths):
    positive = neutral(spark, 0.0, 1.0)
    row = tone.linear_scale(positive).first()
    v = np.repeat(10 ** (np.arange(4000) / 3999), 3)
    assert row.linear_scale == pytest.approx(0.8 / np.percentile(v, 99.9), rel=1e-9)
    black = positive.withColumns({c: F.lit(0.0) for c in "rgb"})
    assert tone.linear_scale(black).first().linear_scale == 1.0


def test_paper_range_matches_the_planning_form(spark):
    table = spark.createDataFrame([(1, i, v) for i, v in enumerate(PAPER.values)], "k int, i int, v double")
    row = tone.paper_range(table, ["k"], PAPER.low, PAPER.high).first()
    assert (row.shadow_point, row.highlight_point) == pytest.approx(tone.curve_range(PAPER), abs=1e-12)


def test_paper_range_at_the_edges(spark):
    table = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.5), (2, 1, 0.6)], "k int, i int, v double")
    got = {r.k: (r.shadow_point, r.highlight_point) for r in tone.paper_range(table, ["k"], 0.0, 3.0).collect()}
    assert got[1] == (0.0, 0.0)  # reached at the first entry
    assert got[2][1] == 0.0  # never reached


def test_curve_lookup_and_loading(spark):
    table = spark.createDataFrame([(2, 4.0), (0, 1.0), (1, 2.0)], "i int, v double")
    loaded = Curve.from_table(table, 0.0, 2.0)
    assert loaded.values == (0.25, 0.5, 1.0)
    at = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (9.0,)], "t double").select(loaded.lookup(F.col("t")).alias("v"))
    assert [r.v for r in at.collect()] == [0.25, 0.375, 0.75, 1.0]
    with pytest.raises(ValueError):
        Curve.from_table(table.limit(1), 0.0, 2.0)


def test_curve_lookup_of_values_without_place(spark):
    loaded = Curve((0.25, 0.5, 1.0), 0.0, 2.0)
    at = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.0,), (-0.0,), (1.75,)]
    got = [r.v for r in spark.createDataFrame(at, "t double").coalesce(1).select(loaded.lookup(F.col("t")).alias("v")).collect()]
    assert got == [None, 1.0, 1.0, 0.25, 1.0, 0.25, 0.875]


@pytest.mark.parametrize("name", ["plan_print_frames", "plan_develop_rolls", "px_srgb8"])
def test_printing_is_compiled(spark, name):
    """Java leaves methods of over 8,000 bytes uncompiled; the pixels of a print went through one of them."""
    df = load().QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_srgb_grey_and_clipping(spark):
    df = spark.createDataFrame([(0, 0.18, 0.18, 0.18), (1, 100.0, 100.0, 100.0), (2, -1.0, -1.0, -1.0)], "x int, r double, g double, b double")
    got = {r.x: (r.r, r.g, r.b) for r in px.to_srgb8(df).collect()}
    assert max(got[0]) - min(got[0]) <= 1 and 110 < got[0][0] < 125
    assert got[1] == (255, 255, 255) and got[2] == (0, 0, 0)


def test_matrices():
    luminance = rgb_to_xyz(AP1, ACES_WHITE)[1]
    assert luminance == pytest.approx([0.2722287168, 0.6740817658, 0.0536895174], abs=1e-9)
    white = pcs_to_working() @ np.array([0.9642, 1.0, 0.8251])
    assert white == pytest.approx([1, 1, 1], abs=2e-3)
    assert working_to_srgb() @ np.ones(3) == pytest.approx([1, 1, 1], abs=2e-3)


def test_resolution_order(spark):
    frames = spark.createDataFrame([
        (0, 1, "paper", 0.1, 0.6, 0.2, 0.7), (0, 2, "paper", None, None, 0.2, 0.7), (0, 3, "paper", None, None, None, None), (0, 4, "linear", 0.1, 0.6, None, None)],
        "roll_id int, frame_id int, mode string, pinned_exposure double, pinned_grade double, saved_exposure double, saved_grade double")
    fits = spark.createDataFrame([(0, f, 0.9, 0.95) for f in (1, 2, 3, 4)], "roll_id int, frame_id int, exposure double, grade double")
    scales = spark.createDataFrame([(0, f, 0.3) for f in (1, 2, 3, 4)], "roll_id int, frame_id int, linear_scale double")
    got = {r.frame_id: (r.exposure, r.grade, r.linear_scale, r.grade_fitted) for r in tone.resolve_tone(frames, fits, scales).collect()}
    assert got == {1: (0.1, 0.6, None, False), 2: (0.2, 0.7, None, False), 3: (0.9, 0.95, None, True), 4: (None, None, 0.3, None)}


def test_stages(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 0.094, 0.131, 0.050)], "roll_id int, frame_id int, y int, x int, r double, g double, b double")
    profile = {"wb_r": 2.0, "wb_g": 1.0, "wb_b": 1.5, "s_r": 1.3, "s_g": 1.0, "s_b": 0.8}
    full, plain, dense = (px.develop(df, s, profile).first() for s in (px.Stage.FULL, px.Stage.INVERT_ONLY, px.Stage.DENSITY_ONLY))
    assert full.r == pytest.approx(1 / (0.094 * 2) ** 1.3)
    assert plain.r == pytest.approx(1 / 0.094)
    assert dense.r == pytest.approx((0.094 * 2) ** 1.3)


def test_broken_frames_are_left_out(spark, paths):
    from filmroll.plans.develop import print_summary

    good = neutral(spark, 0.1, 1.5, 1200).withColumns({c: 1 / F.col(c) for c in "rgb"})
    bad = good.withColumn("frame_id", F.lit(2)).withColumn("g", F.when(F.col("x") < 5, F.lit(float("inf"))).otherwise(F.col("g")))
    few = good.withColumn("frame_id", F.lit(3)).withColumn("g", F.when((F.col("x") == 0) & (F.col("y") < 4), F.lit(float("nan"))).otherwise(F.col("g")))
    out = print_summary(good.union(bad).union(few), px.IDENTITY, PAPER).collect()
    assert {r.frame_id for r in out} == {1, 3}
    assert all(math.isfinite(r.mean_g) and r.pixels == 1200 for r in out)


def test_every_frame_of_a_run_is_told_of(spark, paths):
    """Frames without a print say why, from the run that printed the others."""
    from filmroll.plans.develop import develop, develop_all

    good = neutral(spark, 0.1, 1.5, 1200).withColumns({c: 1 / F.col(c) for c in "rgb"})
    broken = good.withColumns({"roll_id": F.lit(2), "g": F.lit(float("inf"))})
    lost, odd = good.withColumn("roll_id", F.lit(3)), good.withColumn("roll_id", F.lit(4))
    rolls = spark.createDataFrame([(r, *[float("nan") if r == 4 else v for v in px.IDENTITY.values()]) for r in (1, 2, 4)], ["roll_id", *px.IDENTITY])
    both = good.withColumn("roll_id", F.lit(1)).union(broken).union(lost).union(odd)
    run = develop(both, rolls, PAPER, on=["roll_id"], unknown="no roll")
    told = {r.roll_id: r for r in run.outcomes.collect()}
    assert set(told) == {1, 2, 3, 4} and all(r.pixels == 1200 for r in told.values())
    assert told[1].error is None and told[1].exposure is not None
    assert "valid numbers" in told[2].error and told[3].error == "no roll" and "density range" in told[4].error
    assert {r.roll_id for r in run.frames.select("roll_id").distinct().collect()} == {1}
    flat = good.withColumns({c: F.lit(0.5) for c in "rgb"}).withColumn("roll_id", F.lit(9))
    outcomes = {r.roll_id: r.error for r in develop_all(good.withColumn("roll_id", F.lit(1)).union(flat), PAPER, 1).outcomes.collect()}
    assert set(outcomes) == {1, 9} and "calibration" in outcomes[9]  # a roll that no frame votes for
