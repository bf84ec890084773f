"""Automatic calibration: every frame estimates its own balance from its least coloured pixels, a roll
takes the median of its frames' estimates, and frames that sit well away from it are named.

At most `DENSITY_BINS` bins of equal population per frame are cut by luminance; equal luminances are
taken in row-major order. On large frames the cut points come from exact order statistics, so no large
frame is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filmroll.constants import (
    DENSITY_BINS, DIFFERS_CC, HIGHLIGHT_PERCENTILE, MID_TONES, MIN_PIXELS_PER_BIN,
    MIN_ROLL_FRAMES, MIN_SEPARATION, NEUTRAL_FRACTION, SHADOW_PERCENTILE)
from filmroll.functions.density import cast_cc, cast_pack, cast_word, density
from filmroll.functions.pixel import RGB, saturation
from filmroll.operators.pixels import FRAME, PLACE, valid_pixels
from filmroll.operators.quantiles import (
    channel_quantiles, exact_quantiles, group_sizes, is_small, order_statistics)
from filmroll.session import attach, materialize, store

ROW_WIDTH = 2.0 ** 26  # one number for (y, x) in row-major order
TASK_ROWS = 500_000  # that a task sorts at once; frames that are ranked directly are smaller


def _bin_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(DENSITY_BINS), F.floor(n / MIN_PIXELS_PER_BIN))).cast("bigint")


def _cut_ranks(n: Column) -> Column:
    """Rank of the first pixel of every bin but the first; the first n % bins bins hold one more."""
    bins = _bin_count(n)
    base, extra = F.floor(n / bins).cast("bigint"), n % bins
    cuts = F.transform(F.sequence(F.lit(1).cast("bigint"), bins), lambda k: k * base + F.least(k, extra))
    return F.filter(cuts, lambda k: k < n)


def _place(y: Column, x: Column) -> Column:
    return y.cast("double") * ROW_WIDTH + x.cast("double")


def density_bins(pixels: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Adds `bin`, the pixel's density bin within its frame. Expects valid pixels only; `sizes` bounds the pixels
    of a frame, and all of them. Frames within a small measured bound are ranked directly."""
    at_most, total = group_sizes(pixels, FRAME) if sizes is None else sizes
    lum = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    if is_small(pixels, at_most):
        return _ranked_bins(pixels, lum, total)
    rows = pixels.withColumns({"_lum": lum, "_place": _place(F.col("y"), F.col("x"))})
    cuts, facts = store(order_statistics(rows, FRAME, "_lum", _cut_ranks, ties=True), "cuts",
                        tied=F.count_if(F.col("rank") > F.col("below")))
    size = 2 * cuts.measured_bytes
    first_place = F.lit(-1.0)
    if facts["tied"]:
        # a cut falls inside a run of equal luminances: find the pixel it falls on
        runs = cuts.where(F.col("rank") > F.col("below")).select(
            *FRAME, F.col("rank").alias("cut"), (F.col("rank") - F.col("below")).alias("skip"), F.col("value").alias("_lum"))
        same = attach(rows.select(*FRAME, "_lum", "_place"), runs, [*FRAME, "_lum"], size=size)
        at = order_statistics(same, [*FRAME, "cut", "skip"], "_place", lambda n: F.array("skip"))
        at = at.select(*FRAME, F.col("cut").alias("rank"), F.col("value").alias("place"))
        cuts = materialize(cuts.join(at, [*FRAME, "rank"], "left"), "places")
        first_place = F.coalesce(F.col("place"), F.lit(-1.0))
    per_frame = cuts.groupBy(*FRAME).agg(
        F.array_sort(F.collect_list(F.struct(F.col("value").alias("v"), first_place.alias("p")))).alias("_cuts"))
    joined = attach(rows, per_frame, FRAME, "left", size=size)

    def passed(k: int) -> Column:
        cut = F.get("_cuts", F.lit(k))
        beyond = (F.col("_lum") > cut["v"]) | ((F.col("_lum") == cut["v"]) & (F.col("_place") >= cut["p"]))
        return F.coalesce(beyond, F.lit(False)).cast("int")

    return joined.withColumn("bin", sum((passed(k) for k in range(1, DENSITY_BINS - 1)), passed(0))).drop(
        "_lum", "_place", "_cuts")


def _ranked_bins(pixels: DataFrame, lum: Column, total: int) -> DataFrame:
    """One sort serves both the count and the rank. The tasks grow in number with the `total` rows, and not in size; they stay
    parted by frame, so that what follows by frame moves no row."""
    tasks = max(pixels.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    rows = pixels.repartition(tasks, *FRAME).withColumn("_lum", lum)
    ordered = W.partitionBy(*FRAME).orderBy("_lum", *PLACE)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
                             "_k": F.row_number().over(ordered) - 1})
    bins = _bin_count(F.col("_n"))
    base, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
    long_part = extra * (base + 1)
    number = F.when(F.col("_k") < long_part, F.floor(F.col("_k") / (base + 1))).otherwise(
        F.floor((F.col("_k") - extra) / base))
    return rows.withColumn("bin", number.cast("int")).drop("_n", "_lum", "_k")


def bin_medians(binned: DataFrame, at_most: int | None = None) -> DataFrame:
    """Per-channel median of every (frame, bin): `r_mid`, `g_mid`, `b_mid`."""
    return channel_quantiles(binned, [*FRAME, "bin"], list(RGB), {"mid": 0.5}, at_most).drop("n_bad")


def local_saturation(binned: DataFrame, medians: DataFrame) -> DataFrame:
    """Colourfulness of each pixel against the median of pixels of similar density."""
    joined = attach(binned, medians.drop("n"), [*FRAME, "bin"], "inner", "medians")
    return joined.withColumn("saturation", saturation(
        [F.col(c) for c in RGB], [F.col(f"{c}_mid") for c in RGB])).drop(*[f"{c}_mid" for c in RGB])


def neutral_candidates(pixels: DataFrame, fraction: float = NEUTRAL_FRACTION, sizes: tuple[int, int] | None = None) -> DataFrame:
    """The least saturated `fraction` of each frame's valid pixels, ties at the threshold included. Frames within a small
    measured bound meet in one task each: their medians and thresholds are windows over rows that are moved once."""
    sizes = group_sizes(pixels, FRAME) if sizes is None else sizes
    at_most = sizes[0]
    binned = density_bins(valid_pixels(pixels), sizes)
    if is_small(pixels, at_most):
        in_bin = W.partitionBy(*FRAME, "bin")
        near = binned.withColumns({f"{c}_mid": F.percentile(c, F.lit(0.5)).over(in_bin) for c in RGB})
        judged = near.withColumn("saturation", saturation([F.col(c) for c in RGB], [F.col(f"{c}_mid") for c in RGB])).drop(*[f"{c}_mid" for c in RGB])
        ranked = judged.withColumn("_s", F.least("saturation", F.lit(1e300)))
        limit = F.percentile("_s", F.lit(fraction)).over(W.partitionBy(*FRAME))
        return ranked.withColumn("threshold", limit).where(F.col("_s") <= F.col("threshold")).drop("_s")
    # stored: several passes follow, and the bins cost more to find again than to read
    binned = materialize(binned, "binned")
    judged = local_saturation(binned, bin_medians(binned, at_most))
    # +inf (a degenerate reference) ranks last without taking part in the arithmetic
    ranked = judged.withColumn("_s", F.least("saturation", F.lit(1e300)))
    limit = exact_quantiles(ranked, FRAME, "_s", {"threshold": fraction}, at_most).drop("n")
    return attach(ranked, limit, FRAME, "inner", "threshold").where(
        F.col("_s") <= F.col("threshold")).drop("_s")


def candidate_extremes(candidates: DataFrame, at_most: int | None = None) -> DataFrame:
    """Per frame and channel: the thin (`shadow`) and dense (`highlight`) end of the candidates; frames
    with fewer than two candidates have no estimate and are left out."""
    q = channel_quantiles(candidates, FRAME, list(RGB), {"shadow": SHADOW_PERCENTILE, "highlight": HIGHLIGHT_PERCENTILE}, at_most).drop("n_bad")
    return q.where(F.col("n") >= 2)


def solve_two_point(extremes: DataFrame) -> DataFrame:
    """White balance and density scale that make both ends neutral; `min_span` is the smallest
    separation. A channel without any span has no solution and the row is dropped."""
    spans = {c: density(F.col(f"{c}_highlight")) - density(F.col(f"{c}_shadow")) for c in RGB}
    rows = extremes.withColumns({f"_span_{c}": s for c, s in spans.items()}).where(
        " AND ".join(f"_span_{c} <> 0" for c in RGB))
    out = {"wb_g": F.lit(1.0), "s_g": F.lit(1.0)}
    green = density(F.col("g_shadow"))
    for c in ("r", "b"):
        scale = F.col("_span_g") / F.col(f"_span_{c}")
        out[f"s_{c}"] = scale
        out[f"wb_{c}"] = F.pow(F.lit(10.0), density(F.col(f"{c}_shadow")) - green / scale)
    return rows.select(
        *[c for c in extremes.columns if c in (*FRAME, "n")],
        *[out[k].alias(k) for k in ("wb_r", "wb_g", "wb_b", "s_r", "s_g", "s_b")],
        F.least(*[F.abs(f"_span_{c}") for c in RGB]).alias("min_span"))


def auto_estimate(pixels: DataFrame) -> DataFrame:
    """Every frame's own estimate, from its own pixels."""
    sizes = group_sizes(pixels, FRAME)
    return solve_two_point(candidate_extremes(neutral_candidates(pixels, sizes=sizes), sizes[0]))


def weak_estimates(estimates: DataFrame) -> DataFrame:
    """Estimates whose two ends are too close in density to trust."""
    return estimates.where(F.col("min_span") < MIN_SEPARATION)


def at_scan_gain(estimates: DataFrame, gains: DataFrame) -> DataFrame:
    """The estimates as if each frame had been scanned `gain` times brighter."""
    gain = F.coalesce(F.col("gain"), F.lit(1.0))
    joined = estimates.join(gains.select(*FRAME, "gain"), FRAME, "left")
    return joined.withColumns({f"wb_{c}": F.col(f"wb_{c}") * F.pow(gain, F.lit(1.0) / F.col(f"s_{c}") - 1.0)
                               for c in RGB}).drop("gain")


def roll_estimate(estimates: DataFrame, by: list[str] = ["roll_id"]) -> DataFrame:
    """The median of the frames' estimates, white balance in log; green is the reference."""
    votes = estimates.select(*by, F.log10("wb_r").alias("l_r"), F.log10("wb_b").alias("l_b"), "s_r", "s_b")
    mid = channel_quantiles(votes, by, ["l_r", "l_b", "s_r", "s_b"], {"mid": 0.5})
    one = F.lit(1.0)
    return mid.select(
        *by, F.col("n").alias("votes"),
        F.pow(F.lit(10.0), "l_r_mid").alias("wb_r"), one.alias("wb_g"), F.pow(F.lit(10.0), "l_b_mid").alias("wb_b"),
        F.col("s_r_mid").alias("s_r"), one.alias("s_g"), F.col("s_b_mid").alias("s_b"))


def colour_difference(roll: DataFrame, estimates: DataFrame) -> DataFrame:
    """How each frame's own greys print through the roll's estimate, averaged over mid-tone densities:
    size (CC), filter pack and direction. The axis is a line in density, so its mean over evenly
    spaced densities is its value at their middle."""
    middle = sum(MID_TONES) / 2.0
    ref = roll.select("roll_id", "votes", *[F.col(f"{k}_{c}").alias(f"roll_{k}_{c}") for k in ("wb", "s") for c in RGB])
    joined = attach(estimates, ref, ["roll_id"], "inner", "roll")
    bal = {c: F.col(f"roll_s_{c}") * (F.log10(f"wb_{c}") + F.lit(middle) / F.col(f"s_{c}") - F.log10(f"roll_wb_{c}"))
           for c in RGB}
    rows = joined.select(*FRAME, "votes", *[v.alias(f"_{c}") for c, v in bal.items()])
    mean = (F.col("_r") + F.col("_g") + F.col("_b")) / 3.0
    dev = [F.col(f"_{c}") - mean for c in RGB]
    return rows.select(*FRAME, "votes", *[d.alias(f"d_{c}") for c, d in zip(RGB, dev)],
                       cast_cc(*dev).alias("cc"), cast_pack(*dev).alias("pack"), cast_word(*dev).alias("word"))


def differing_frames(differences: DataFrame) -> DataFrame:
    """Frames well off their roll's estimate, on rolls with enough votes to say so."""
    return differences.where((F.col("votes") >= MIN_ROLL_FRAMES) & (F.col("cc") > DIFFERS_CC))
