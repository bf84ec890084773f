"""Calibration from picked neutral points, for many rolls at once.

`points` holds roll_id, frame_id, i (pick order, unique), x, y, r, g, b and the frame's scan settings
(t, f, iso; NULL when unknown). Fits come from per-roll sums; leaving one point out subtracts its own
share from sums centred on the roll's mean, so no roll's points ever meet in one task.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import (
    AMBER_CC, DUPLICATE_COLOUR, DUPLICATE_DENSITY, MAX_SCALE, MIN_AGREEMENT_POINTS, MIN_SCALE,
    MIN_SEPARATION, PICK_ERROR, RELIABILITY_STEPS, WEDGE_HIGH, WEDGE_LOW)
from filmroll.functions.density import agreement_band, cast_cc, cast_pack, density
from filmroll.functions.pixel import RGB
from filmroll.functions.scan import relative_exposure
from filmroll.functions.text import fixed
from filmroll.operators.quantiles import exact_quantiles
from filmroll.session import attach, materialize

ROLL = ["roll_id"]


def reference_scan(meta: DataFrame, by: list[str] = ROLL) -> DataFrame:
    """The most common scan setting of each roll, the brighter one on a tie."""
    known = meta.where(F.col("t").isNotNull())
    sizes = known.groupBy(*by, "t", "f", "iso").agg(F.count(F.lit(1)).alias("_frames"))
    light = relative_exposure(F.col("t"), F.col("f"), F.col("iso"))
    best = sizes.groupBy(*by).agg(F.max(F.struct("_frames", light.alias("rel"), "t", "f", "iso")).alias("_m"))
    return best.select(*by, "_m.t", "_m.f", "_m.iso", F.col("_m.rel").alias("ref_exposure"), F.col("_m._frames").alias("frames"))


def point_densities(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Each point's densities once brought to its roll's reference scan exposure."""
    joined = attach(points, reference.select("roll_id", "ref_exposure"), ROLL, "left", "reference")
    gain = F.coalesce(F.col("ref_exposure") / relative_exposure(F.col("t"), F.col("f"), F.col("iso")), F.lit(1.0))
    return joined.withColumns({f"d_{c}": density(F.col(c) * gain) for c in RGB}).select(
        "roll_id", "frame_id", "i", "x", "y", *RGB, "d_r", "d_g", "d_b")


def _sums(dens: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return dens.groupBy(*ROLL).agg(
        n.alias("n"), *[F.avg(f"d_{c}").alias(f"m_{c}") for c in RGB],
        (F.var_pop("d_g") * n).alias("sxx"),
        (F.covar_pop("d_g", "d_r") * n).alias("sxy_r"), (F.covar_pop("d_g", "d_b") * n).alias("sxy_b"),
        F.min("d_g").alias("g_min"), F.max("d_g").alias("g_max"))


def _line(c: str, sxx: Column, sxy: Column, mx: Column, my: Column) -> dict[str, Column]:
    slope = sxy / F.when(sxx > 0, sxx)
    return {f"slope_{c}": slope, f"a_{c}": my - slope * mx}


def _refusal(n: Column, spread: Column) -> Column:
    """Why a fit is refused; NULL when it is accepted. Needs slope_r and slope_b."""
    reason = (F.when(n < 2, "need at least two neutral points")
              .when(spread == 0, "neutral points must differ in density"))
    for c, layer in (("r", "red"), ("b", "blue")):
        slope = F.col(f"slope_{c}")
        scale = F.lit(1.0) / F.when(slope > 0, slope)
        reason = reason.when(slope <= 0, "a channel's density falls as green rises").when(
            ~scale.between(MIN_SCALE, MAX_SCALE), f"the points don't pin down the {layer} layer")
    return reason


def fit_points(dens: DataFrame) -> DataFrame:
    """Least squares of red and blue density on green, per roll: the calibration, or why there is none."""
    rows = _sums(dens)
    for c in ("r", "b"):
        rows = rows.withColumns(_line(c, F.col("sxx"), F.col(f"sxy_{c}"), F.col("m_g"), F.col(f"m_{c}")))
    rows = rows.withColumn("reason", _refusal(F.col("n"), F.col("g_max") - F.col("g_min")))
    ok = F.col("reason").isNull()
    fitted = {"wb_r": F.pow(F.lit(10.0), "a_r"), "wb_g": F.lit(1.0), "wb_b": F.pow(F.lit(10.0), "a_b"),
              "s_r": F.lit(1.0) / F.when(ok, F.col("slope_r")), "s_g": F.lit(1.0),
              "s_b": F.lit(1.0) / F.when(ok, F.col("slope_b"))}
    return rows.select(*ROLL, "n", "m_g", "sxx", "g_min", "g_max", "reason",
                       *[F.when(ok, v).alias(k) for k, v in fitted.items()])


def can_fit(dens: DataFrame) -> DataFrame:
    """At least two points, far enough apart in density to give a slope."""
    spans = dens.groupBy(*ROLL).agg(F.count(F.lit(1)).alias("n"), (F.max("d_g") - F.min("d_g")).alias("span"))
    return spans.withColumn("can_fit", (F.col("n") >= 2) & (F.col("span") >= MIN_SEPARATION))


def _deviation(scale_r: Column, a_r: Column, scale_b: Column, a_b: Column) -> dict[str, Column]:
    bal = {"r": scale_r * (F.col("d_r") - a_r), "g": F.col("d_g"), "b": scale_b * (F.col("d_b") - a_b)}
    mean = (bal["r"] + bal["g"] + bal["b"]) / 3.0
    return {c: v - mean for c, v in bal.items()}


def residuals(dens: DataFrame, fits: DataFrame) -> DataFrame:
    """Each point's balanced densities against their own mean over the channels."""
    joined = attach(dens, fits.where(F.col("reason").isNull()).select(*ROLL, "wb_r", "wb_b", "s_r", "s_b"), ROLL, "inner", "fits")
    dev = _deviation(F.col("s_r"), F.log10("wb_r"), F.col("s_b"), F.log10("wb_b"))
    return joined.select(*ROLL, "frame_id", "i", *[v.alias(f"e_{c}") for c, v in dev.items()],
                         cast_cc(*dev.values()).alias("cc"), cast_pack(*dev.values()).alias("pack"))


def _cast_at(at: Column) -> Column:
    return (F.col("s_r") + F.col("s_b")) * (100.0 * PICK_ERROR) * F.sqrt(
        F.lit(1.0) / F.col("n") + (at - F.col("m_g")) * (at - F.col("m_g")) / F.col("sxx"))


def predicted_cast(fits: DataFrame, at: DataFrame) -> DataFrame:
    """The cast (CC) a true neutral at green density `at` (roll_id, at) is predicted to print with."""
    joined = attach(at, fits.where(F.col("reason").isNull()), ROLL, "inner", "fits")
    return joined.select(*ROLL, "at", _cast_at(F.col("at")).alias("cc"))


def leave_one_out(dens: DataFrame) -> DataFrame:
    """Every point with the line through all the others (`slope_*`, `a_*`), the others' spread in green
    density and whether that line is acceptable."""
    sums = materialize(_sums(dens), "sums")
    joined = attach(dens, sums, ROLL)
    ends = joined.groupBy(*ROLL).agg(
        F.count_if(F.col("d_g") == F.col("g_max")).alias("_at_max"), F.max(F.when(F.col("d_g") < F.col("g_max"), F.col("d_g"))).alias("_next_max"),
        F.count_if(F.col("d_g") == F.col("g_min")).alias("_at_min"), F.min(F.when(F.col("d_g") > F.col("g_min"), F.col("d_g"))).alias("_next_min"))
    rows = attach(joined, ends, ROLL, label="ends")
    n, dx = F.col("n"), F.col("d_g") - F.col("m_g")
    left = F.when(n > 1, n - 1)
    share = n / left
    mx = F.col("m_g") - dx / left
    sxx = F.col("sxx") - dx * dx * share
    for c in ("r", "b"):
        dy = F.col(f"d_{c}") - F.col(f"m_{c}")
        rows = rows.withColumns(_line(c, sxx, F.col(f"sxy_{c}") - dx * dy * share, mx, F.col(f"m_{c}") - dy / left))
    top = F.when((F.col("d_g") == F.col("g_max")) & (F.col("_at_max") == 1), F.col("_next_max")).otherwise(F.col("g_max"))
    low = F.when((F.col("d_g") == F.col("g_min")) & (F.col("_at_min") == 1), F.col("_next_min")).otherwise(F.col("g_min"))
    rows = rows.withColumn("others_span", F.coalesce(top - low, F.lit(0.0)))
    rows = rows.withColumn("reason", _refusal(n - 1, F.col("others_span")))
    ok = F.col("reason").isNull() & (n > 2)
    scales = {f"s_{c}": F.when(ok, F.lit(1.0) / F.when(ok, F.col(f"slope_{c}"))) for c in ("r", "b")}
    return rows.withColumns(scales).select(
        *ROLL, "frame_id", "i", "d_r", "d_g", "d_b", "n", "m_r", "m_g", "m_b", "others_span", "reason",
        "s_r", "a_r", "s_b", "a_b")


def agreement(dens: DataFrame) -> DataFrame:
    """How far each point is from what the others agree neutral is; NULL where they can't say."""
    loo = leave_one_out(dens)
    dev = _deviation(F.col("s_r"), F.col("a_r"), F.col("s_b"), F.col("a_b"))
    rows = loo.withColumns({f"e_{c}": v for c, v in dev.items()})
    said = (F.col("n") >= MIN_AGREEMENT_POINTS) & F.col("s_r").isNotNull() & F.col("s_b").isNotNull() & (
        F.col("others_span") >= MIN_SEPARATION)
    e = [F.col(f"e_{c}") for c in RGB]
    return rows.withColumns({
        "cc": F.when(said, cast_cc(*e)), "pack": F.when(said, cast_pack(*e)),
        "band": F.when(said, agreement_band(cast_cc(*e)))})


PAIRS = (("r", "g"), ("b", "g"), ("r", "b"))
TERMS = [(), ("r",), ("g",), ("b",), ("r", "r"), ("g", "g"), ("b", "b"), ("r", "g"), ("r", "b"), ("g", "b")]


def _term_sum(term) -> str:
    return "_sum" + "".join(term)


def worst_points(agreed: DataFrame) -> DataFrame:
    """Per roll, the point to question first: of those outside the calm band, the one whose removal
    leaves the rest agreeing best (root mean square CC); ties go to the larger CC.

    Judging every candidate's line on every other point would be all pairs of a roll. The lines differ
    little on a roll with many points, so most points have the same most and least dense channel
    whichever line is used: for those the squared spread is a quadratic in the line's parameters and
    sums over the roll once. Only points near a change of order are judged line by line. Exact either way."""
    agreed = materialize(agreed.select(
        *ROLL, "frame_id", "i", "n", "cc", "pack", "band", "s_r", "s_b", "a_r", "a_b", "m_r", "m_g", "m_b",
        *[(F.col(f"d_{c}") - F.col(f"m_{c}")).alias(f"u_{c}") for c in RGB]), "agreement")
    # balanced channels as linear functions of the centred densities u: k * u + c (green: u + m_g)
    lines = agreed.where(F.col("band") != "calm").withColumns({
        "k_r": F.col("s_r"), "c_r": F.col("s_r") * (F.col("m_r") - F.col("a_r")) - F.col("m_g"),
        "k_b": F.col("s_b"), "c_b": F.col("s_b") * (F.col("m_b") - F.col("a_b")) - F.col("m_g")})
    lines = materialize(lines, "lines")
    box = lines.groupBy(*ROLL).agg(*[agg(p).alias(f"{p}_{side}") for p in ("k_r", "c_r", "k_b", "c_b")
                                     for side, agg in (("lo", F.min), ("hi", F.max))])
    placed = attach(agreed.select(*ROLL, "i", "u_r", "u_g", "u_b"), box, ROLL, label="box")
    placed = placed.withColumn("pair", _settled_pair())

    sums = placed.where(F.col("pair").isNotNull()).groupBy(*ROLL, "pair").agg(*[
        F.sum(_product([F.col(f"u_{c}") for c in term])).alias(_term_sum(term)) for term in TERMS])
    wide = sums.groupBy(*ROLL).agg(*[
        F.coalesce(F.max(F.when(F.col("pair") == "".join(p), F.col(_term_sum(t)))), F.lit(0.0)).alias("".join(p) + _term_sum(t))
        for p in PAIRS for t in TERMS])
    scored = attach(lines, wide, ROLL, "left", "sums")
    scored = scored.join(placed.select(*ROLL, "i", F.col("pair").alias("own_pair")), [*ROLL, "i"])
    whole = sum((_quadratic_sum(p) for p in PAIRS), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col("own_pair") == "".join(p), F.pow(_difference(p), F.lit(2.0))) for p in PAIRS], F.lit(0.0))
    scored = scored.withColumn("_settled", whole - own)

    loose = placed.where(F.col("pair").isNull()).select(
        *ROLL, F.col("i").alias("j"), *[F.col(f"u_{c}").alias(f"v_{c}") for c in RGB])
    judged = attach(lines.select(*ROLL, "i", "k_r", "c_r", "k_b", "c_b"), loose, ROLL, label="loose")
    r, g, b = F.col("k_r") * F.col("v_r") + F.col("c_r"), F.col("v_g"), F.col("k_b") * F.col("v_b") + F.col("c_b")
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    rest = judged.where(F.col("j") != F.col("i")).groupBy(*ROLL, "i").agg(F.sum(spread * spread).alias("_loose"))
    scored = scored.join(rest, [*ROLL, "i"], "left")
    rms = F.sqrt(F.greatest(F.col("_settled") + F.coalesce("_loose", F.lit(0.0)), F.lit(0.0)) / (F.col("n") - 1)) * 100.0
    scored = scored.withColumn("rms_without", F.round(rms, 9))
    first = scored.groupBy(*ROLL).agg(F.min(F.struct(
        "rms_without", (-F.round("cc", 9)).alias("_order"), "i", "frame_id", "cc", "pack", "band")).alias("_w"))
    return first.select(*ROLL, "_w.i", "_w.frame_id", "_w.cc", "_w.pack", "_w.band", "_w.rms_without")


def _product(columns: list[Column]) -> Column:
    out = F.lit(1.0)
    for c in columns:
        out = out * c
    return out


def _settled_pair() -> Column:
    """The pair of channels that is furthest apart under every candidate line, where that is certain."""
    lo, hi = {"g": F.col("u_g")}, {"g": F.col("u_g")}
    for c in ("r", "b"):
        ends = [F.col(f"k_{c}_{side}") * F.col(f"u_{c}") for side in ("lo", "hi")]
        lo[c] = F.least(*ends) + F.col(f"c_{c}_lo") - 1e-9
        hi[c] = F.greatest(*ends) + F.col(f"c_{c}_hi") + 1e-9
    out = F.lit(None).cast("string")
    for p, q in PAIRS:
        third = next(c for c in RGB if c not in (p, q))
        for top, low in ((p, q), (q, p)):
            certain = (lo[top] >= hi[third]) & (lo[third] >= hi[low])
            out = F.when(certain, p + q).otherwise(out)
    return out


def _weights(pair) -> dict[str, Column]:
    """The difference of a pair as weights of (1, u_r, u_g, u_b)."""
    line = {"r": {"r": F.col("k_r"), "": F.col("c_r")}, "b": {"b": F.col("k_b"), "": F.col("c_b")},
            "g": {"g": F.lit(1.0)}}
    p, q = (line[c] for c in pair)
    zero = F.lit(0.0)
    return {k: p.get(k, zero) - q.get(k, zero) for k in ("", "r", "g", "b")}


def _difference(pair) -> Column:
    w = _weights(pair)
    return w[""] + w["r"] * F.col("u_r") + w["g"] * F.col("u_g") + w["b"] * F.col("u_b")


def _quadratic_sum(pair) -> Column:
    w, name = _weights(pair), "".join(pair)

    def total(*term: str) -> Column:
        return F.coalesce(F.col(name + _term_sum(term)), F.lit(0.0))

    out = w[""] * w[""] * total()
    for c in RGB:
        out = out + w[""] * w[c] * total(c) * 2.0 + w[c] * w[c] * total(c, c)
    for c, d in (("r", "g"), ("r", "b"), ("g", "b")):
        out = out + w[c] * w[d] * total(c, d) * 2.0
    return out


def near_duplicates(dens: DataFrame) -> DataFrame:
    """For each point, the first earlier one of its roll that is nearly the same in tone and colour.

    Points fall into cells as wide as the tolerances, so two points of one cell always match and the
    cell's first point stands for all of it. From a neighbouring cell only points earlier than that
    first one can still win, which keeps the comparisons few where points crowd together."""
    rows = dens.select(*ROLL, "frame_id", "i", "d_g", (F.col("d_r") - F.col("d_g")).alias("rg"), (F.col("d_b") - F.col("d_g")).alias("bg"))
    sizes = {"d_g": DUPLICATE_DENSITY, "rg": DUPLICATE_COLOUR, "bg": DUPLICATE_COLOUR}
    cell = {f"q_{c}": F.floor(F.col(c) / w).cast("bigint") for c, w in sizes.items()}
    rows = rows.withColumns(cell)
    keys = [*ROLL, *cell]
    firsts = materialize(rows.groupBy(*keys).agg(F.min("i").alias("first")), "cells")
    shifts = F.array(*[F.struct(*[F.lit(s).alias(k) for s, k in zip(shift, cell)])
                       for shift in product((-1, 0, 1), repeat=3) if any(shift)])
    around = rows.withColumn("_shift", F.explode(shifts)).select(
        *ROLL, *[(F.col(k) + F.col(f"_shift.{k}")).alias(k) for k in cell],
        F.col("i").alias("j"), *[F.col(c).alias(f"j_{c}") for c in sizes])
    early = attach(around, firsts, keys).where(F.col("j") < F.col("first")).drop("first")
    near = (attach(rows, early, keys, label="early")
            .where((F.abs(F.col("d_g") - F.col("j_d_g")) < DUPLICATE_DENSITY)
                   & (F.abs(F.col("rg") - F.col("j_rg")) < DUPLICATE_COLOUR)
                   & (F.abs(F.col("bg") - F.col("j_bg")) < DUPLICATE_COLOUR))
            .groupBy(*ROLL, "i").agg(F.min("j").alias("neighbour")))
    joined = attach(rows, firsts, keys).join(near, [*ROLL, "i"], "left")
    own = F.when(F.col("first") < F.col("i"), F.col("first"))
    return joined.select(*ROLL, "frame_id", "i", F.least(own, F.col("neighbour")).alias("duplicate_of"))


def wedge_range(pixels: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """Per roll: the ends of its pooled green density, after scan gain."""
    from filmroll.operators.pixels import apply_gain

    rows = pixels if gains is None else apply_gain(pixels, gains)
    return exact_quantiles(rows.select("roll_id", density(F.col("g")).alias("_d")), ROLL, "_d",
                           {"wedge_low": WEDGE_LOW, "wedge_high": WEDGE_HIGH})


def fit_reliability(fits: DataFrame, wedge: DataFrame) -> DataFrame:
    """How far each roll's fit can be trusted over its density range: the predicted cast at the worse
    end, the span where it stays calm (else the best spot) and a note when it is limited."""
    usable = fits.where(F.col("reason").isNull() & (F.col("n") >= 2) & (F.col("g_max") - F.col("g_min") >= MIN_SEPARATION))
    last = RELIABILITY_STEPS - 1
    steps = usable.join(wedge.select(*ROLL, "wedge_low", "wedge_high"), ROLL).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(last))))
    at = F.col("wedge_low") + (F.col("wedge_high") - F.col("wedge_low")) * (F.col("k") / float(last))
    judged = steps.withColumn("at", at).withColumn("cc", _cast_at(F.col("at")))
    calm = F.col("cc") <= AMBER_CC
    out = judged.groupBy(*ROLL).agg(
        F.max(F.when((F.col("k") == 0) | (F.col("k") == last), F.col("cc"))).alias("worst_cc"),
        F.min(F.when(calm, F.col("at"))).alias("_low"), F.max(F.when(calm, F.col("at"))).alias("_high"),
        F.min(F.struct("cc", "k", "at")).alias("_best"))
    low, high = F.coalesce("_low", F.col("_best.at")), F.coalesce("_high", F.col("_best.at"))
    where = F.when(high - low < 0.1, F.concat(F.lit("only near D "), fixed((low + high) / 2, 2))).otherwise(
        F.concat(F.lit("over D "), fixed(low, 1), F.lit("-"), fixed(high, 1), F.lit(" only")))
    limited = F.col("worst_cc") > AMBER_CC
    return out.select(
        *ROLL, "worst_cc", low.alias("reliable_low"), high.alias("reliable_high"),
        F.col("_low").isNotNull().alias("reliable_anywhere"), limited.alias("limited"),
        F.when(limited & F.col("_low").isNull(), "not reliable anywhere on the roll")
        .when(limited, F.concat(F.lit("reliable "), where)).alias("note"))


def point_counts(points: DataFrame) -> DataFrame:
    """Points per frame."""
    return points.groupBy("roll_id", "frame_id").agg(F.count(F.lit(1)).alias("points"))


def missing_frames(points: DataFrame, loaded: DataFrame, listed: DataFrame) -> DataFrame:
    """Frames (by path) that carry points but are neither loaded nor listed on disk."""
    return (points.select("path").distinct().join(loaded.select("path"), "path", "left_anti")
            .join(listed.select("path"), "path", "left_anti"))


def reattach(points: DataFrame, loaded: DataFrame, listed: DataFrame) -> DataFrame:
    """Points whose frame is gone move to the first loaded frame (by `place`) of the same file name."""
    from filmroll.functions.text import base_name

    by_name = loaded.groupBy(base_name(F.col("path")).alias("_name")).agg(
        F.min_by("path", F.struct("place", "path")).alias("_namesake"))
    known = loaded.select("path").union(listed.select("path")).distinct().withColumn("_known", F.lit(True))
    rows = points.join(known, "path", "left").withColumn("_name", base_name(F.col("path")))
    moved = attach(rows, by_name, ["_name"], "left", "names")
    return moved.withColumn("new_path", F.when(F.col("_known"), F.col("path")).otherwise(
        F.coalesce("_namesake", "path"))).drop("_known", "_name", "_namesake")
