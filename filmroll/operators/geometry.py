"""Operators that look at pixels around a place: thumbnails, patches and snapping a click."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.constants import SNAP_RADIUS
from filmroll.functions.pixel import RGB, Curve
from filmroll.functions.text import let
from filmroll.operators.pixels import FRAME, PLACE, print_paper, to_positive, with_profile, with_tone
from filmroll.session import attach

TILE = 32


def frame_sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def thumbnail(pixels: DataFrame, edge: int) -> DataFrame:
    """Mean of k x k blocks, k chosen per frame so the longer side is about (not below) `edge`; rows and
    columns that don't fill a block are left out."""
    factor = F.greatest(F.lit(1), F.expr(f"cast(greatest(h, w) div {int(edge)} as int)"))
    sized = attach(pixels, frame_sizes(pixels).withColumn("k", factor), FRAME, label="sizes")
    whole = (F.col("y") < F.expr("h div k * k")) & (F.col("x") < F.expr("w div k * k"))
    return sized.where(whole).groupBy(
        *FRAME, F.expr("cast(y div k as int)").alias("ty"), F.expr("cast(x div k as int)").alias("tx")
    ).agg(*[F.avg(c).alias(c) for c in RGB])


def patches(points: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """The (2 radius + 1)^2 pixels around each point (roll_id, frame_id, i, y, x), repeating the edge
    beyond the frame's border. One row per point and offset; a place with no pixel gives no row."""
    sized = points.select(*FRAME, "i", F.col("y").alias("cy"), F.col("x").alias("cx")).join(frame_sizes(pixels), FRAME)
    span = F.sequence(F.lit(-radius), F.lit(radius))
    places = sized.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span))

    def inside(centre: str, offset: str, size: str):
        return F.least(F.greatest(F.col(centre) + F.col(offset), F.lit(0)), F.col(size) - 1).cast("int")

    places = places.select(*FRAME, "i", "dy", "dx", inside("cy", "dy", "h").alias("y"), inside("cx", "dx", "w").alias("x"))
    return attach(pixels, places, [*FRAME, *PLACE], label="places")


def print_patches(points: DataFrame, pixels: DataFrame, profile, frame_tone: DataFrame, curve: Curve,
                  radius: int) -> DataFrame:
    """Only the patches, printed with the tone their whole frame was already resolved to."""
    around = patches(points, pixels, radius)
    return print_paper(with_tone(to_positive(with_profile(around, profile)), frame_tone), curve)


def around(clicks: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """The pixels within `radius` rows and columns of each click (roll_id, frame_id, i, y, x). Boxes meet
    pixels by tile, an equality, before the exact comparison."""
    def tiles(c: str):
        return F.sequence(F.floor((F.col(c) - radius) / TILE), F.floor((F.col(c) + radius) / TILE))

    boxes = (clicks.select(*FRAME, "i", F.col("y").alias("cy"), F.col("x").alias("cx"), tiles("y").alias("_ty"), tiles("x").alias("_tx"))
             .withColumn("_ty", F.explode("_ty")).withColumn("_tx", F.explode("_tx")))
    tiled = pixels.withColumns({"_ty": F.floor(F.col("y") / TILE), "_tx": F.floor(F.col("x") / TILE)})
    near = attach(tiled, boxes, [*FRAME, "_ty", "_tx"], label="boxes").where(
        F.col("y").between(F.col("cy") - radius, F.col("cy") + radius)
        & F.col("x").between(F.col("cx") - radius, F.col("cx") + radius))
    return near.select(*FRAME, "i", *PLACE, *RGB)


#: Distances this much apart, as a share, may be equal but for the way they were worked out.
NEAR_TIE = 1e-12


def _c_distances(r, g, b):
    """Distances by the C library's pow, which SQL squares with; its last bit isn't always that of the product."""
    return r and [math.sqrt(math.pow(x, 2.0) + math.pow(y, 2.0) + math.pow(z, 2.0)) for x, y, z in zip(r, g, b)]


def snap(clicks: DataFrame, pixels: DataFrame, radius: int = SNAP_RADIUS) -> DataFrame:
    """For each click: the pixel nearest the median colour of its neighbourhood, the first in row-major
    order on a tie. A neighbourhood holds at most (2 radius + 1)^2 pixels, so it is gathered and judged as one row.

    The median of an even number lies between two pixels, which are then about equally far from it, and the last bit decides. So
    near ties, of which few have more than two pixels, are measured again as SQL does."""
    near = around(clicks, pixels, radius).groupBy(*FRAME, "i").agg(F.collect_list(F.struct(*PLACE, *RGB)).alias("_near"))

    def middle(c: str) -> Column:
        def between(v: Column) -> Column:
            low, high = (F.get(v, F.floor((F.size(v) - 1 + k) / 2).cast("int")) for k in (0, 1))
            return low * 0.5 + high * 0.5
        return let(F.array_sort(F.transform("_near", lambda p: p[c])), between).alias(c)

    def off(p: Column, c: str) -> Column:
        return p[c] - F.col(f"_mid.{c}")

    def judged(distance: Column, p: Column) -> Column:
        return F.struct(distance.alias("distance"), *[p[c].alias(c) for c in (*PLACE, *RGB)])

    far = F.transform("_near", lambda p: judged(F.sqrt(sum((off(p, c) * off(p, c) for c in RGB), F.lit(0.0))), p))
    found = near.withColumn("_mid", F.struct(*[middle(c) for c in RGB])).withColumn("_far", far).withColumn("_b", F.array_min("_far"))
    close = F.filter("_far", lambda p: p["distance"] <= F.col("_b.distance") * (1 + NEAR_TIE))
    found = found.withColumn("_close", close).drop("_near", "_far")
    tie = F.size("_close") > 1
    again = F.udf(_c_distances, "array<double>")
    found = found.withColumn("_again", again(*[F.when(tie, F.transform("_close", lambda p: off(p, c))) for c in RGB]))
    best = F.when(tie, F.array_min(F.zip_with("_again", "_close", judged))).otherwise(F.col("_b"))
    return found.select(*FRAME, "i", best.alias("_b")).select(*FRAME, "i", *[F.col(f"_b.{c}").alias(c) for c in (*PLACE, *RGB)])
