"""Density and colour-cast expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filmroll.constants import AMBER_CC, LUMINANCE, MIN_TRANSMITTANCE, RED_CC


def floored(value: Column) -> Column:
    """A missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(MIN_TRANSMITTANCE)))


def density(value: Column) -> Column:
    """Optical density of a transmittance."""
    return -F.log10(floored(value))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


def log_luminance(r: Column, g: Column, b: Column) -> Column:
    """log10 of a positive's luminance: the tonal density of its negative."""
    return F.log10(floored(luminance(r, g, b)))


def cast_cc(r: Column, g: Column, b: Column) -> Column:
    """Size of a cast: the spread between the most and least dense channel, in CC (density x 100)."""
    return (F.greatest(r, g, b) - F.least(r, g, b)) * 100.0


def cast_pack(r: Column, g: Column, b: Column) -> Column:
    """The filter pack that names a cast, e.g. "CC 20Y + 10M": one or two dials, largest first, equal
    ones in the order Y, M, C, whole CC rounded half up; "neutral" when nothing is left."""
    top = F.greatest(r, g, b)
    dials = F.array(*[
        F.struct((-F.floor((top - channel) * 100.0 + 0.5)).cast("int").alias("minus_cc"),
                 F.lit(place).alias("place"), F.lit(name).alias("name"))
        for place, (name, channel) in enumerate((("Y", b), ("M", g), ("C", r)))])
    shown = F.transform(
        F.array_sort(F.filter(dials, lambda d: d["minus_cc"] < 0)),
        lambda d: F.concat((-d["minus_cc"]).cast("string"), d["name"]))
    return F.when(F.size(shown) == 0, F.lit("neutral")).otherwise(
        F.concat(F.lit("CC "), F.array_join(shown, " + ")))


def cast_word(r: Column, g: Column, b: Column) -> Column:
    """Direction of a cast as one word, from its hue angle in the plane (r - g, (r + g) / 2 - b)."""
    angle = F.pmod(F.degrees(F.atan2((r + g) / 2 - b, r - g)), F.lit(360.0))
    return (F.when(angle < 120, "warm").when(angle < 180, "green")
            .when(angle < 300, "cool").otherwise("magenta"))


def agreement_band(cc: Column) -> Column:
    return F.when(cc > RED_CC, "red").when(cc > AMBER_CC, "amber").otherwise("calm")
