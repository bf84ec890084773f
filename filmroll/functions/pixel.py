"""Column -> Column functions of one pixel's channels. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmroll.functions.density import floored

RGB = ("r", "g", "b")


def map_rgb(df: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    """The extension point: any expression applied to each channel."""
    return df.withColumns({c: fn(F.col(c)) for c in RGB})


def matrix_rgb(df: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    r, g, b = (F.col(c) for c in RGB)
    return df.withColumns({c: r * float(m[0]) + g * float(m[1]) + b * float(m[2]) for c, m in zip(RGB, matrix)})


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def chroma(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / F.when(top > 0, top)).otherwise(F.lit(0.0))


def saturation(rgb: Sequence[Column], reference: Sequence[Column]) -> Column:
    """Channel spread after dividing by a reference; +inf where no channel is positive (or on NaN)."""
    scaled = [F.try_divide(c, ref) for c, ref in zip(rgb, reference)]
    usable = scaled[0].isNotNull() & scaled[1].isNotNull() & scaled[2].isNotNull()
    top = F.greatest(*scaled)
    ok = usable & (top > 0) & ~F.isnan(top)
    return F.when(ok, (top - F.least(*scaled)) / F.when(ok, top)).otherwise(F.lit(float("inf")))


@dataclass(frozen=True)
class Curve:
    """A 1-D response curve sampled evenly over [low, high]."""

    values: tuple[float, ...]
    low: float
    high: float

    @property
    def pivot(self) -> float:
        return (self.low + self.high) / 2.0

    @staticmethod
    def from_table(table: DataFrame, low: float, high: float, limit: int = 65_536) -> "Curve":
        """From rows `(i, v)`, divided by the largest value. A curve becomes a literal of the plan, so a
        table of more than `limit` rows is refused; raise it for a longer curve."""
        rows = table.select("i", "v").limit(limit + 1).collect()
        if not 2 <= len(rows) <= limit:
            raise ValueError(f"a curve has 2 to {limit} entries")
        values = [row.v for row in sorted(rows, key=lambda row: row.i)]
        return Curve(tuple(v / max(values) for v in values), low, high)

    def lookup(self, at: Column) -> Column:
        """Linear interpolation, clamped at both ends; NULL where `at` is. Entries and the steps to the next are array literals of the plan.
        Short on purpose: three lookups and what a plan fuses with them must stay under the 8,000 bytes beyond which Java leaves a method uncompiled."""
        last = len(self.values) - 1
        steps = [after - v for v, after in zip(self.values, self.values[1:])] + [0.0]
        entry, step = (F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in of) + "]"), "array<double>") for of in (self.values, steps))
        share = (at - self.low) * (1.0 / (self.high - self.low))
        t = F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share) * last
        below = F.floor(t).cast("int")
        return F.get(entry, below) + (t - below) * F.get(step, below)


def srgb_encode(linear: Column) -> Column:
    """IEC 61966-2-1 encoding."""
    return F.when(linear <= 0.0031308, linear * 12.92).otherwise(
        F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1.0 / 2.4)) * 1.055 - 0.055)


def to_8bit(encoded: Column) -> Column:
    return F.rint(F.least(F.greatest(encoded, F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")


def balanced(value: Column, wb: Column, scale: Column) -> Column:
    """White balance, then density balance of one channel."""
    return F.pow(floored(value * wb), scale)
