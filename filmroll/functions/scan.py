"""How a frame was digitised: exposure settings and values kept as hex in edit histories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filmroll.functions.text import general_number, let


def relative_exposure(t: Column, f: Column, iso: Column) -> Column:
    """Proportional to the light that reached the sensor."""
    return t * iso / (f * f)


def stops(a: Column, b: Column) -> Column:
    return F.abs(F.log2(a / b))


def describe_scan(t: Column, f: Column, iso: Column) -> Column:
    """e.g. "1/30 f/8 ISO100"."""
    def words(s: Column) -> Column:
        fraction = F.concat(F.lit("1/"), F.rint(F.lit(1.0) / s["t"]).cast("bigint").cast("string"))
        shutter = F.when((s["t"] > 0) & (s["t"] < 1), fraction).otherwise(F.concat(general_number(s["t"]), F.lit("s")))
        return F.concat(shutter, F.lit(" f/"), general_number(s["f"]), F.lit(" ISO"), general_number(s["iso"]))

    return let(F.struct(t.alias("t"), f.alias("f"), iso.alias("iso")), words)


def _little_endian(hex_text: Column, start: int) -> Column:
    """Unsigned value of four bytes of hex text, least significant first; `start` is 1-based."""
    swapped = F.concat(*[F.substring(hex_text, start + at, 2) for at in (6, 4, 2, 0)])
    return F.conv(swapped, 16, 10).cast("bigint")


def hex_int(hex_text: Column, start: int) -> Column:
    bits = _little_endian(hex_text, start)
    return F.when(bits >= 2 ** 31, bits - 2 ** 32).otherwise(bits)


def hex_float(hex_text: Column, start: int) -> Column:
    """IEEE single precision from little-endian hex text, exactly."""
    bits = _little_endian(hex_text, start)
    negative = bits >= 2 ** 31
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(2 ** 23 - 1)).cast("double")
    size = (F.when(exponent == 0, fraction * 2.0 ** -149)
            .when(exponent < 255, (fraction + 2.0 ** 23) * F.pow(F.lit(2.0), (exponent - 150).cast("double")))
            .when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return F.when(negative, -size).otherwise(size)
