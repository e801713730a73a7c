"""Sample codecs as Column expressions, over unsigned values held as ints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unpack_12p(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """Three bytes to two high-aligned samples; the middle byte holds the first sample's upper and the second's lower nibble."""
    a, b, c = map(_c, (a, b, c))
    first = F.shiftleft(a.bitwiseOR(F.shiftleft(b.bitwiseAND(15), 8)), 4)
    second = F.shiftleft(F.shiftleft(c, 4).bitwiseOR(F.shiftright(b, 4)), 4)
    return F.array(first, second)


def unpack_12p_v2(a: Column | str, b: Column | str, c: Column | str) -> Column:
    """As unpack_12p, but the middle byte holds both samples' lower nibbles."""
    a, b, c = map(_c, (a, b, c))
    return F.array(F.shiftleft(F.shiftleft(a, 4).bitwiseOR(b.bitwiseAND(15)), 4), F.shiftleft(F.shiftleft(c, 4).bitwiseOR(F.shiftright(b, 4)), 4))


def unpack_10p(*five: Column | str) -> Column:
    """Five bytes to four high-aligned samples; the last byte holds two low bits of each."""
    *high, low = map(_c, five)
    return F.array(*[F.shiftleft(F.shiftleft(x, 2).bitwiseOR(F.shiftright(low, 2 * k).bitwiseAND(3)), 6) for k, x in enumerate(high)])


def pack_12(v0: Column | str, v1: Column | str) -> Column:
    """Two high-aligned samples to three bytes, most significant bits first."""
    a, b = F.shiftright(_c(v0), 4), F.shiftright(_c(v1), 4)
    return F.array(F.shiftright(a, 4), F.shiftleft(a.bitwiseAND(15), 4).bitwiseOR(F.shiftright(b, 8)), b.bitwiseAND(255))


def dark_to_linear(v: Column | str) -> Column:
    """12 bits in the low end of 16 to high-aligned; what was above 12 bits is lost."""
    return F.shiftleft(_c(v), 4).bitwiseAND(65535)


def linear_to_dark(v: Column | str) -> Column:
    return F.shiftright(_c(v), 4)


def hex_string(b: Column | str) -> Column:
    return F.lower(F.hex(_c(b)))


def float_text(x: Column | str) -> Column:
    """A number's shortest decimal digits without exponent and trailing zeros; null beyond 18 digits before the point."""
    text = _c(x).cast("string").try_cast("decimal(38,20)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def floor_even(n: Column | str) -> Column:
    return _c(n) - F.pmod(_c(n), F.lit(2))


def padded_stride(n: Column | str, to: int = 4) -> Column:
    return _c(n) + F.pmod(-_c(n), F.lit(to))


def clamp(v: Column | str, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(_c(v), F.lit(low)), F.lit(high))
