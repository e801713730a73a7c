"""Colour filter patterns: four colours, row by row; 0 is red, 1 green, 2 blue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGGB, GRBG, GBRG, BGGR = (0, 1, 1, 2), (1, 0, 2, 1), (1, 2, 0, 1), (2, 1, 1, 0)
PATTERNS = {"RGGB": RGGB, "GRBG": GRBG, "GBRG": GBRG, "BGGR": BGGR}


def phase(y: Column | str, x: Column | str) -> Column:
    """0 to 3: the place in the 2 by 2 pattern."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    return (F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2))).cast("int")


def colour(pattern: tuple[int, ...], y: Column | str, x: Column | str) -> Column:
    p = phase(y, x)
    out = F.lit(pattern[3])
    for k in (2, 1, 0):
        out = F.when(p == k, F.lit(pattern[k])).otherwise(out)
    return out


def channel_gain(v: Column | str, pattern: tuple[int, ...], gains: tuple[float, float, float], y: Column | str, x: Column | str) -> Column:
    """v times the gain of its colour."""
    c = colour(pattern, y, x)
    return (F.col(v) if isinstance(v, str) else v) * F.when(c == 0, F.lit(gains[0])).when(c == 1, F.lit(gains[1])).otherwise(F.lit(gains[2]))
