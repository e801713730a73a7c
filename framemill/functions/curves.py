"""Tone curves that make room for wide ranges in few bits, and the tables that undo them."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = 65535


@cache
def gamma_exponent(bits_in: int = 16, bits_out: int = 10) -> float:
    """The exponent for which one step of the input's range is one step of the output's at the dark end."""
    return math.log(1 / (2**bits_out - 1)) / math.log(1 / (2**bits_in - 1))


@cache
def linlog_parameter(bits_in: int, bits_out: int) -> float:
    """The A for which log_{A+1}(A x + 1) takes 2^bits_in - 1 to 2^bits_out - 1. The curve's top falls as A grows, so halving finds it."""
    top, goal = 2**bits_in - 1, 2**bits_out - 1
    low, high = 1e-9, 1e3
    for _ in range(200):
        mid = math.sqrt(low * high)
        if math.log1p(mid * top) / math.log1p(mid) > goal:
            low = mid
        else:
            high = mid
    return math.sqrt(low * high)


def clamped(x: Column, top: int = WHITE) -> Column:
    """Half-even rounding, kept within 0 and top."""
    return F.least(F.greatest(F.bround(x), F.lit(0.0)), F.lit(float(top))).cast("int")


def lin_to_log(x: Column, a: float) -> Column:
    return F.ln(F.lit(a) * x + 1) / F.ln(F.lit(a) + 1)


def log_to_lin(y: Column, a: float) -> Column:
    return (F.pow(F.lit(a) + 1, y) - 1) / F.lit(a)


def gamma_reduce(v: Column, bits_out: int = 10) -> Column:
    return clamped(F.pow(v / F.lit(float(WHITE)), F.lit(gamma_exponent(16, bits_out))) * (2**bits_out - 1))


def linlog_reduce(v: Column, bits_in: int, bits_out: int) -> Column:
    """v must have bits_in bits: shift high-aligned samples down first for the 12-bit curves."""
    return clamped(lin_to_log(v.cast("double"), linlog_parameter(bits_in, bits_out)))


def gamma_table(spark: SparkSession, bits_out: int = 10) -> DataFrame:
    """i, v: the linear value of each code."""
    n = 2**bits_out
    return spark.range(n).select(F.col("id").cast("int").alias("i"), clamped(F.pow(F.col("id") / F.lit(float(n - 1)), F.lit(1 / gamma_exponent(16, bits_out))) * WHITE).alias("v"))


def linlog_table(spark: SparkSession, bits_in: int, bits_out: int) -> DataFrame:
    return spark.range(2**bits_out).select(F.col("id").cast("int").alias("i"), clamped(log_to_lin(F.col("id").cast("double"), linlog_parameter(bits_in, bits_out))).alias("v"))


def gamma_reduce_array(v: np.ndarray, bits_out: int = 10) -> np.ndarray:
    return np.clip(np.rint((v / WHITE) ** gamma_exponent(16, bits_out) * (2**bits_out - 1)), 0, WHITE).astype(np.uint16)


def gamma_table_array(bits_out: int = 10) -> np.ndarray:
    n = 2**bits_out
    return np.clip(np.rint((np.arange(n) / (n - 1)) ** (1 / gamma_exponent(16, bits_out)) * WHITE), 0, WHITE).astype(np.uint16)


def linlog_reduce_array(v: np.ndarray, a: float) -> np.ndarray:
    return np.clip(np.rint(np.log(a * v.astype(float) + 1) / np.log(a + 1)), 0, WHITE).astype(np.uint16)


def linlog_table_array(bits_in: int, bits_out: int) -> np.ndarray:
    a = linlog_parameter(bits_in, bits_out)
    return np.clip(np.rint(((a + 1) ** np.arange(2**bits_out) - 1) / a), 0, WHITE).astype(np.uint16)


def srgb(v: Column) -> Column:
    """The transfer function of sRGB, over linear 0 to 1."""
    return F.when(v > 0.0031308, 1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
