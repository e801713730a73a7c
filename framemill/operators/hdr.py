"""Merging of exposure brackets and refining of their multipliers, over pixels and over frames.

Every float step is a 32-bit one, and the accumulator is rounded to 16 bits after each shot, so the order of the fold matters: shots go from the darkest to the brightest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curves import WHITE


@dataclass(frozen=True)
class Merge:
    """clip: level above which a brighter shot isn't used. feather: below 1, shots are blended between feather * clip and clip. rising: weights as they have been in use, which trust the brighter shot most at the clipping point; else they fall to 0 there."""

    clip: float = 0.7
    feather: float = 1.0
    rising: bool = True

    @property
    def start(self) -> float:
        return float(np.float32(self.clip) * np.float32(self.feather))

    @property
    def width(self) -> float:
        """Of the levels that are blended; 0 if none are."""
        return float(np.float32(self.clip) - np.float32(self.start)) if self.feather < 1 else 0.0


def _f(x: Column | float) -> Column:
    return (F.lit(float(x)) if isinstance(x, (int, float)) else x).cast("float")


def merged(shots: list[Column | str], multipliers: list[float], how: Merge = Merge()) -> Column:
    """The merged sample of one pixel of all shots, given in ascending order of multipliers."""
    shots = [F.col(s) if isinstance(s, str) else s for s in shots]
    if sorted(multipliers) != list(multipliers):
        raise ValueError("shots go from the darkest to the brightest")
    scale = np.float32(1) / np.float32(multipliers[0])
    acc = shots[0]
    clip, width = np.float32(how.clip), np.float32(how.width)
    for v, m in zip(shots[1:], multipliers[1:]):
        eff = float(np.float32(m) * scale)
        level = _f(v / F.lit(float(WHITE)))
        scaled = _f(level / _f(eff))
        out = scaled
        if width:
            inside = _f(_f(clip.item()) - level)
            weight = _f(_f(_f(width.item()) - inside) / _f(width.item())) if how.rising else _f(inside / _f(width.item()))
            old = _f(acc / F.lit(float(WHITE)))
            blend = _f(_f(weight * scaled) + _f(_f(_f(1.0) - weight) * old))
            out = F.when(level > _f(how.start), blend).otherwise(scaled)
        acc = F.when(level > _f(clip.item()), acc).otherwise(F.least(F.greatest(F.bround(_f(out * _f(float(WHITE)))), F.lit(0)), F.lit(WHITE)).cast("int"))
    return acc


def merged_arrays(shots: list[np.ndarray], multipliers: list[float], how: Merge = Merge()) -> np.ndarray:
    """The same over whole frames of uint16 samples."""
    f = np.float32
    order = np.argsort(np.array(multipliers), kind="stable")
    shots, multipliers = [shots[i] for i in order], [multipliers[i] for i in order]
    acc, scale = shots[0].astype(np.uint16), f(1) / f(multipliers[0])
    clip, start = f(how.clip), f(how.start)
    width = f(how.width)
    for v, m in zip(shots[1:], multipliers[1:]):
        level = (v / np.float64(WHITE)).astype(f)
        scaled = level / (f(m) * scale)
        out = scaled
        if width:
            weight = (width - (clip - level)) / width if how.rising else (clip - level) / width
            old = (acc / np.float64(WHITE)).astype(f)
            out = np.where(level > start, weight * scaled + (f(1) - weight) * old, scaled)
        new = np.clip(np.rint(out * f(WHITE)), 0, WHITE).astype(np.uint16)
        acc = np.where(level > clip, acc, new)
    return acc


def bracket_pixels(pixels: DataFrame, shots: int, delay: int = 0) -> DataFrame:
    """set_index, y, x and the samples s0, s1, ... of each set of consecutive frames; sets with a missing shot are left out. One shuffle, with partial aggregation."""
    at = F.col("frame_index") - delay
    keyed = pixels.where(at >= 0).withColumns({"set_index": F.expr(f"(frame_index - {delay}) div {shots}"), "shot": F.pmod(at, F.lit(shots))})
    wide = keyed.groupBy("set_index", "y", "x").agg(*[F.max(F.when(F.col("shot") == k, F.col("v"))).alias(f"s{k}") for k in range(shots)])
    return wide.where(" and ".join(f"s{k} is not null" for k in range(shots)))


def exposure_ratios(pixels: DataFrame, shots: int, clip: float = 0.7, bits: int = 5) -> DataFrame:
    """shot, ratio, n: the mean ratio of each shot's samples to the next darker one's, over pixels that are neither clipped, nor zero, nor darker than 2^-bits in either. Rows need set_index, y, x, shot (0 to shots - 1, in ascending exposure) and v. One shuffle, with partial aggregation."""
    wide = pixels.groupBy("set_index", "y", "x").agg(*[F.max(F.when(F.col("shot") == k, F.col("v"))).alias(f"s{k}") for k in range(shots)])
    pairs = wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("shot"), F.col(f"s{k}").alias("v"), F.col(f"s{k - 1}").alias("darker")) for k in range(1, shots)])))
    level, dark = F.col("v") / float(WHITE), F.col("darker") / float(WHITE)
    floor = F.lit(2.0**-bits)
    good = pairs.where((level <= clip) & (F.col("v") != 0) & (F.col("darker") != 0) & (level > floor) & (dark > floor))
    return good.groupBy("shot").agg(F.avg(F.col("v") / F.col("darker")).alias("ratio"), F.count("*").alias("n"))


def ratio_sums(shots: list[np.ndarray], clip: float = 0.7, bits: int = 5) -> list[tuple[int, float, int]]:
    """(shot, sum of ratios, count) of whole frames, given in ascending exposure: what exposure_ratios averages."""
    out = []
    for k in range(1, len(shots)):
        v, dark = shots[k].astype(float), shots[k - 1].astype(float)
        good = (v / WHITE <= clip) & (v / WHITE > 2.0**-bits) & (dark / WHITE > 2.0**-bits)
        out.append((k, float((v[good] / dark[good]).sum()), int(good.sum())))
    return out


def refined(ratios: dict[int, float], multipliers: list[float], compat: bool = True) -> list[float]:
    """Multipliers from the mean ratios. With compat the product of the ratios so far also enters each new one, which counts earlier ratios twice from the fourth shot on; without it each is its ratio times the one before. Shots without a ratio give NaN."""
    out = [1 / multipliers[0] if compat else multipliers[0]]
    product = 1 / multipliers[0]
    for k in range(1, len(multipliers)):
        r = ratios.get(k, math.nan)
        out.append(product * r if compat else out[-1] * r)
        product *= out[-1] if compat else 1
    return out
