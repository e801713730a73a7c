"""Lin-log reduction with error diffusion.

A pixel's value depends on those before it, so a frame is one task's work; within it, pixels whose x + 2 y is equal don't depend on each other and are computed together. Incoming errors are added in the order in which a row-by-row scan would spread them, so results equal such a scan's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.curves import WHITE, linlog_parameter

#: Fixed values: (dx, dy, sixteenths) from where an error comes, in scan order.
PLAIN = ((-1, -1, 1), (0, -1, 5), (1, -1, 3), (-1, 0, 7))
SAME_COLOUR = ((-2, -2, 1), (0, -2, 5), (2, -2, 3), (-2, 0, 7))
GREEN = ((0, -2, 5), (-1, -1, 1), (1, -1, 3), (-2, 0, 7))


def diffused(frame: np.ndarray, a: float, pattern: tuple[int, ...] | None = None) -> np.ndarray:
    """Codes of a (height, width) frame. Without a pattern neighbours take the error; with one, the next pixels of the same colour (of green, diagonal ones too)."""
    h, w = frame.shape
    pad = 2
    error = np.zeros((h + 2 * pad, w + 2 * pad))
    out = np.zeros((h, w), np.uint16)
    scale = np.log(a + 1)
    rows = np.arange(h)
    for t in range(w + 2 * (h - 1)):
        y = rows[max(0, -(-(t - w + 1) // 2)) : t // 2 + 1]
        x = t - 2 * y
        v = frame[y, x].astype(float)
        if pattern is None:
            v = _gather(v, error, y, x, w, PLAIN, pad, 1)
        else:
            green = np.array(pattern)[(y % 2) * 2 + x % 2] == 1
            v = np.where(green, _gather(v, error, y, x, w, GREEN, pad, 2), _gather(v, error, y, x, w, SAME_COLOUR, pad, 2))
        code = np.clip(np.rint(np.log(a * np.maximum(v, 0) + 1) / scale), 0, WHITE)
        back = np.clip(np.rint(((a + 1) ** code - 1) / a), 0, WHITE)
        error[y + pad, x + pad] = v - back
        out[y, x] = code
    return out


def _gather(v: np.ndarray, error: np.ndarray, y: np.ndarray, x: np.ndarray, w: int, sources: tuple, pad: int, edge: int) -> np.ndarray:
    for dx, dy, share in sources:
        sx = x + dx
        # to the right, and right below, errors go only from pixels with `edge` more columns to their right
        ok = (sx < w - edge) if dx < 0 else sx >= 0
        v = v + np.where(ok & (sx >= 0) & (sx < w), error[y + dy + pad, np.clip(sx + pad, 0, w + 2 * pad - 1)] * share / 16, 0)
    return v


def dither(payload: Column | str, width: int, bits_in: int, bits_out: int, pattern: tuple[int, ...] | None = None) -> Column:
    """Little-endian uint16 payloads of frames to their codes, in the same form."""
    a = linlog_parameter(bits_in, bits_out)

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else diffused(np.frombuffer(x, "<u2").reshape(-1, width), a, pattern).astype("<u2").tobytes())

    return run(payload)


