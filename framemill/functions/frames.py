"""Codecs of whole frames: bytes to and from 16-bit little-endian, high-aligned linear samples, as numpy and as Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("bright16", "dark16", "12p", "12p_v2", "10p", "cri10")


def _bytes(b: bytes, group: int, name: str) -> np.ndarray:
    if len(b) % group:
        raise ValueError(f"{name} needs a multiple of {group} bytes, not {len(b)}")
    return np.frombuffer(b, np.uint8).reshape(-1, group).astype(np.uint16)


def unpack(b: bytes, kind: str, pixels: int | None = None) -> np.ndarray:
    """Samples of a payload; `pixels` cuts what padding adds."""
    if kind in ("bright16", "dark16"):
        v = np.frombuffer(b, "<u2")
        v = v << np.uint16(4) if kind == "dark16" else v
    elif kind in ("12p", "12p_v2"):
        x = _bytes(b, 3, kind)
        first = x[:, 0] | (x[:, 1] & 15) << 8 if kind == "12p" else x[:, 0] << 4 | x[:, 1] & 15
        v = np.stack([first, x[:, 2] << 4 | x[:, 1] >> 4], axis=1).ravel() << 4
    elif kind == "10p":
        x = _bytes(b, 5, kind)
        v = np.stack([(x[:, k] << 2 | x[:, 4] >> 2 * k & 3) << 6 for k in range(4)], axis=1).ravel()
    elif kind == "cri10":
        v = unpack_cri10(b)
    else:
        raise ValueError(f"unknown sample format {kind!r}; known: {', '.join(FORMATS)}")
    return v.astype(np.uint16) if pixels is None else v[:pixels].astype(np.uint16)


def unpack_cri10(b: bytes) -> np.ndarray:
    """16 bytes to 9 samples: every 32-bit word carries three runs of 9 bits, at 0, 10 and 20; the 12 runs of a group, least significant bits first, are nine 12-bit values."""
    words = np.frombuffer(b[: len(b) // 16 * 16], "<u4").reshape(-1, 4)
    runs = np.stack([words >> s & 0x1FF for s in (0, 10, 20)], axis=2).reshape(-1, 12)
    bits = (runs[:, :, None] >> np.arange(9) & 1).reshape(-1, 9, 12)
    return ((bits << np.arange(12)).sum(axis=2) << 4).astype(np.uint16).ravel()


def pack_cri10(v: np.ndarray) -> bytes:
    """The inverse of unpack_cri10 for a multiple of 9 samples."""
    bits = ((v.astype(np.uint32) >> 4)[:, None] >> np.arange(12) & 1).reshape(-1, 12, 9)
    runs = (bits << np.arange(9)).sum(axis=2).reshape(-1, 4, 3).astype(np.uint32)
    return (runs << np.array([0, 10, 20], np.uint32)).sum(axis=2).astype("<u4").tobytes()


def pack_12(v: np.ndarray) -> bytes:
    """High-aligned samples, an even number, to 12 bits each, most significant first."""
    a, b = (v[0::2] >> 4).astype(np.uint16), (v[1::2] >> 4).astype(np.uint16)
    if len(a) != len(b):
        raise ValueError("12-bit packing takes an even number of samples")
    return np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], axis=1).astype(np.uint8).tobytes()


def linear(payload: Column | str, kind: str) -> Column:
    """A payload column as little-endian uint16 bytes, high-aligned."""

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else unpack(x, kind).astype("<u2").tobytes())

    return run(payload)
