"""Film-scan files of tagged values: (u32 tag, u32 length, bytes), with zero words as padding."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

from ..functions.cfa import BGGR, GBRG, GRBG, RGGB
from ..functions.frames import unpack
from ..operators.ljpeg import Damaged, decode_many

#: Names of tags.
TAGS = {
    1: "Header", 100: "FrameInfo", 101: "CodecType", 102: "CodecName", 103: "FrameData", 104: "Negative", 105: "FlipHorizontal", 106: "FlipVertical", 107: "FilmFrameRate", 108: "FilmType",
    109: "LinearMask", 110: "TimeCode", 111: "FilmGauge", 112: "LogMask", 113: "OffsetDetectedH", 114: "OffsetDetectedV", 115: "ExtendedRange", 116: "Keykode", 117: "StabilizerEnabledH", 118: "StabilizerEnabledV",
    119: "TileSizes", 120: "Gains", 121: "Lifts", 122: "HDRGains", 123: "OffsetToApplyH", 124: "OffsetToApplyV", 125: "SkewToApply", 1000: "Filler",
}
FRAME_INFO, FRAME_DATA, TILE_SIZES, OFFSET_H, OFFSET_V, FILLER = 100, 103, 119, 123, 124, 1000
#: Colour model -> (pattern, sample format).
MODELS = {45: (GRBG, "cri10"), 76: (BGGR, "12p"), 77: (GBRG, "12p"), 78: (RGGB, "12p"), 79: (GRBG, "12p"), 88: (BGGR, "dark16"), 89: (GBRG, "dark16"), 90: (RGGB, "dark16"), 91: (GRBG, "dark16")}
#: How values are said as text.
KINDS = {"ExtendedRange": "?", "StabilizerEnabledH": "?", "StabilizerEnabledV": "?", "FlipHorizontal": "?", "FlipVertical": "?", "Negative": "?", "Keykode": "Q", "TileSizes": "Q", "OffsetDetectedH": "H", "OffsetDetectedV": "H", "FilmFrameRate": "f", "OffsetToApplyH": "f", "OffsetToApplyV": "f", "SkewToApply": "f", "LinearMask": "f", "LogMask": "f", "Gains": "f", "Lifts": "f", "HDRGains": "f", "CodecType": "I", "FilmType": "B", "FilmGauge": "B"}
TEXTS = ("Header", "CodecName", "TimeCode")


def tags_of(read: Callable[[int, int], bytes], size: int, without: tuple[int, ...] = ()) -> list[tuple[int, bytes]]:
    """Tags in their order; read(n, at) gives n bytes from a place on, and values of tags `without` are stepped over unread. A tag that comes twice is an error; a value that breaks off is cut."""
    out, seen, at = [], set(), 0
    while at + 4 <= size:
        (tag,) = struct.unpack("<I", read(4, at))
        at += 4
        if not tag:
            continue
        if at + 4 > size:
            break
        (n,) = struct.unpack("<I", read(4, at))
        if tag in seen:
            raise Damaged(f"tag {tag} comes twice")
        seen.add(tag)
        if tag not in without:
            out.append((tag, read(min(n, size - at - 4), at + 4)))
        at += 4 + n
    return out


def tags(b: bytes, without: tuple[int, ...] = ()) -> list[tuple[int, bytes]]:
    return tags_of(lambda n, at: b[at : at + n], len(b), without)


def serialised(values: list[tuple[int, bytes]], without: tuple[int, ...] = (FRAME_DATA, FILLER)) -> bytes:
    return b"".join(struct.pack("<II", t, len(v)) + v for t, v in values if t not in without)


def info(values: dict[int, bytes]) -> tuple[int, int, tuple[int, ...], str]:
    """Width, height, pattern and sample format; an unknown colour model has no pattern and the format invalid."""
    if len(values.get(FRAME_INFO, b"")) < 12:
        raise Damaged("no whole FrameInfo")
    w, h, model = struct.unpack_from("<III", values[FRAME_INFO])
    pattern, kind = MODELS.get(model, ((), "invalid"))
    return w, h, pattern, kind


def text(values: list[tuple[int, bytes]]) -> str:
    """A line for each tag but frame data and filler: its name and what it says."""
    lines = ["tag,value"]
    for tag, v in values:
        if tag in (FRAME_DATA, FILLER):
            continue
        name = TAGS.get(tag, str(tag))
        if tag == FRAME_INFO:
            w, h, model, order = struct.unpack_from("<IIII", v.ljust(16, b"\0"))
            said = f"{w}x{h},{model},{order}"
        elif name in TEXTS:
            said = v.decode("utf-8", "replace")
        elif name in KINDS:
            size = struct.calcsize(KINDS[name])
            said = ",".join(f"{x:.9f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x) for (x,) in struct.iter_unpack("<" + KINDS[name], v[: len(v) // size * size]))
        else:
            said = f"({len(v)} bytes)"
        lines.append(f'{name},"{said}"')
    return "\n".join(lines) + "\n"


def offsets(read: Callable[[int, int], bytes], size: int) -> tuple[float, float]:
    """The stabilisation offsets alone. read(n, at) gives n bytes from a place on; values of other tags are stepped over unread, and nothing is read after both are found."""
    found, at = {}, 0
    while at + 8 <= size and len(found) < 2:
        tag, n = struct.unpack("<II", read(8, at))
        if not tag:
            at += 4
            continue
        if tag in (OFFSET_H, OFFSET_V) and n >= 4 and at + 12 <= size:
            (found[tag],) = struct.unpack("<f", read(4, at + 8))
        at += 8 + n
    return found.get(OFFSET_H, 0.0), found.get(OFFSET_V, 0.0)


def frame(b: bytes, name: str = "") -> tuple[np.ndarray, list[dict], list[tuple[int, bytes]]]:
    """(height, width) high-aligned samples, errors, tags. Of a damaged file what can be had, and errors that say so."""
    values = tags(b)
    by = dict(values)
    if FRAME_DATA not in by:
        raise Damaged("no frame data")
    w, h, _, kind = info(by)
    data, errors = by[FRAME_DATA], []
    if TILE_SIZES not in by:
        if kind == "invalid":
            raise Damaged("an unknown colour model")
        v = unpack(data[: len(data) // {"12p": 3, "cri10": 16, "dark16": 2}[kind] * {"12p": 3, "cri10": 16, "dark16": 2}[kind]], kind)
        out = np.zeros(w * h, np.uint16)
        out[: len(v)] = v[: w * h]
        if len(v) < w * h:
            errors.append(_rescue(name, f"{w * h - len(v)} samples at the end are missing"))
        return out.reshape(h, w), errors, values

    def say(what: str) -> None:
        errors.append(_rescue(name, what))

    out, at, left = np.zeros((h, w), np.uint16), 0, 0
    parts = []
    for (size,) in struct.iter_unpack("<Q", by[TILE_SIZES][: len(by[TILE_SIZES]) // 8 * 8]):
        if at >= len(data):
            say(f"the tile at {at} is missing; so is that part of the image")
            break
        short = at + size > len(data)
        if short:
            say(f"the tile at {at} is partly missing; what is left of it was tried")
        parts.append((data[at : at + size], short))
        at += size
    for (_, short), tile in zip(parts, decode_many([p for p, _ in parts])):
        if isinstance(tile, Damaged):
            if not short:
                raise tile
            say(f"what was left of a tile could not be read to its end: {tile}")
            if tile.partial is None:
                break
            tile = tile.partial
        # a tile's rows hold two rows of the image each
        tile = tile.reshape(tile.shape[0] * 2, -1)
        rows, cols = min(h, tile.shape[0]), min(w - left, tile.shape[1])
        out[:rows, left : left + cols] = tile[:rows, :cols]
        left += tile.shape[1]
    return out, errors, values


def _rescue(name: str, what: str) -> dict:
    return {"code": "ORIGINAL_FILE_PARTIALLY_CORRUPTED_RESCUE", "severity": "SEVERE", "description": f"Damaged file: {what}.", "filename": name, "data": b""}
