"""As much of TIFF 6.0 and DNG as one-channel raw images need."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from ..functions.frames import unpack
from ..operators.ljpeg import Damaged, decode_many, encode_frame, tiled

#: Bytes and struct codes of the field types.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}
BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SRATIONAL, FLOAT = 1, 2, 3, 4, 5, 7, 10, 11
#: Tag numbers of TIFF and DNG.
SUBFILE, WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, MAKE, MODEL, STRIP_OFFSETS, ORIENTATION, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, SOFTWARE = 254, 256, 257, 258, 259, 262, 271, 272, 273, 274, 277, 278, 279, 284, 305
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SUB_IFDS, CFA_DIM, CFA = 322, 323, 324, 325, 330, 33421, 33422
DNG_VERSION, DNG_BACKWARD, CAMERA, LINEARIZATION, WHITE_LEVEL, MATRIX1, NEUTRAL, BASELINE_EXPOSURE, PRIVATE, ILLUMINANT1, ORIGINAL_NAME = 50706, 50707, 50708, 50712, 50717, 50721, 50728, 50730, 50740, 50778, 50827
NONE, LJPEG, DEFLATE = 1, 7, 8
CFA_PHOTOMETRIC = 32803
D65 = 21
#: XYZ to linear sRGB.
XYZ_TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


class Tiff:
    """Reads tags of a file's directories."""

    def __init__(self, b: bytes):
        self.b = b
        if b[:2] not in (b"II", b"MM") or len(b) < 8:
            raise Damaged("not a TIFF file")
        self.order = "<" if b[:2] == b"II" else ">"
        magic, first = self.unpack("HI", 2)
        if magic != 42:
            raise Damaged("not a TIFF file")
        self.first = self.directory(first)

    def unpack(self, code: str, at: int) -> tuple:
        try:
            return struct.unpack_from(self.order + code, self.b, at)
        except struct.error as e:
            raise Damaged(f"the file ends before {at}: {e}") from e

    def directory(self, at: int) -> dict[int, tuple]:
        (n,) = self.unpack("H", at)
        out = {}
        for k in range(n):
            tag, kind, count = self.unpack("HHI", at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            size, code = TYPES[kind]
            place = at + 10 + 12 * k
            if size * count > 4:
                (place,) = self.unpack("I", place)
            if kind in (BYTE, UNDEFINED, ASCII):
                v = self.b[place : place + count]
                out[tag] = (v.rstrip(b"\0").decode("utf-8", "replace"),) if kind == ASCII else tuple(v) if count <= 64 else (v,)
            else:
                if place + size * count > len(self.b):
                    raise Damaged(f"the values of tag {tag} are cut off")
                v = self.unpack(code * count, place)
                out[tag] = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])) if len(code) == 2 else v
        return out

    def raw(self) -> dict[int, tuple]:
        """The directory that holds the raw image: the first sub-directory with a colour pattern, the first one, or the file's own."""
        subs = [self.directory(at) for at in self.first.get(SUB_IFDS, ())]
        return next((d for d in subs if CFA in d), subs[0] if subs and CFA not in self.first else self.first)


@dataclass
class Header:
    width: int
    height: int
    cfa: tuple[int, ...]
    format: str  # bright16, dark16, packed12 or invalid
    bits: int


def header(t: Tiff) -> Header:
    d = t.raw()
    bits = d.get(BITS, (16,))[0]
    exposure = round(t.first.get(BASELINE_EXPOSURE, (0.0,))[0])
    kind = "invalid"
    if bits == 12:
        kind = "packed12"
    elif bits == 16 and (exposure == 4 or d.get(WHITE_LEVEL, (0,))[0] == 4095):
        kind = "dark16"
    elif bits == 16 and exposure == 0:
        kind = "bright16"
    return Header(d[WIDTH][0], d[LENGTH][0], tuple(d.get(CFA, ()))[:4], kind, bits)


def samples(t: Tiff) -> np.ndarray:
    """The raw image as stored, (height, width) uint16; 12-bit packed samples come high-aligned."""
    d = t.raw()
    w, h, bits, how = d[WIDTH][0], d[LENGTH][0], d.get(BITS, (16,))[0], d.get(COMPRESSION, (NONE,))[0]

    def parts(places: tuple, sizes: tuple, width: int) -> list[np.ndarray]:
        raw = [t.b[at : at + n] for at, n in zip(places, sizes)]
        if how != LJPEG:
            return [part(b, width) for b in raw]
        found = decode_many(raw)
        for v in found:
            if isinstance(v, Damaged):
                raise v
        return [v.reshape(v.shape[0], -1) for v in found]

    def part(b: bytes, width: int) -> np.ndarray:
        if how in (DEFLATE, 32946):
            try:
                b = zlib.decompress(b)
            except zlib.error as e:
                raise Damaged(f"a strip can't be inflated: {e}") from e
        elif how != NONE:
            raise Damaged(f"compression {how} isn't known")
        if bits == 12:
            x = np.frombuffer(b, np.uint8).astype(np.uint16).reshape(-1, 3)
            v = np.stack([x[:, 0] << 4 | x[:, 1] >> 4, (x[:, 1] & 15) << 8 | x[:, 2]], axis=1).ravel() << 4
        else:
            v = np.frombuffer(b, t.order + "u2").astype(np.uint16)
        return v.reshape(-1, width)

    if TILE_OFFSETS not in d:
        v = np.concatenate(parts(d[STRIP_OFFSETS], d[STRIP_BYTES], w))
        if v.shape[0] < h:
            raise Damaged(f"{v.shape[0]} rows where {h} are due")
        return v[:h]
    tw, th = d[TILE_WIDTH][0], d[TILE_LENGTH][0]
    across = -(-w // tw)
    out = np.zeros((-(-h // th) * th, across * tw), np.uint16)
    for i, v in enumerate(parts(d[TILE_OFFSETS], d[TILE_BYTES], tw)):
        y, x = i // across * th, i % across * tw
        out[y : y + th, x : x + tw] = v.reshape(th, tw)
    return out[:h, :w]


def linear(t: Tiff) -> np.ndarray:
    """The raw image, high-aligned and linear."""
    v, d = samples(t), t.raw()
    if LINEARIZATION in d:
        table = np.array(d[LINEARIZATION], np.uint16)
        v = table[np.minimum(v, len(table) - 1)]
    return (v << np.uint16(4)).astype(np.uint16) if header(t).format == "dark16" else v


@dataclass
class Image:
    """What a DNG file is made from. pixels: (height, width) uint16 as they are to be stored, high-aligned for packing."""

    pixels: np.ndarray
    cfa: tuple[int, ...]
    encoding: str = "ljpeg_tiles"  # strip, deflate, ljpeg or ljpeg_tiles
    packed12: bool = False
    tile: int = 192
    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)
    make: str = ""
    model: str = ""
    camera: str = "framemill"
    software: str = ""
    original_name: str = ""
    baseline_exposure: float | None = None
    table: np.ndarray | None = None
    private: bytes = b""
    more: dict[int, tuple[int, tuple]] = field(default_factory=dict)


def dng(image: Image) -> bytes:
    """A DNG file with one directory. Packed samples are never compressed. Gains are said by the colour matrix and the neutral; samples stay as they are."""
    h, w = image.pixels.shape
    encoding = "strip" if image.packed12 else image.encoding
    tags: dict[int, tuple[int, tuple | bytes]] = {
        SUBFILE: (LONG, (0,)), WIDTH: (LONG, (w,)), LENGTH: (LONG, (h,)), BITS: (SHORT, (12 if image.packed12 else 16,)), PHOTOMETRIC: (SHORT, (CFA_PHOTOMETRIC,)),
        ORIENTATION: (SHORT, (1,)), SAMPLES: (SHORT, (1,)), PLANAR: (SHORT, (1,)), CFA_DIM: (SHORT, (2, 2)), CFA: (BYTE, bytes(image.cfa)),
        DNG_VERSION: (BYTE, bytes([1, 4, 0, 0])), DNG_BACKWARD: (BYTE, bytes([1, 4, 0, 0])), ILLUMINANT1: (SHORT, (D65,)),
        MATRIX1: (SRATIONAL, tuple(x / g for row, g in zip(XYZ_TO_SRGB, image.gains) for x in row)), NEUTRAL: (RATIONAL, tuple(1 / g for g in image.gains)),
    }
    own = "framemill"
    for tag, text in ((MAKE, image.make), (MODEL, image.model), (CAMERA, image.camera), (SOFTWARE, f"{image.software}(+{own})" if image.software.strip() else own), (ORIGINAL_NAME, image.original_name)):
        tags[tag] = (ASCII, text.encode() + b"\0")
    if image.baseline_exposure is not None:
        tags[BASELINE_EXPOSURE] = (SRATIONAL, (image.baseline_exposure,))
    if image.table is not None:
        tags[LINEARIZATION] = (SHORT, tuple(int(x) for x in image.table))
    if image.private:
        tags[PRIVATE] = (BYTE, image.private)
    tags |= image.more

    if encoding == "ljpeg_tiles":
        parts = [encode_frame(t) for _, _, t in tiled(image.pixels, image.tile)]
        tags |= {TILE_WIDTH: (LONG, (image.tile,)), TILE_LENGTH: (LONG, (image.tile,)), COMPRESSION: (SHORT, (LJPEG,))}
        places, sizes = TILE_OFFSETS, TILE_BYTES
    else:
        if image.packed12:
            from ..functions.frames import pack_12

            data = pack_12(image.pixels.ravel())
        else:
            data = image.pixels.astype("<u2").tobytes()
        if encoding == "deflate":
            data = zlib.compress(data)
        elif encoding == "ljpeg":
            data = encode_frame(image.pixels)
        elif encoding != "strip":
            raise ValueError(f"unknown encoding {encoding!r}")
        parts = [data]
        tags |= {ROWS_PER_STRIP: (LONG, (h,)), COMPRESSION: (SHORT, ({"strip": NONE, "deflate": DEFLATE, "ljpeg": LJPEG}[encoding],))}
        places, sizes = STRIP_OFFSETS, STRIP_BYTES
    tags[sizes] = (LONG, tuple(len(p) for p in parts))
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p) + len(p) % 2
    tags[places] = (LONG, tuple(offsets))
    return b"II" + struct.pack("<HI", 42, at) + b"".join(p + b"\0" * (len(p) % 2) for p in parts) + _directory(tags, at)


def _directory(tags: dict[int, tuple], at: int) -> bytes:
    entries, heap = [], b""
    beyond = at + 2 + 12 * len(tags) + 4
    for tag in sorted(tags):
        kind, v = tags[tag]
        if isinstance(v, bytes):
            data, count = v, len(v)
        elif kind in (RATIONAL, SRATIONAL):
            data, count = b"".join(struct.pack("<ii" if kind == SRATIONAL else "<II", round(x * 1_000_000), 1_000_000) for x in v), len(v)
        else:
            data, count = struct.pack("<" + TYPES[kind][1] * len(v), *v), len(v)
        if len(data) > 4:
            entries.append(struct.pack("<HHII", tag, kind, count, beyond + len(heap)))
            heap += data + b"\0" * (len(data) % 2)
        else:
            entries.append(struct.pack("<HHI", tag, kind, count) + data.ljust(4, b"\0"))
    return struct.pack("<H", len(tags)) + b"".join(entries) + struct.pack("<I", 0) + heap


def unpacked(b: bytes, kind: str, width: int, height: int) -> np.ndarray:
    """A payload of one of functions.frames.FORMATS as a (height, width) frame."""
    v = unpack(b, kind)
    if len(v) < width * height:
        raise Damaged(f"{len(v)} samples where {width} x {height} are due")
    return v[: width * height].reshape(height, width)
