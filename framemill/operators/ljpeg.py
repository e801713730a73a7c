"""Lossless JPEG (ITU-T T.81, process 14): Huffman-coded differences to a predictor.

Differences, categories, code lengths and bits are array operations over blocks of rows. Decoding walks from code to code in many streams at once (tiles, restart intervals, frames of a batch), a step of all of them being a few array operations; a single long stream is walked from many places at once, and the walks are joined where they meet. Predictors are sums along rows, columns or diagonals. Tiles don't depend on each other, so frames times tiles run in parallel.

Two forms outside of T.81's lossless process are known: half-size raw of some cameras (three components, the first with two columns and one or two rows for each sample of the others), and pairs of columns (predictor 8), whose codes come before their bits, in words of four bytes, least significant first, without stuffing.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 16
#: Samples that are encoded at a time.
BLOCK = 1 << 20
#: Streams from which on they are walked together; samples from which on a stream is walked from many places.
TOGETHER, LONG = 16, 1 << 17
#: Bits of a long stream that are walked at a time, and from one place to the next.
STRETCH, SEGMENT = 1 << 24, 1 << 15
#: Bits that the magnitude of a 16-bit difference takes, 16 for -32768.
CATEGORY = np.array([min(d, 65536 - d).bit_length() for d in range(65536)], np.uint8)


# -- encoding ---------------------------------------------------------------


def differences(samples: np.ndarray, bits: int, first: int = 0, last: int | None = None, predictor: int = 1) -> np.ndarray:
    """Of rows first to last of (rows, columns, components) samples to what predicts them: by default the left ones; the first column's to those above, the first ones' to half the range. They are taken modulo 2^16, in -32768 to 32767."""
    v = samples[first:last].astype(np.int32)
    above = samples[first - 1 : first].astype(np.int32) if first else v[:0]
    up = np.concatenate([above, v[:-1]])
    d = np.empty_like(v)
    d[:, 1:] = v[:, 1:] - v[:, :-1]
    d[len(v) - len(up) :, 0] = v[len(v) - len(up) :, 0] - up[:, 0]
    if not first:
        d[0, 0] = v[0, 0] - (1 << (bits - 1))
    if predictor != 1 and len(up):
        x, a, b, c = v[len(v) - len(up) :, 1:], v[len(v) - len(up) :, :-1], up[:, 1:], up[:, :-1]
        guess = {2: lambda: b, 3: lambda: c, 4: lambda: a + b - c, 5: lambda: a + (b - c >> 1), 6: lambda: b + (a - c >> 1), 7: lambda: a + b >> 1}[predictor]()
        d[len(v) - len(up) :, 1:] = x - guess
    return (d + 32768 & 0xFFFF) - 32768


def categories(d: np.ndarray) -> np.ndarray:
    """Bits that a difference's magnitude takes; 16 for -32768."""
    return CATEGORY[d & 0xFFFF]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most 16 bits for each category (0: not used), leaving the all-ones code free. If the best code has longer ones, all 17 categories get equal ones of 5 bits."""
    used = np.flatnonzero(counts)
    heap = [(int(counts[s]), -int(s), (int(s),)) for s in used] + [(1, -1_000, (-1,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([-1, *used.tolist()], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    out = np.zeros(17, np.int64)
    for s, n in depth.items():
        if s >= 0:
            out[s] = n
    return np.full(17, 5) if out.max() > LONGEST else _canonical(out, depth[-1])


def _canonical(lengths: np.ndarray, spare: int) -> np.ndarray:
    """The same lengths, dealt so that the spare symbol's code is the last of the longest: the longest symbol changes places with it."""
    longest = int(lengths.max(initial=0))
    if spare < longest:
        s = int(np.flatnonzero(lengths == longest)[-1])
        lengths = lengths.copy()
        lengths[s] = spare if spare else longest
    return lengths


def table_of(lengths: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """(codes of each length 1 to 16, symbols in order of codes, code of each symbol)."""
    symbols = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
    counts = [int((lengths == n).sum()) for n in range(1, LONGEST + 1)]
    codes, code, last = np.zeros(17, np.int64), 0, 0
    for s in symbols:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return counts, symbols, codes


def encode(samples: np.ndarray, bits: int = 16, predictor: int = 1, restart: int = 0) -> bytes:
    """A (rows, columns, components) array of samples of `bits` bits. Holds BLOCK samples' bits at a time, besides samples and result. restart: rows after which prediction starts anew behind a marker, if any."""
    h, w, n = samples.shape
    band = restart or h
    step = max(1, BLOCK // max(1, w * n))
    blocks = [(top, y, min(y + step, top + band, h)) for top in range(0, h, band) for y in range(top, min(top + band, h), step)]
    used = np.zeros((n, 17), np.int64)
    for top, y, end in blocks:
        cat = categories(differences(samples[top:], bits, y - top, end - top, predictor))
        for c in range(n):
            used[c] += np.bincount(cat[..., c].ravel(), minlength=17)
    lengths, codes, tables = np.zeros((n, 17), np.int64), np.zeros((n, 17), np.int64), []
    for c in range(n):
        lengths[c] = code_lengths(used[c])
        counts, symbols, codes[c] = table_of(lengths[c])
        tables.append(bytes([c, *counts, *symbols]))
    intervals: list[list[bytes]] = []
    left = filled = 0
    for top, y, end in blocks:
        if y == top:
            intervals.append([])
        flat = differences(samples[top:], bits, y - top, end - top, predictor)
        which = np.broadcast_to(np.arange(n), flat.shape).ravel()
        flat = flat.ravel()
        k = categories(flat).astype(np.int64)
        extra = np.where(k == 16, 0, k)
        word = codes[which, k] << extra | np.where(flat < 0, flat - 1, flat) & ((1 << extra) - 1)
        part, left, filled = _packed(word, lengths[which, k] + extra, left, filled)
        intervals[-1].append(part)
        if filled and end in (top + band, h):
            intervals[-1].append(bytes([left | 0xFF >> filled]))
        if end in (top + band, h):
            left = filled = 0
    data = [b"".join(parts).replace(b"\xff", b"\xff\x00") for parts in intervals]
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    frame = struct.pack(">BHHB", bits, h, w, n) + b"".join(bytes([c, 0x11, 0]) for c in range(n))
    scan = bytes([n]) + b"".join(bytes([c, c << 4]) for c in range(n)) + bytes([predictor, 0, 0])
    head = b"\xff\xd8" + segment(0xC3, frame) + b"".join(segment(0xC4, t) for t in tables)
    if restart:
        head += segment(0xDD, struct.pack(">H", restart * w))
    return head + segment(0xDA, scan) + b"".join(d + (bytes([0xFF, 0xD0 + k % 8]) if k < len(data) - 1 else b"") for k, d in enumerate(data)) + b"\xff\xd9"


def _coded(d: np.ndarray, table: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables for differences of which each uses one; and each difference's code, its size, its bits and their number."""
    k = categories(d).astype(np.int64)
    tables, code, size = [], np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
    for t in range(int(table.max()) + 1):
        own = table == t
        lengths = code_lengths(np.bincount(k[own], minlength=17))
        counts, symbols, codes = table_of(lengths)
        tables.append(bytes([t, *counts, *symbols]))
        code[own], size[own] = codes[k[own]], lengths[k[own]]
    extra = np.where(k == 16, 0, k)
    return tables, code, size, np.where(d < 0, d - 1, d) & ((1 << extra) - 1), extra


def _stream(bits: int, h: int, w: int, sampling: list[int], tables: list[bytes], use: list[int], predictor: int, data: bytes) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    frame = struct.pack(">BHHB", bits, h, w, len(sampling)) + b"".join(bytes([c, f, 0]) for c, f in enumerate(sampling))
    scan = bytes([len(sampling)]) + b"".join(bytes([c, t << 4]) for c, t in enumerate(use)) + bytes([predictor, 0, 0])
    return b"\xff\xd8" + segment(0xC3, frame) + b"".join(segment(0xC4, t) for t in tables) + segment(0xDA, scan) + data + b"\xff\xd9"


def _wrapped(d: np.ndarray) -> np.ndarray:
    return (d.astype(np.int64) + 32768 & 0xFFFF) - 32768


def encode_half_size(first: np.ndarray, others: np.ndarray, rows: int = 1, bits: int = 15) -> bytes:
    """Half-size raw: (height, width) samples, and (height / rows, width / 2, 2) of the other components."""
    h, w = first.shape
    blocks = first.reshape(h // rows, rows, w // 2, 2).transpose(0, 2, 1, 3).reshape(h // rows, w // 2, 2 * rows)
    v = [blocks.reshape(h // rows, -1), others[..., 0], others[..., 1]]
    d = [_wrapped(np.diff(x.astype(np.int64), axis=1, prepend=np.concatenate([[[1 << 14]], x[:-1, :1].astype(np.int64)]))) for x in v]
    units = np.concatenate([d[0].reshape(h // rows, w // 2, 2 * rows), d[1][..., None], d[2][..., None]], axis=2)
    table = np.broadcast_to(np.array([0] * (2 * rows) + [1, 2]), units.shape).ravel()
    tables, code, size, low, extra = _coded(units.ravel(), table)
    data, left, filled = _packed(code << extra | low, size + extra, 0, 0)
    data += bytes([left | 0xFF >> filled]) if filled else b""
    return _stream(bits, h, w, [0x20 | rows, 0x11, 0x11], tables, [0, 1, 2], 1, data.replace(b"\xff", b"\xff\x00"))


def encode_pairs(frame: np.ndarray, bits: int = 16) -> bytes:
    """Pairs of columns (predictor 8) of a (height, width) frame of even width."""
    h, w = frame.shape
    v = frame.reshape(h, w // 2, 2).astype(np.int64)
    d = _wrapped(np.diff(v, axis=1, prepend=np.full((h, 1, 2), 32768))).ravel()
    tables, code, size, low, extra = _coded(d, np.zeros(len(d), np.int64))
    word = np.stack([code[::2], code[1::2], low[::2], low[1::2]], axis=1).ravel()
    size = np.stack([size[::2], size[1::2], extra[::2], extra[1::2]], axis=1).ravel()
    data, left, filled = _packed(word[size > 0], size[size > 0], 0, 0)
    data += bytes([left | 0xFF >> filled]) if filled else b""
    data += b"\xff" * (-len(data) % 4)
    return _stream(bits, h, w, [0x11], tables, [0], 8, np.frombuffer(data, "<u4").astype(">u4").tobytes())


def _packed(word: np.ndarray, size: np.ndarray, left: int, filled: int) -> tuple[bytes, int, int]:
    """Words of `size` bits each (31 at most), most significant first, end to end behind `filled` bits of a byte `left`: whole bytes, and the byte that is left with its bits."""
    ends = np.cumsum(size) + filled
    start, total = ends - size, int(ends[-1])
    value = word.astype(np.uint64) << (64 - size - (start & 7)).astype(np.uint64)
    at, out = start >> 3, np.zeros((total >> 3) + 6)
    for j in range(5):
        out += np.bincount(at + j, (value >> np.uint64(56 - 8 * j) & np.uint64(255)).astype(float), len(out))
    out = out.astype(np.uint8)
    out[0] |= left
    return out[: total >> 3].tobytes(), int(out[total >> 3]), total & 7


# -- decoding ---------------------------------------------------------------


class Damaged(ValueError):
    """The data end or break off; `partial` has what was decoded, with zeros after it."""

    def __init__(self, what: str, partial: np.ndarray | None = None):
        super().__init__(what)
        self.partial = partial


class Huffman:
    """A table: of each code length the first code beyond it and the first of it (both with 16 bits), and for each 8 bits ahead length | category << 5, 0 where codes are longer or none."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.limit, self.first, self.offset = np.zeros(18, np.int64), np.zeros(18, np.int64), np.zeros(18, np.int64)
        code, at = 0, 0
        for n in range(1, LONGEST + 1):
            self.first[n], self.offset[n] = code << (LONGEST - n), at
            code, at = code + counts[n - 1], at + counts[n - 1]
            self.limit[n] = code << (LONGEST - n)
            code <<= 1
        if self.limit.max() > 1 << LONGEST or len(symbols) < at or max(symbols[:at], default=0) > 16:
            raise Damaged("a Huffman table isn't one")
        self.symbols = np.frombuffer(symbols[:at] + bytes(256 - at), np.uint8)
        self.fast = self.look(np.arange(256) << 8, 8)
        self.quick = self.fast.tolist()

    def look(self, ahead: np.ndarray, longest: int = LONGEST) -> np.ndarray:
        """length | category << 5 of the code that 16 bits begin with; 0 if there is none of at most `longest` bits."""
        n = 1 + (ahead[:, None] >= self.limit[1 : LONGEST + 1]).sum(axis=1)
        at = self.offset[n] + (ahead - self.first[n] >> np.maximum(LONGEST - n, 0))
        return np.where(n <= longest, n | self.symbols[np.clip(at, 0, 255)].astype(np.int64) << 5, 0)


@lru_cache(512)
def huffman(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


@dataclass
class Scan:
    bits: int
    height: int
    width: int
    tables: list[Huffman]  # of each component
    predictor: int
    shift: int
    restart: int
    data: bytes
    rows: int = 0  # of half-size raw: rows of the first component for one of the others

    @property
    def components(self) -> int:
        return len(self.tables)


def parse(b: bytes) -> Scan:
    """The first scan of a stream, undecoded."""
    if b[:2] != b"\xff\xd8":
        raise Damaged("no start of image")
    at, tables, frame, restart, rows = 2, {}, None, 0, 0
    try:
        while at + 4 <= len(b):
            if b[at] != 0xFF:
                raise Damaged(f"no marker at {at}")
            marker = b[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", b, at + 2)[0]
            body = b[at + 4 : at + 2 + size]
            at += 2 + size
            if marker in (0xC0, 0xC1, 0xC3):
                bits, h, w, n = struct.unpack_from(">BHHB", body)
                sampling = [body[7 + 3 * c] for c in range(n)]
                half = n == 3 and sampling[0] in (0x21, 0x22) and sampling[1:] == [0x11, 0x11] and not w % 2 and not h % (sampling[0] & 15)
                if not 2 <= bits <= 16 or not half and any(f != 0x11 for f in sampling):
                    raise Damaged("only 2 to 16 bits, and components that aren't subsampled but for half-size raw, are known")
                frame, rows = (bits, h, w, [body[6 + 3 * c] for c in range(n)]), sampling[0] & 15 if half else 0
            elif marker == 0xC4:
                while body:
                    total = sum(body[1:17])
                    if body[0] & 15 > 3:
                        raise Damaged("a Huffman table has a number over 3")
                    tables[body[0] & 15] = huffman(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                if frame is None:
                    raise Damaged("a scan without a frame")
                bits, h, w, names = frame
                use = {body[1 + 2 * c]: body[2 + 2 * c] >> 4 for c in range(body[0])}
                predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
                if predictor > 8 or predictor == 8 and (len(names) > 1 or w % 2) or shift >= bits:
                    raise Damaged("a predictor or a shift that there isn't")
                if restart and (restart % max(w, 1) or rows or predictor == 8):
                    raise Damaged("a restart interval isn't whole rows")
                return Scan(bits, h, w, [tables[use[c]] for c in names], predictor, shift, restart, b[at:], rows)
            elif marker == 0xD9:
                break
    except (IndexError, KeyError, struct.error) as e:
        raise Damaged(f"a marker is damaged: {e!r}") from e
    raise Damaged("no scan")


@dataclass
class Stream:
    """An entropy-coded segment: bytes without stuffing, and how many samples are due."""

    part: bytes
    tables: list[Huffman]
    count: int


def _streams(scan: Scan) -> tuple[list[Stream], str]:
    """The restart intervals that are there, in turn, and what is wrong with the next one."""
    out, left, n = [], scan.height * scan.width, scan.components
    if scan.predictor == 8:
        return [], ""
    if scan.rows:
        slots = [scan.tables[0]] * (2 * scan.rows) + scan.tables[1:]
        return [Stream(next(_intervals(scan.data))[0], slots, left // (2 * scan.rows) * len(slots))], ""
    for part, number in _intervals(scan.data):
        if number is not None and scan.restart and number != (len(out) - 1) % 8:
            return out, "a restart marker is out of turn"
        count = min(scan.restart or left, left)
        out.append(Stream(part, scan.tables, count * n))
        left -= count
        if not left:
            return out, ""
    return out, "the data end early"


def decode_many(streams: list[bytes]) -> list[np.ndarray | Damaged]:
    """(rows, columns, components) samples of each stream, or what is wrong with it."""
    out: list = [None] * len(streams)
    scans, todo = {}, []
    for i, b in enumerate(streams):
        try:
            scans[i] = parse(b)
        except Damaged as e:
            out[i] = e
    parts = {i: _streams(s) for i, s in scans.items()}
    todo = [s for i in parts for s in parts[i][0]]
    found = iter(_all_differences(todo))
    for i, scan in scans.items():
        got = [next(found) for _ in parts[i][0]]
        out[i] = _pairs(scan) if scan.predictor == 8 else _half_size(scan, got[0]) if scan.rows else _image(scan, got, parts[i][1])
    return out


def decode(b: bytes) -> np.ndarray:
    """(rows, columns, components) samples. Raises Damaged where the data do not suffice."""
    (got,) = decode_many([b])
    if isinstance(got, Damaged):
        raise got
    return got


def _image(scan: Scan, parts: list[np.ndarray], wrong: str) -> np.ndarray | Damaged:
    h, w, n = scan.height, scan.width, scan.components
    out, rows, done = np.zeros((h, w, n), np.int64), scan.restart // w if scan.restart else h, 0
    for k, d in enumerate(parts):
        band = out[k * rows : (k + 1) * rows]
        full = np.zeros(band.size, np.int64)
        full[: len(d)] = d
        band[:] = _predicted(full.reshape(band.shape), scan.predictor, 1 << (scan.bits - scan.shift - 1))
        done = k * rows * w + len(d) // n
        if len(d) < band.size:
            wrong = "the data end early"
            break
    out = (out << scan.shift).astype(np.uint16)
    if done < h * w:
        out.reshape(-1, n)[done:] = 0
        return Damaged(wrong or "the data end early", out)
    return out


def _half_size(scan: Scan, d: np.ndarray) -> np.ndarray | Damaged:
    """(rows, columns, 3) samples of half-size raw, the other components' repeated. Each row of blocks begins at the first sample of the one before."""
    h, w, rows, per = scan.height, scan.width, scan.rows, 2 * scan.rows + 2
    full = np.zeros(h // rows * (w // 2) * per, np.int64)
    full[: len(d)] = d
    units = full.reshape(h // rows, w // 2, per)

    def chain(x: np.ndarray) -> np.ndarray:
        x = x.reshape(h // rows, -1).copy()
        x[:, 0] = (1 << 14) + np.cumsum(x[:, 0])
        return np.cumsum(x, axis=1) & 0xFFFF

    first = chain(units[..., : 2 * rows]).reshape(h // rows, w // 2, rows, 2).transpose(0, 2, 1, 3).reshape(h, w)
    out = np.stack([first, *(np.repeat(np.repeat(chain(units[..., k]), rows, axis=0), 2, axis=1) for k in (2 * rows, 2 * rows + 1))], axis=2).astype(np.uint16)
    if len(d) < len(full):
        out[len(d) // (per * (w // 2)) * rows :] = 0
        return Damaged("the data end early", out)
    return out


def _pairs(scan: Scan) -> np.ndarray | Damaged:
    """Samples of pairs of columns, walked one by one: each row of either column's kind is a sum from the middle of the range."""
    h, w, table = scan.height, scan.width, scan.tables[0]
    end = len(scan.data) // 4 * 4
    data = np.frombuffer(scan.data[:end] or b"", ">u4").astype("<u4").tobytes()
    d, at, bits, short = np.zeros(h * w, np.int64), 0, 8 * len(data), False
    for i in range(0, h * w, 2):
        pair = []
        for _ in range(2):
            ahead = int.from_bytes(data[at >> 3 : (at >> 3) + 3].ljust(3, b"\xff"), "big") >> (8 - (at & 7)) & 0xFFFF
            x = table.quick[ahead >> 8] or int(table.look(np.array([ahead]))[0])
            at += x & 31
            pair.append(x)
        sizes = [x >> 5 for x in pair]
        if not all(pair) or at + sum(k for k in sizes if k < 16) > bits:
            short = True
            break
        for j, k in enumerate(sizes):
            if k == 16:
                d[i + j] = -32768
            elif k:
                v = int.from_bytes(data[at >> 3 : (at >> 3) + 3].ljust(3, b"\0"), "big") >> (24 - (at & 7) - k) & ((1 << k) - 1)
                d[i + j] = v if v >> (k - 1) else v - (1 << k) + 1
                at += k
    out = (32768 + np.cumsum(d.reshape(h, w // 2, 2), axis=1) & 0xFFFF).astype(np.uint16).reshape(h, w, 1)
    if short:
        out.reshape(-1)[i:] = 0
        return Damaged("the data end early", out)
    return out


def _intervals(data: bytes):
    """(bytes without stuffing, number of the restart marker before them) up to the end of the image."""
    at, start, number = 0, 0, None
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            yield data[start:].replace(b"\xff\x00", b"\xff"), number
            return
        m = data[at + 1]
        if m == 0:
            at += 2
        elif 0xD0 <= m <= 0xD7:
            yield data[start:at].replace(b"\xff\x00", b"\xff"), number
            number, start = m - 0xD0, at + 2
            at = start
        elif m == 0xFF:
            at += 1
        else:
            yield data[start:at].replace(b"\xff\x00", b"\xff"), number
            return


def _all_differences(streams: list[Stream]) -> list[np.ndarray]:
    """Of each stream up to its count of differences, components in turn."""
    out: list = [None] * len(streams)
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(streams):
        if s.count >= LONG:
            out[i] = _from_many_places(s)
        else:
            groups.setdefault(len(s.tables), []).append(i)
    for own in groups.values():
        if len(own) < TOGETHER:
            for i in own:
                s = streams[i]
                out[i] = np.array([d for d, _ in _one_by_one(s.part, 0, s.tables, 0, s.count)], np.int64)
            continue
        some = [streams[i] for i in own]
        size = np.array([len(s.part) for s in some])
        begin = 8 * (np.cumsum(size) - size)
        d, _, done = _together(b"".join(s.part for s in some), begin, begin + 8 * size, np.array([s.count for s in some]), [s.tables for s in some], np.zeros(len(some), np.int64), False)
        for k, i in enumerate(own):
            out[i] = d[k, : done[k]].astype(np.int64)
    return out


def _one_by_one(part: bytes, at: int, tables: list[Huffman], c: int, count: int):
    """(difference, bit after it) from a bit on, beginning with component c."""
    end, n = 8 * len(part), len(tables)
    for _ in range(count):
        ahead = int.from_bytes(part[at >> 3 : (at >> 3) + 5].ljust(5, b"\xff"), "big") << (at & 7) & 0xFFFFFFFFFF
        x = tables[c].quick[ahead >> 32] or int(tables[c].look(np.array([ahead >> 24]))[0])
        size, k = x & 31, x >> 5
        extra = k if k < 16 else 0
        if not x or at + size + extra > end:
            return
        v = ahead >> (40 - size - extra) & ((1 << extra) - 1)
        at += size + extra
        yield -32768 if k == 16 else v if not k or v >> (k - 1) else v - (1 << k) + 1, at
        c = c + 1 if c + 1 < n else 0


_HALF = np.array([0, *(1 << k for k in range(15)), 0], np.int64)
_FULL = np.array([(1 << k) - 1 for k in range(16)] + [32768], np.int64)


def _together(data: bytes, at: np.ndarray, stop: np.ndarray, most: np.ndarray, tables: list[list[Huffman]], c: np.ndarray, past: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences of many walks in step: (walk, turn) -> difference, the bit before each, and how many each walk has.

    at: their first bits; tables, c: of each walk, and the component that it begins with. A walk ends after `most` differences, or where there is no code. Without `past` it ends before a difference that ends behind `stop`; with it, after the first one that ends at `stop` or behind it.
    """
    buffer = np.frombuffer(data + b"\xff" * 8, np.uint8)
    view = np.ndarray(len(data) + 1, ">u8", buffer.data, strides=(1,))
    kinds = {id(t): t for ts in tables for t in ts}
    number = {k: i for i, k in enumerate(kinds)}
    fast, n, m = np.stack([t.fast for t in kinds.values()]), len(tables[0]), len(tables)
    which, kinds = np.array([[number[id(t)] for t in ts] for ts in tables]), list(kinds.values())
    room = int(most.max(initial=0)) if not past else 1024
    out, before, done = np.zeros((room, m), np.int32), np.zeros((room if past else 0, m), np.int64), np.zeros(m, np.int64)
    at, live, turn = at.copy(), np.flatnonzero(most > 0), 0
    while len(live):
        if turn == len(out):
            out, before = (np.concatenate([a, np.zeros_like(a)]) for a in (out, before))
        p = at[live]
        t = which[live, (c[live] + turn) % n]
        ahead = view[np.minimum(p >> 3, len(data))].astype(np.uint64) << (p & 7).astype(np.uint64)
        x = fast[t, (ahead >> np.uint64(56)).astype(np.int64)]
        for k in np.unique(t[x == 0]).tolist():
            i = np.flatnonzero((x == 0) & (t == k))
            x[i] = kinds[k].look((ahead[i] >> np.uint64(48)).astype(np.int64))
        size, k = x & 31, x >> 5
        extra = np.where(k < 16, k, 0)
        v = (ahead << size.astype(np.uint64) >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
        v -= np.where(v < _HALF[k], _FULL[k], 0)
        v[k == 16] = -32768
        after = p + size + extra
        ok = (x > 0) & (after <= (8 * len(data) if past else stop[live]))
        if not ok.all():
            live, v, after, p = live[ok], v[ok], after[ok], p[ok]
        out[turn, live] = v
        if past:
            before[turn, live] = p
        at[live] = after
        turn += 1
        done[live] = turn
        on = (most[live] > turn) & ((after < stop[live]) if past else True)
        if not on.all():
            live = live[on]
    if past:
        before = np.concatenate([before[: max(turn, 1)], np.zeros((1, m), np.int64)])
        before[done, np.arange(m)] = at
    return out[:turn].T, before.T, done


def _from_many_places(s: Stream) -> np.ndarray:
    """The differences of one long stream. It is walked from places at equal distances, with each component; a walk from a wrong place soon meets the right one, which is followed one by one until there."""
    n = 1 if len(set(map(id, s.tables))) == 1 else len(s.tables)
    tables, end = s.tables[:n], 8 * len(s.part)
    out, have, at, c = [], 0, 0, 0
    while have < s.count and at < end:
        origin = at >> 3 << 3
        data = s.part[origin >> 3 : (origin + STRETCH >> 3) + 8]
        places = np.arange(SEGMENT, min(STRETCH, 8 * len(data)), SEGMENT)
        begin = np.r_[at - origin, np.repeat(places, n)]
        phase = np.r_[c, np.tile(np.arange(n), len(places))]
        stop = np.r_[SEGMENT, np.repeat(places + SEGMENT, n)]
        d, before, done = _together(data, begin, stop, np.full(len(begin), s.count), [tables] * len(begin), phase, True)
        walk, place, moved = 0, 0, False  # the walk that is followed, and its next difference
        for k in range(len(places) + 1):
            own = range(1) if k == 0 else range(1 + (k - 1) * n, 1 + k * n)
            bit = at - origin
            while have < s.count and bit < (k + 1) * SEGMENT:
                hit = next(((w, i) for w in own if (i := int(np.searchsorted(before[w, : done[w]], bit))) < done[w] and before[w, i] == bit and (phase[w] + i) % n == c), None)
                if hit:
                    w, i = hit
                    out.append(d[w, i : done[w]])
                    have += int(done[w] - i)
                    c = int(phase[w] + done[w]) % n
                    bit = int(before[w, done[w]])
                    moved = True
                    if bit < (k + 1) * SEGMENT:  # no code there
                        return np.concatenate(out)[: s.count].astype(np.int64)
                else:
                    step = next(_one_by_one(data, bit, tables, c, 1), None)
                    if step is None:
                        return np.concatenate([*out, np.zeros(0)])[: s.count].astype(np.int64)
                    out.append(np.array([step[0]]))
                    have, bit, c, moved = have + 1, step[1], (c + 1) % n, True
            at = origin + bit
            if have >= s.count or bit >= STRETCH:
                break
        if not moved:
            break
    return np.concatenate([*out, np.zeros(0)])[: s.count].astype(np.int64)


def _predicted(d: np.ndarray, predictor: int, half: int) -> np.ndarray:
    """Samples modulo 2^16 from differences. The first row is predicted from the left, the first column from above."""
    h, w, n = d.shape
    top = half + np.cumsum(d[0], axis=0)
    side = top[0] + np.cumsum(d[1:, 0], axis=0)
    if predictor == 1:
        start = np.concatenate([top[:1], side])
        return start[:, None] + np.concatenate([np.zeros((h, 1, n), np.int64), np.cumsum(d[:, 1:], axis=1)], axis=1) & 0xFFFF
    if predictor == 2:
        return np.cumsum(np.concatenate([top[None], d[1:]]), axis=0) & 0xFFFF
    out = np.zeros((h, w, n), np.int64)
    out[0], out[1:, 0] = top & 0xFFFF, side & 0xFFFF
    if predictor == 0:
        out[1:, 1:] = d[1:, 1:] & 0xFFFF
    elif predictor == 3:
        for y in range(1, h):
            out[y, 1:] = out[y - 1, :-1] + d[y, 1:] & 0xFFFF
    elif predictor in (4, 5):
        for y in range(1, h):
            slope = np.diff(out[y - 1], axis=0)
            out[y, 1:] = out[y, :1] + np.cumsum(d[y, 1:] + (slope if predictor == 4 else slope >> 1), axis=0) & 0xFFFF
    else:
        for t in range(2, h + w - 1):
            y = np.arange(max(1, t - w + 1), min(h, t))
            x = t - y
            a, b = out[y, x - 1], out[y - 1, x]
            out[y, x] = (b + (a - out[y - 1, x - 1] >> 1) if predictor == 6 else a + b >> 1) + d[y, x] & 0xFFFF
    return out


# -- frames and tiles -------------------------------------------------------


def encode_frame(frame: np.ndarray, bits: int = 16) -> bytes:
    """A (height, width) frame as two components of half the width. Odd widths are refused, as their last column would be lost."""
    h, w = frame.shape
    if w % 2:
        raise ValueError("the width must be even")
    return encode(frame.reshape(h, w // 2, 2), bits)


def decode_frame(b: bytes) -> np.ndarray:
    v = decode(b)
    return v.reshape(v.shape[0], -1)


def tiled(frame: np.ndarray, size: int = 192) -> list[tuple[int, int, np.ndarray]]:
    """(tile_y, tile_x, tile) of square tiles, padded with zeros."""
    if size % 2:
        raise ValueError("the tile size must be even")
    h, w = frame.shape
    full = np.zeros((-(-h // size) * size, -(-w // size) * size), frame.dtype)
    full[:h, :w] = frame
    return [(y, x, full[y * size : (y + 1) * size, x * size : (x + 1) * size]) for y in range(full.shape[0] // size) for x in range(full.shape[1] // size)]


def encode_payload(payload: Column | str, width: int, bits: int = 16) -> Column:
    """Little-endian uint16 payloads to lossless JPEG."""

    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else encode_frame(np.frombuffer(x, "<u2").reshape(-1, width), bits))

    return run(payload)


def category_counts(frames: DataFrame, payload: str, width: int, bits: int = 16) -> DataFrame:
    """category, n: how many differences of all frames (little-endian uint16 payloads) have each category, as the coder counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(17, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if b is not None:
                    total += np.bincount(categories(differences(np.frombuffer(b, "<u2").reshape(-1, width // 2, 2), bits)).ravel(), minlength=17)
        yield pa.RecordBatch.from_arrays([pa.array(range(17), pa.int32()), pa.array(total)], names=["category", "n"])

    return frames.select(payload).mapInArrow(run, "category int, n long").groupBy("category").agg(F.sum("n").alias("n")).where("n > 0")


#: Bytes of streams that are decoded together.
DECODED = 16 << 20


def decode_payload(jpeg: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(b: pd.Series) -> pd.Series:
        out: list = [None] * len(b)
        held, size = [], 0
        for i, x in enumerate([*b, None]):
            if x is not None:
                held.append((i, bytes(x)))
                size += len(x)
            if held and (size >= DECODED or i == len(b)):
                for (k, _), v in zip(held, decode_many([x for _, x in held])):
                    if isinstance(v, Damaged):
                        raise v
                    out[k] = v.astype("<u2").tobytes()
                held, size = [], 0
        return pd.Series(out)

    return run(jpeg)
