"""Words of many texts at once, as numpy arrays over their bytes.

A word's hash is the mixed sum of its 8-byte pieces, each mixed with a key of its place first, so that no arithmetic of the bytes (as in Thue-Morse strings) carries over to it. Where words are taken for equal, `same` compares their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = byte_class(lambda b: b >= 128 or chr(b).isalnum())
#: `[^\x20\x09-\x0D]+`
NONSPACE = byte_class(lambda b: b != 32 and not 9 <= b <= 13)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Of a word's last piece, the bytes that it has: 1 to 8.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    starts: np.ndarray  # byte offsets into the slab
    ends: np.ndarray
    first: np.ndarray  # of each text, its first word's number; one more at the end
    hashes: np.ndarray  # uint64
    pieces: np.ndarray  # the 8 bytes from each place of the slab on, as folded

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def other_hashes(self) -> np.ndarray:
        """A second, independent hash of each word."""
        return word_hashes(self.pieces, self.starts, self.ends, 0x51ED270B9F)


def pieces_of(data: np.ndarray, fold: bool) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = FOLD[data] if fold else data
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, fold: bool = True, seed: int = 0) -> Words:
    """The maximal runs of bytes of a kind, within texts; with fold, A-Z count as a-z."""
    n, pieces = len(data), pieces_of(data, fold)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64), pieces)
    inside = kind[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = cut[cut > 0] - 1
    stop[last] = inside[last]
    ends = np.flatnonzero(stop) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets), word_hashes(pieces, starts, ends, seed), pieces)


def word_hashes(pieces: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    size = ends - starts
    key = lambda place: mix(place.astype(np.uint64) * _GOLDEN + np.uint64(0xA0761D6478BD642F + seed))
    total = mix((pieces[starts] & _KEEP[np.minimum(size, 8)]) ^ key(np.zeros(1)))
    long = np.flatnonzero(size > 8)
    if len(long):
        k = (size[long] - 1) // 8
        base = np.cumsum(k) - k
        place = np.arange(int(k.sum())) - np.repeat(base, k) + 1
        value = pieces[np.repeat(starts[long], k) + 8 * place] & _KEEP[np.minimum(np.repeat(size[long], k) - 8 * place, 8)]
        total[long] += np.add.reduceat(mix(value ^ key(place)), base)
    return mix(total ^ size.astype(np.uint64))


def same(a: np.ndarray, a_starts: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether words have equal bytes, pair by pair; a and b: the pieces that their places refer to."""
    size = a_ends - a_starts
    out = size == b_ends - b_starts
    some = np.flatnonzero(out & (size > 0))
    out[some] = ((a[a_starts[some]] ^ b[b_starts[some]]) & _KEEP[np.minimum(size[some], 8)]) == 0
    long = some[out[some] & (size[some] > 8)]
    if len(long):
        k = (size[long] - 1) // 8
        base = np.cumsum(k) - k
        place = 8 * (np.arange(int(k.sum())) - np.repeat(base, k) + 1)
        differ = (a[np.repeat(a_starts[long], k) + place] ^ b[np.repeat(b_starts[long], k) + place]) & _KEEP[np.minimum(np.repeat(size[long], k) - place, 8)]
        out[long] = np.bitwise_or.reduceat(differ, base) == 0
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive ones, wherever they start; the caller drops those that cross texts."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + m])
    return out
