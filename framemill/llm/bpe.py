"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Each task replays the merges over its part of the corpus. The distinct pre-tokens of a slab of texts that the task hasn't met yet are laid end to end; an inverted index maps each rank (that is, each mergeable token pair) to the positions where such a pair stands. Ranks are taken in their order, each with all its positions at once, in all words; a merge looks at its two neighbours only, and enters the pairs that it makes into the index. A word in which a merge makes a pair of a lower rank, while other positions of its batch were merged as well, would want these to wait: such rare words are replayed again alone. A pre-token's ids depend on nothing but itself, so the corpus can be dealt over tasks without a shuffle, and a lost task is just run again.

Nulls and empty texts give no ids. Repeated rows are encoded as often as they come. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .segments import segments
from .shared import text_slabs, texts_of

#: Bytes of texts whose new pre-tokens are replayed together: many, as each rank takes a few array operations.
SLAB = 8 << 20
#: Segments that a task remembers between slabs; beyond it the memory starts anew. It changes the speed only.
REMEMBERED = 300_000
#: No merge.
NONE = (1 << 31) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: Places whose first pairs are looked up at a time.
CHUNK = 1 << 18


def pair_keys(sym: np.ndarray, after: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The pairs that begin at some places, as first << 32 | second."""
    return sym[places].astype(np.int64) << 32 | sym[after[places]].astype(np.int64) & 0xFFFFFFFF


class MergeReplay:
    """Replays the merges of a rank table over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.token = ranks, {r: t for t, r in ranks.items()}
        pairs = {(a << 32) | b: r for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None}
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs, given as first << 32 | second; NONE where they don't merge."""
        if not len(self.pair_keys):
            return np.full(len(keys), NONE, np.int32)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(NONE))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed: the lowest rank first, and leftmost among equals, as one word at a time would get them."""
        out: list[bytes] = [b""] * len(words)
        left = []
        for w, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[w] = whole.to_bytes(4, "little")
            elif word:
                left.append(w)
        for w, ids in zip(left, self.replay([words[w] for w in left])):
            out[w] = ids
        return out

    def replay(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        size = np.array([len(w) for w in words])
        n, ends = int(size.sum()), np.cumsum(size)
        # one place more, at -1, stands for no neighbour; its token is in no pair
        sym = np.full(n + 1, -1, np.int32)
        sym[:n] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after, before, merged = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.zeros(n, bool)
        after[ends - 1], before[ends - size], after[n] = -1, -1, -1
        rank = np.empty(n + 1, np.int32)
        for i in range(0, n + 1, CHUNK):
            keys, at = np.unique(pair_keys(sym, after, np.arange(i, min(i + CHUNK, n + 1))), return_inverse=True)
            rank[i : i + CHUNK] = self.rank_of(keys)[at]
        order = np.argsort(rank, kind="stable").astype(np.int32)[: int((rank < NONE).sum())]
        cut = np.flatnonzero(np.diff(rank[order])) + 1
        index: dict[int, list[np.ndarray]] = {int(rank[p[0]]): [p] for p in np.split(order, cut) if len(p)}
        heap, again = list(index), []
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            p = places[0] if len(places) == 1 else np.concatenate(places)
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(p) > 1:
                if not (p[1:] > p[:-1]).all():
                    p = np.unique(p)
                q = after[p]
                touching = p[1:] == q[:-1]
                if touching.any():  # of a row of equal tokens every other place is merged, from the left
                    start = np.maximum.accumulate(np.where(np.r_[True, ~touching], np.arange(len(p)), 0))
                    p = p[(np.arange(len(p)) - start) % 2 == 0]
            q = after[p]
            nxt = after[q]
            sym[p], after[p], before[nxt], rank[q], merged[q] = r, nxt, p, NONE, True
            touched = np.concatenate([before[p], p])
            new = self.rank_of(pair_keys(sym, after, touched))
            rank[touched] = new
            some = new != NONE
            touched, new = touched[some], new[some]
            if not len(new):
                continue
            low = new < r
            if len(p) > 1 and low.any():
                word = np.searchsorted(ends, p, "right")
                again += [w for w in np.unique(np.searchsorted(ends, touched[low], "right")).tolist() if np.count_nonzero(word == w) > 1]
            by = np.argsort(new, kind="stable")
            touched, new = touched[by], new[by]
            cut = np.flatnonzero(new[1:] != new[:-1]) + 1
            for k, places in zip(new[np.r_[0, cut]].tolist(), np.split(touched, cut)):
                if k in index:
                    index[k].append(places)
                else:
                    index[k] = [places]
                    heapq.heappush(heap, k)
        ids = sym[:n][~merged].astype("<u4").tobytes()
        stop = (4 * np.cumsum(~merged)[ends - 1]).tolist()
        out = [ids[a:b] for a, b in zip([0, *stop], stop)]
        for w in set(again):
            out[w] = self.alone(words[w])
        return out

    def alone(self, word: bytes) -> bytes:
        """One word, merge by merge."""
        n = len(word)
        sym, after, before = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), [*range(1, n), -1], list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j < 0 or pairs.get(sym[i] << 32 | sym[j]) != r:
                continue
            k = after[j]
            sym[i], sym[j], after[i] = r, -1, k
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (x := pairs.get(sym[a] << 32 | sym[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()


class Encoder:
    """Texts to ids by way of the distinct segments and pre-tokens of a slab."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.pattern = MergeReplay(ranks), regex.compile(pattern)
        self.known: dict[str, bytes] = {}  # segment -> ids as little-endian uint32

    def learn(self, texts: Iterable[str]) -> None:
        """Replay the merges over the pre-tokens of all segments that aren't known."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, new = self.known, set()
        for t in texts:
            new.update(segments(t))
        new -= known.keys()
        words: dict[str, int] = {}
        made = array("i")  # the pre-tokens of one segment after the other
        ends = []
        for s in new:
            made.extend([words.setdefault(w, len(words)) for w in self.pattern.findall(s)])
            ends.append(len(made))
        ids = self.replay.encode([w.encode() for w in words])
        for s, a, b in zip(new, [0, *ends], ends):
            known[s] = ids[made[a]] if b == a + 1 else b"".join([ids[w] for w in made[a:b]])

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, segments(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.learn(texts)
        return [self.ids(t) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32, packed) and decoded (the bytes that the ids give back); with digests, ids_sha256 and decoded_sha256 in place of the last two.

    Null texts count as empty; an empty text has no tokens and the digests of no bytes.
    """
    df = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(load_ranks(vocabulary), pattern)
        for some in gathered(batches, SLAB):
            enc.learn(t for slab in some for t in slab.column(1).to_pylist())
            for slab in some:
                ids = [enc.ids(t) for t in slab.column(1).to_pylist()]
                back = [enc.decode(x) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digests:
                    tail = [pa.array([hashlib.sha256(x).hexdigest() for x in y], pa.string()) for y in (ids, back)]
                else:
                    tail = [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([slab.column(0), n, *tail], names=["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kind = "string" if digests else "binary"
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, " + ", ".join(f"{x} {kind}" for x in names))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slabs of texts, as many at a time as have `most` bytes together."""
    held, size = [], 0
    for slab in text_slabs(batches):
        held.append(slab)
        size += slab.column(1).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held
