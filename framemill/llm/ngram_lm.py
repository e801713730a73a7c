"""Stupid-backoff scores of all documents under the corpus' own n-gram counts, relationally.

Words are those of words.ALNUM, A-Z lower-cased. Over all documents, c(w) counts words, c(v w) pairs of neighbours within a text, N all words. A word w after v scores c(v w) / c(v) if the pair occurs `least` times or more, else 0.4 c(w) / N; a text's first word scores c(w) / N. A document's score is the sum of the natural logarithms, each rounded to a millionth so that sums don't depend on their order.

Three steps, each a shuffle by hash of packed rows: (1) the unigram count table; (2) exploded pairs go to the partition of their first word, which therefore holds all that c(v w) and c(v) need, and are scored there; (3) pairs that back off go to the partition of their second word, where they meet the unigram table. Scores are then summed per document. Rows carry what a slab (a few megabytes of texts), or a task that holds a million entries, has for one partition. The number of partitions is bounded (PARTS_MOST). Where a partition would then hold more than BUCKET_WORDS words, its rows are packed anew by buckets of that size and sorted by them within the partition, so a task works on one bucket at a time.

Words that are frequent (more than 1/HOT of all words, or more than a quarter of a bucket's) are broadcast with their counts: their pairs are dealt by both words, and nothing is asked about them. There are fewer than HOT of the first kind; of the second as many as HOT_MOST are sent, beyond which only the more frequent ones are.

Words are told apart by hashes of 64 bits, and the count table by 32 more: words that share the 64 are found there, broadcast, and renamed by the 32.

Slabs are named by task and turn, so a task that is run again after a loss makes the same rows, as long as its input comes in one order: that of a table does, and what comes out of a shuffle is written first.

Null and empty texts have no words and score 0. Repeated rows are documents of their own, and null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw, settled, shared_dir, text_slabs, texts_of, written
from .words import Words, mix, words

HOT, HOT_MOST = 1 << 17, 4_000_000
SLAB, SLAB_MOST = 4 << 20, 32 << 20
#: Partitions at least and at most, words of a bucket, documents of a partition that sums them up.
PARTS, PARTS_MOST, BUCKET_WORDS, PART_DOCS = 96, 16_384, 2_000_000, 500_000
#: Distinct words that a counting task holds, entries that a scoring task holds, and bytes of packed rows that are packed anew at a time.
HELD, FLUSH, REPACK = 1_000_000, 1_000_000, 64 << 20
_K = np.uint64(0xD6E8FEB86659FD93)
END = np.uint64(0)
BACKOFF = int(np.rint(1e6 * np.log(0.4)))
#: Kinds of packed rows.
DOC, PAIRS, ASKED, SUMS, COUNTS = range(5)


# -- packing ----------------------------------------------------------------


def small(a: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest takes."""
    top = int(a.max(initial=0))
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def counts_of(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def together(*parts: bytes) -> bytes:
    return struct.pack(f"<I{len(parts)}I", len(parts), *map(len, parts)) + b"".join(parts)


def apart(b: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", b)
    out, at = [], 4 + 4 * n
    for size in struct.unpack_from(f"<{n}I", b, 4):
        out.append(b[at : at + size])
        at += size
    return out


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


Packed = tuple[np.ndarray, list[bytes]]  # partitions (or buckets), and what each gets


def pack_pairs(to: np.ndarray, names: np.ndarray, slab: np.ndarray, v: np.ndarray, x: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Packed:
    """Entries (slab: a number in names, first word, second word, document's number in its slab, count): each slab, first word and pair once."""
    order = np.lexsort((doc, x, v, slab, to) if len(names) > 1 else (doc, x, v, to))
    to, slab, v, x, doc, n = (a[order] for a in (to, slab, v, x, doc, n))
    starts = [changes(to), changes(to, slab), changes(to, slab, v), changes(to, slab, v, x)]
    ends = [np.r_[s[1:], len(to)] for s in starts]
    per = [np.searchsorted(starts[i + 1], ends[i]) - np.searchsorted(starts[i + 1], starts[i]) for i in range(3)]
    of = [np.searchsorted(s, np.r_[starts[0], len(to)]).tolist() for s in starts]
    size = ends[3] - starts[3]
    payload = []
    for k, (a, b) in enumerate(zip(starts[0].tolist(), ends[0].tolist())):
        s, w, p = (slice(of[i][k], of[i][k + 1]) for i in (1, 2, 3))
        payload.append(together(names[slab[starts[1][s]]].astype("<i8").tobytes(), small(per[1][s]), v[starts[2][w]].tobytes(), small(per[2][w]), x[starts[3][p]].tobytes(), small(size[p]), doc[a:b].astype("<u2").tobytes(), small(n[a:b])))
    return to[starts[0]], payload


@dataclass
class Pairs:
    names: np.ndarray
    slab: np.ndarray  # of each pair, as a number in names
    v: np.ndarray
    x: np.ndarray
    size: np.ndarray  # entries of each pair
    doc: np.ndarray  # of each entry
    n: np.ndarray


def unpack_pairs(payloads: list[bytes]) -> Pairs:
    cols: list[list] = [[] for _ in range(7)]
    for b in payloads:
        names, per_slab, v, per_v, x, size, doc, n = apart(b)
        names, v, x = np.frombuffer(names, "<i8"), np.frombuffer(v, "<u8"), np.frombuffer(x, "<u8")
        per_v = counts_of(per_v, len(v))
        owner = np.repeat(np.repeat(np.arange(len(names)), counts_of(per_slab, len(names))), per_v)
        for c, a in zip(cols, (names[owner], np.repeat(v, per_v), x, counts_of(size, len(x)).astype(np.int32), np.frombuffer(doc, "<u2"), counts_of(n, len(doc) // 2).astype(np.int32))):
            c.append(a)
    slab, v, x, size, doc, n = (np.concatenate(c) for c in cols[:6])
    names, slab = np.unique(slab, return_inverse=True)
    return Pairs(names, slab, v, x, size, doc, n)


def pack_asked(to: np.ndarray, names: np.ndarray, slab: np.ndarray, h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Packed:
    """Requests for log(c(h) / N), n times each."""
    order = np.lexsort((slab, h, to))
    to, slab, h, doc, n = (a[order] for a in (to, slab, h, doc, n))
    cut, word = changes(to), changes(to, h)
    size = np.diff(np.r_[word, len(to)])
    of = np.searchsorted(word, np.r_[cut, len(to)]).tolist()
    payload = []
    for k, (a, b) in enumerate(zip(cut.tolist(), np.r_[cut[1:], len(to)].tolist())):
        own, at = np.unique(slab[a:b], return_inverse=True)
        w = slice(of[k], of[k + 1])
        payload.append(together(names[own].astype("<i8").tobytes(), h[word[w]].tobytes(), small(size[w]), small(at), doc[a:b].astype("<u2").tobytes(), small(n[a:b])))
    return to[cut], payload


def unpack_asked(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """names, slab, h, doc, n."""
    cols: list[list] = [[] for _ in range(4)]
    for b in payloads:
        names, h, size, at, doc, n = apart(b)
        m = len(doc) // 2
        h = np.frombuffer(h, "<u8")
        for c, a in zip(cols, (np.frombuffer(names, "<i8")[counts_of(at, m)], np.repeat(h, counts_of(size, len(h))), np.frombuffer(doc, "<u2"), counts_of(n, m))):
            c.append(a)
    slab, h, doc, n = map(np.concatenate, cols)
    names, slab = np.unique(slab, return_inverse=True)
    return names, slab, h, doc, n


def pack_counts(to: np.ndarray, h: np.ndarray, c: np.ndarray) -> Packed:
    order = np.argsort(to, kind="stable")
    to, h, c = to[order], h[order], c[order]
    cut = changes(to)
    return to[cut], [together(h[a:b].tobytes(), c[a:b].astype("<u8").tobytes()) for a, b in zip(cut.tolist(), np.r_[cut[1:], len(to)].tolist())]


def unpack_counts(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    table = [apart(b) for b in payloads]
    return np.concatenate([np.frombuffer(t[0], "<u8") for t in table]), np.concatenate([np.frombuffer(t[1], "<u8") for t in table]).astype(np.int64)


def packed_sums(doc: np.ndarray, value: np.ndarray, backed: np.ndarray) -> bytes:
    """Sums and counts by document number, in order of these: for all numbers up to the largest if most have some."""
    if 2 * len(doc) > doc[-1] + 1:
        value, backed, doc = np.bincount(doc, value), np.bincount(doc, backed), doc[:0]
    value = value.astype("<i8")
    if np.abs(value).max() < 1 << 31:
        value = value.astype("<i4")
    return together(doc.astype("<u2").tobytes(), value.tobytes(), small(backed.astype(np.int64)), struct.pack("<I", len(value)))


def pack_sums(to: Callable[[np.ndarray], np.ndarray], names: np.ndarray, slab: np.ndarray, doc: np.ndarray, value: np.ndarray, backed: np.ndarray) -> Packed:
    """Sums of values and of back-offs for each document, packed by where their slabs go."""
    keys, at = np.unique(slab.astype(np.int64) << 16 | doc, return_inverse=True)
    value, backed = np.bincount(at, value, len(keys)), np.bincount(at, backed, len(keys))
    slab, doc = keys >> 16, keys & 0xFFFF
    cut = changes(slab)
    blobs = [packed_sums(doc[a:b], value[a:b], backed[a:b]) for a, b in zip(cut.tolist(), np.r_[cut[1:], len(slab)].tolist())]
    own = names[slab[cut]]
    where = to(own)
    order = np.argsort(where, kind="stable")
    cut = changes(where[order])
    groups = np.split(order, cut[1:])
    return where[order][cut], [together(own[g].astype("<i8").tobytes(), *(blobs[i] for i in g.tolist())) for g in groups]


def add_sums(b: bytes, into: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
    """into(slab, documents): arrays of scores and back-offs to add to."""
    names, *blobs = apart(b)
    for name, blob in zip(np.frombuffer(names, "<i8").tolist(), blobs):
        doc, value, more, n = apart(blob)
        (n,) = struct.unpack("<I", n)
        at = np.frombuffer(doc, "<u2").astype(np.int64) if doc else np.arange(n)
        score, backed = into(name, int(at[-1]) + 1)
        score[at] += np.frombuffer(value, f"<i{len(value) // n}")
        backed[at] += counts_of(more, n)


# -- steps ------------------------------------------------------------------


def micro(x: np.ndarray) -> np.ndarray:
    return np.rint(1e6 * np.log(x)).astype(np.int64)


def checks(w: Words) -> np.ndarray:
    """32 more bits of each word."""
    return (w.other_hashes() >> np.uint64(32)).astype(np.uint32)


def renamed(h: np.ndarray, clash: np.ndarray, check: Callable[[], np.ndarray]) -> np.ndarray:
    """Hashes, none of them END; those that several words share (clash, sorted) are made anew with these words' other bits."""
    if len(clash):
        at = np.minimum(np.searchsorted(clash, h), len(clash) - 1)
        h = np.where(clash[at] == h, mix(h ^ mix(check().astype(np.uint64) + _K)), h)
    return np.maximum(h, np.uint64(1))


def hashes(w: Words, bits: int) -> np.ndarray:
    return w.hashes >> np.uint64(64 - bits)


def unigrams(df: DataFrame, bits: int = 64) -> DataFrame:
    """h, check, c: the count of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            nonlocal held, size
            h, k, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((k, h))
            h, k, c = h[order], k[order], c[order]
            cut = changes(h, k)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), pa.array(k[cut].view(np.int32)), pa.array(np.add.reduceat(c, cut))], names=["h", "check", "c"])

        held, size = [], 0
        for slab in text_slabs(batches, SLAB):
            w = words(*raw(slab.column(1)))
            k = checks(w)
            h = hashes(w, bits)
            _, at, c = np.unique(h ^ (k.astype(np.uint64) << np.uint64(17)), return_index=True, return_counts=True)
            held.append((h[at], k[at], c))
            size += len(at)
            if size > HELD:
                yield out()
        if size:
            yield out()

    return df.mapInArrow(run, "h long, check int, c long").groupBy("h", "check").agg(F.sum("c").alias("c"))


@dataclass
class Plan:
    """What all tasks know."""

    least: int
    bits: int  # of words' hashes
    total: int  # words
    parts: int
    subs: int  # buckets of a partition
    ends: int  # partitions that sum up documents
    known: Any  # broadcast: (hashes that several words share, frequent words, their counts), the first two sorted
    least_hot: int
    id_type: pa.DataType

    def clash(self) -> np.ndarray:
        return self.known.value[0]

    def hot(self, h: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        _, keys, c = self.known.value
        if not len(keys) or not len(h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, c[at], 0)

    def part(self, h: np.ndarray) -> np.ndarray:
        return (mix(h) % np.uint64(self.parts)).astype(np.int32)

    def sub(self, h: np.ndarray) -> np.ndarray:
        return (mix(h) // np.uint64(self.parts) % np.uint64(self.subs)).astype(np.int32)

    def pair_key(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What decides where a pair goes: its first word, of a frequent one both."""
        return np.where(self.hot(v) > 0, v * _K + x, v)

    def end(self, slab: np.ndarray) -> np.ndarray:
        return (mix(slab.astype(np.uint64)) % np.uint64(self.ends)).astype(np.int32)

    def row(self, what: int, to: np.ndarray, payload: list[bytes], sub: np.ndarray | None = None) -> pa.RecordBatch:
        m = len(to)
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(m, what, np.int32)), pa.array(np.zeros(m, np.int32) if sub is None else sub), pa.nulls(m, pa.int64()), pa.array(payload, pa.binary()), pa.nulls(m, pa.list_(self.id_type)), pa.nulls(m, pa.list_(pa.int64()))], names=FIELDS)

    def docs(self, name: int, ids: pa.Array, size: np.ndarray) -> pa.RecordBatch:
        of = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([pa.array(self.end(np.array([name])), pa.int32()), pa.array([DOC], pa.int32()), pa.array([0], pa.int32()), pa.array([name], pa.int64()), pa.nulls(1, pa.binary()), of(ids), of(pa.array(size, pa.int64()))], names=FIELDS)


FIELDS = ["to", "kind", "sub", "slab", "payload", "ids", "n"]


def explode(plan: Plan, batches: Iterator[pa.RecordBatch], slab_bytes: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for turn, slab in enumerate(text_slabs(batches, slab_bytes)):
        name = task << 32 | turn
        names = np.array([name])
        w = words(*raw(slab.column(1)))
        h, doc, size = renamed(hashes(w, plan.bits), plan.clash(), lambda w=w: checks(w)), w.doc(), np.diff(w.first)
        some = np.flatnonzero(size)
        yield plan.docs(name, slab.column(0), size)
        if not len(some):
            continue
        first = h[w.first[:-1][some]]
        known = plan.hot(first)
        there = np.flatnonzero(known)
        if len(there):
            yield plan.row(SUMS, *pack_sums(plan.end, names, np.zeros(len(there), np.int64), some[there], micro(known[there] / plan.total), np.zeros(len(there))))
        cold = np.flatnonzero(known == 0)
        if len(cold):
            yield plan.row(ASKED, *pack_asked(plan.part(first[cold]), names, np.zeros(len(cold), np.int32), first[cold], some[cold], np.ones(len(cold), np.int64)))
        nxt = np.r_[h[1:], END]
        nxt[w.first[1:][some] - 1] = END
        # each distinct (first word, second word, document) of the slab with its count
        _, at, n = np.unique(mix(mix(h * _K + nxt) + doc.astype(np.uint64) * _K), return_index=True, return_counts=True)
        v, x = h[at], nxt[at]
        yield plan.row(PAIRS, *pack_pairs(plan.part(plan.pair_key(v, x)), names, np.zeros(len(at), np.int32), v, x, doc[at], n))


def repack(plan: Plan, batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of these kinds packed anew by buckets of their partition."""
    held: dict[int, list[bytes]] = {k: [] for k in kinds}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for kind, payloads in held.items():
            if not payloads:
                continue
            if kind == PAIRS:
                p = unpack_pairs(payloads)
                at = np.repeat(np.arange(len(p.x)), p.size)
                sub, packed = pack_pairs(plan.sub(plan.pair_key(p.v, p.x))[at], p.names, p.slab[at], p.v[at], p.x[at], p.doc, p.n)
            elif kind == ASKED:
                names, slab, h, doc, n = unpack_asked(payloads)
                sub, packed = pack_asked(plan.sub(h), names, slab, h, doc, n)
            else:
                h, c = unpack_counts(payloads)
                sub, packed = pack_counts(plan.sub(h), h, c)
            held[kind] = []
            yield plan.row(kind, np.zeros(len(sub), np.int32), packed, sub)

    for batch in batches:
        kind = batch.column(1).to_numpy()
        mine = np.isin(kind, kinds)
        if not mine.all():
            yield batch.filter(pa.array(~mine))
        for i in np.flatnonzero(mine).tolist():
            b = batch.column(4)[i].as_py()
            held[int(kind[i])].append(b)
            size += len(b)
            if size >= REPACK:
                yield from out()
                size = 0
    yield from out()


def by_bucket(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...], f: Callable[[dict[int, list[bytes]]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """f gets the payloads of these kinds, bucket by bucket; other rows are passed on."""
    held: dict[int, list[bytes]] = {k: [] for k in kinds}
    last = None
    for batch in batches:
        kind, sub = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        mine = np.isin(kind, kinds)
        if not mine.all():
            yield batch.filter(pa.array(~mine))
        for i in np.flatnonzero(mine).tolist():
            if last is not None and sub[i] != last:
                yield from f(held)
                held = {k: [] for k in kinds}
            last = sub[i]
            held[int(kind[i])].append(batch.column(4)[i].as_py())
    if last is not None:
        yield from f(held)


class Sums:
    """Holds entries of documents until there are many."""

    def __init__(self, plan: Plan):
        self.plan, self.held, self.size = plan, [], 0

    def add(self, names: np.ndarray, slab: np.ndarray, doc: np.ndarray, value: np.ndarray, backed: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((names[slab], doc, value, backed))
        self.size += len(doc)
        if self.size >= FLUSH:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            slab, doc, value, backed = (np.concatenate(x) for x in zip(*self.held))
            names, slab = np.unique(slab, return_inverse=True)
            yield self.plan.row(SUMS, *pack_sums(self.plan.end, names, slab, doc, value, backed))
        self.held, self.size = [], 0


class Asked:
    """Holds requests until there are many."""

    def __init__(self, plan: Plan):
        self.plan, self.held, self.size = plan, [], 0

    def add(self, names: np.ndarray, slab: np.ndarray, h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((names[slab], h, doc, n))
        self.size += len(doc)
        if self.size >= FLUSH:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            slab, h, doc, n = (np.concatenate(x) for x in zip(*self.held))
            names, slab = np.unique(slab, return_inverse=True)
            yield self.plan.row(ASKED, *pack_asked(self.plan.part(h), names, slab, h, doc, n))
        self.held, self.size = [], 0


def score_pairs(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, asked = Sums(plan), Asked(plan)

    def score(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        p = unpack_pairs(held[PAIRS])
        pair_n = np.add.reduceat(p.n, np.cumsum(p.size, dtype=np.int64) - p.size, dtype=np.int64)
        first, at1 = np.unique(p.v, return_inverse=True)
        c1 = np.bincount(at1, pair_n, len(first)).astype(np.int64)
        known = plan.hot(first)
        c1 = np.where(known > 0, known, c1)[at1]
        # rows of the same pair are neighbours in this order
        order = np.lexsort((p.x, at1))
        cut = changes(at1[order], p.x[order])
        c2 = np.empty(len(order), np.int64)
        c2[order] = np.repeat(np.add.reduceat(pair_n[order], cut), np.diff(np.r_[cut, len(order)]))
        seen, real = c2 >= plan.least, p.x != END
        cx = plan.hot(p.x)
        value = np.where(seen, micro(c2 / np.maximum(c1, 1)), BACKOFF + np.where(cx > 0, micro(np.maximum(cx, 1) / plan.total), 0))
        value[~real] = 0
        backed, ask = ~seen & real, ~seen & real & (cx == 0)
        entry = np.repeat(np.arange(len(p.x), dtype=np.int32), p.size)
        some = np.flatnonzero(real[entry])
        e = entry[some]
        yield from sums.add(p.names, p.slab[e], p.doc[some], value[e] * p.n[some], backed[e] * p.n[some])
        some = np.flatnonzero(ask[entry])
        if len(some):
            e = entry[some]
            yield from asked.add(p.names, p.slab[e], p.x[e], p.doc[some], p.n[some].astype(np.int64))

    yield from by_bucket(batches, (PAIRS,), score)
    yield from sums.out()
    yield from asked.out()


def answer(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums(plan)

    def reply(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if not held[ASKED]:
            return
        names, slab, h, doc, n = unpack_asked(held[ASKED])
        keys, c = unpack_counts(held[COUNTS])
        order = np.argsort(keys)
        c = c[order[np.searchsorted(keys[order], h)]]
        yield from sums.add(names, slab, doc, micro(c / plan.total) * n, np.zeros(len(h), np.int64))

    yield from by_bucket(batches, (ASKED, COUNTS), reply)
    yield from sums.out()


def packed_counts(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
        h = renamed(h, plan.clash(), lambda b=batch: b.column(1).to_numpy().view(np.uint32))
        cold = c <= plan.least_hot
        if cold.any():
            yield plan.row(COUNTS, *pack_counts(plan.part(h[cold]), h[cold], c[cold]))


def summed(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a partition's slabs; holds 12 bytes and the id of each."""
    scores: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    docs: list[tuple[int, pa.Array, np.ndarray]] = []

    def into(slab: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        old = scores.get(slab, (np.zeros(0, np.int64), np.zeros(0, np.int32)))
        if len(old[0]) < n:
            old = scores[slab] = tuple(np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)]) for a in old)
        return old

    for batch in batches:
        for i, kind in enumerate(batch.column(1).to_pylist()):
            if kind == SUMS:
                add_sums(batch.column(4)[i].as_py(), into)
            elif kind == DOC:
                docs.append((batch.column(3)[i].as_py(), batch.column(5)[i].values, batch.column(6)[i].values.to_numpy()))
    for name, ids, n in docs:
        score, backed = (a[: len(n)] for a in into(name, len(n)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(backed.astype(np.int64)), pa.array(score / 1e6), pa.array(score / 1e6 / np.maximum(n, 1))], names=["doc_id", "n_words", "n_backoff", "score", "mean_score"])


def planned(df: DataFrame, counts: DataFrame, least: int, bits: int = 64) -> Plan:
    """counts: the written unigram table."""
    from pyspark.sql.pandas.types import to_arrow_type

    sc = df.sparkSession.sparkContext
    total = counts.agg(F.sum("c")).first()[0] or 0
    clash = np.sort(np.array([r.h for r in counts.groupBy("h").count().where("count > 1").toLocalIterator()], np.int64).view(np.uint64))
    least_hot = min(total // HOT, BUCKET_WORDS // 4)
    while counts.where(F.col("c") > least_hot).count() > HOT_MOST:
        least_hot *= 2
    rows = counts.where(F.col("c") > least_hot).toArrow()
    h = renamed(rows["h"].to_numpy().view(np.uint64), clash, lambda: rows["check"].to_numpy().view(np.uint32))
    order = np.argsort(h)
    parts = min(PARTS_MOST, max(PARTS, -(-total // BUCKET_WORDS)))
    ends = min(PARTS_MOST, max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // PART_DOCS))
    return Plan(least, bits, max(total, 1), parts, max(1, -(-total // (parts * BUCKET_WORDS))), ends, sc.broadcast((clash, h[order], rows["c"].to_numpy()[order])), least_hot, to_arrow_type(df.schema["doc_id"].dataType))


def exploded(df: DataFrame, plan: Plan) -> DataFrame:
    slab = min(SLAB_MOST, SLAB * max(1, plan.parts // PARTS))
    return df.mapInArrow(lambda b: explode(plan, b, slab), _schema(df))


def _schema(df: DataFrame) -> str:
    return f"to int, kind int, sub int, slab long, payload binary, ids array<{df.schema['doc_id'].dataType.simpleString()}>, n array<long>"


def lm_scores(docs: DataFrame, least: int = 2, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_backoff, score (sum of logarithms), mean_score (over words; 0 without words) for every row. bits: of the hashes that words are first told apart by; fewer give the same results."""
    top = shared_dir(docs.sparkSession)
    df = settled(texts_of(docs, id_col, text_col), f"{top}/texts")
    counts = written(unigrams(df, bits), f"{top}/unigrams")
    plan, schema = planned(df, counts, least, bits), _schema(df)

    def dealt(x: DataFrame, n: int, kinds: tuple[int, ...]) -> DataFrame:
        """Rows of these kinds to the partition that they name, others by slab."""
        x = x.repartitionById(n, F.when(F.col("kind").isin(*kinds), F.col("to")).otherwise(F.pmod(F.xxhash64("to", "kind"), F.lit(n)).cast("int")))
        if plan.subs > 1 and kinds != (DOC, SUMS):
            x = x.mapInArrow(lambda b: repack(plan, b, kinds), schema).sortWithinPartitions("sub")
        return x

    pairs = dealt(exploded(df, plan), plan.parts, (PAIRS,)).mapInArrow(lambda b: score_pairs(plan, b), schema)
    asked = dealt(pairs.union(counts.mapInArrow(lambda b: packed_counts(plan, b), schema)), plan.parts, (ASKED, COUNTS)).mapInArrow(lambda b: answer(plan, b), schema)
    return dealt(asked, plan.ends, (DOC, SUMS)).mapInArrow(lambda b: summed(plan, b), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_backoff long, score double, mean_score double")
