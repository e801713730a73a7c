"""Benchmark decontamination with suffix arrays over the training texts.

Every slab of training texts is a shard. Its words become numbers of the test set's vocabulary (0: not in it, which ends any match), and its suffix array holds all places with a known word in the order of what follows them. The test set's suffixes of at least a window are searched in it by binary search, word by word and in their own order, so that beginnings which they share are searched once: the range that a window ends up with is all its verbatim occurrences. From the places found, the longest matches are searched in the test set's own suffix array. A text is contaminated by its longest match: one of a window or more, or of a whole shorter item.

Words are looked up by hashes and then compared byte by byte; the test set takes another seed in the event that two of its words share a hash. So nothing rests on hashes.

A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Nulls and texts without words hit nothing. Items without an id count for hits, but aren't listed; repeated item ids are listed once. Repeated documents are each judged, other columns ignored.

Only the test set is sent to the tasks; texts are never shuffled. A test set of up to BLOCK_BYTES is broadcast. A larger one is cut into blocks by tasks that write them to the shared folder, and a task reads one at a time, for HELD bytes of texts each.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw, shared_dir, text_slabs, texts_of
from .words import pieces_of, same, words

BLOCK_BYTES = 32 << 20
SLAB, HELD = 4 << 20, 32 << 20


class Suffixes:
    """Word numbers of some texts with a 0 after each text, and their suffix array: the places with a known word, sorted by the known words from there on. What ends comes before what goes on; equal ones are in any order."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        self.place = np.arange(n) + np.repeat(np.arange(len(first) - 1), np.diff(first))  # of each word in seq
        self.seq = np.zeros(n + len(first), np.int32)
        self.seq[self.place] = ids
        zero = np.where(self.seq == 0, np.arange(len(self.seq)), len(self.seq))
        self.known = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(len(self.seq))  # known words from each place on
        self.array = self._sorted()

    def _sorted(self) -> np.ndarray:
        seq, known = self.seq, self.known
        at = np.flatnonzero(seq)
        at = at[np.argsort(seq[at])]
        rank = np.zeros(len(seq), np.int64)
        start = np.flatnonzero(np.r_[True, seq[at[1:]] != seq[at[:-1]]]) if len(at) else at
        size = np.diff(np.r_[start, len(at)])
        rank[at] = np.repeat(start, size) + 1
        open_ = np.flatnonzero(np.repeat(size > 1, size))  # places in the array that aren't settled
        h = 1
        while len(open_):
            p = at[open_]
            key = rank[p] * (len(seq) + 1) + np.where(known[p] > h, rank[np.minimum(p + h, len(seq) - 1)], 0)
            order = np.argsort(key)
            p, key = p[order], key[order]
            at[open_] = p
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(p)])
            rank[p] = np.repeat(open_[start], size) + 1
            h *= 2
            open_ = open_[np.repeat(size > 1, size) & (known[p] >= h)]
        return at

    def find(self, other: Suffixes, places: np.ndarray, most: np.ndarray, lcp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For suffixes of `other` from some places of its seq, of `most` words each: how many words of them are somewhere in these texts at most, and the range of the array in which that is. lcp: if the places are sorted, the words that each shares with the one before."""
        m = len(places)
        low, high, length = np.zeros(m, np.int64), np.full(m, len(self.array)), np.zeros(m, np.int64)
        heads = self.seq[self.array]
        live, d = np.arange(m), 0
        while len(live):
            live = live[most[live] > d]
            if not len(live):
                break
            own = live if lcp is None else live[(lcp[live] <= d) | np.r_[True, live[1:] != live[:-1] + 1]]
            want = other.seq[places[own] + d]
            if d == 0:
                a, b = np.searchsorted(heads, want, "left"), np.searchsorted(heads, want, "right")
            else:
                a, b = self._bound(low[own], high[own], want, d), self._bound(low[own], high[own], want + 1, d)
            if lcp is not None:
                of = np.searchsorted(own, live, "right") - 1
                a, b = a[of], b[of]
            some = b > a
            live = live[some]
            low[live], high[live] = a[some], b[some]
            d += 1
            length[live] = d
        return length, low, high

    def _bound(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, d: int) -> np.ndarray:
        """The first place in each range of the array whose suffix's word d isn't less than `want`."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.seq[self.array[middle] + d] < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low


class TestSet:
    """A block of test items, ready to be searched for."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], window: int):
        data, offsets = raw(pa.array([t or "" for _, t in items], pa.large_string()))
        self.names = [None if i is None else str(i) for i, _ in items]
        for self.seed in itertools.count():
            w = words(data, offsets, seed=self.seed)
            self.vocabulary, first, at = np.unique(w.hashes, return_index=True, return_inverse=True)
            own = first[at]
            if same(w.pieces, w.starts, w.ends, w.pieces, w.starts[own], w.ends[own]).all():
                break
        size = w.ends[first] - w.starts[first]
        self.ends = np.cumsum(size)
        self.bytes = w.pieces[np.repeat(w.starts[first] - (self.ends - size), size) + np.arange(int(size.sum()))].astype(np.uint8)
        self.suffixes = Suffixes((at + 1).astype(np.int32), w.first)
        # of each place of seq the item, and its words and the words left of it
        size = np.diff(w.first)
        self.item = np.repeat(np.arange(len(size)), size + 1) if len(size) else np.zeros(0, np.int64)
        self.begin = np.cumsum(size + 1) - (size + 1)
        sa, left = self.suffixes.array, self.suffixes.known
        self.need = np.minimum(size, window)[self.item[sa]]
        starts = left[sa] >= self.need
        starts &= (self.need == window) | (left[sa] == size[self.item[sa]])
        self.windows, self.need = sa[starts], self.need[starts]  # places where windows begin, sorted by what follows
        self.lcp = np.zeros(len(self.windows), np.int64)
        a, b = self.windows[:-1], self.windows[1:]
        live, d = np.arange(len(a)), 0
        while len(live):
            live = live[(left[a[live]] > d) & (left[b[live]] > d)]
            live = live[self.suffixes.seq[a[live] + d] == self.suffixes.seq[b[live] + d]]
            self.lcp[live + 1] += 1
            d += 1
        # where a window begins that differs from the one before
        self.group = np.flatnonzero(np.r_[True, (self.lcp < self.need)[1:] | (self.need[1:] != self.need[:-1])]) if len(self.need) else self.need
        self.window = window

    def numbers(self, w) -> np.ndarray:
        """The vocabulary's numbers, from 1 on, of words hashed with this seed; 0 for words that aren't in it, by their bytes."""
        if not len(self.vocabulary):
            return np.zeros(len(w.hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, w.hashes), len(self.vocabulary) - 1)
        found = np.flatnonzero(self.vocabulary[at] == w.hashes)
        starts = np.r_[0, self.ends[:-1]]
        found = found[same(w.pieces, w.starts[found], w.ends[found], pieces_of(self.bytes, False), starts[at[found]], self.ends[at[found]])]
        out = np.zeros(len(at), np.int32)
        out[found] = at[found] + 1
        return out


@dataclass
class Hits:
    place: np.ndarray  # where an occurrence of a window begins, in words of the shard
    need: np.ndarray  # its words
    first: np.ndarray  # the window: its first and last entry in test.windows
    last: np.ndarray


class Shard:
    """A slab of training texts."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = raw(column)
        self.words = {}
        self.w = self.hashed(0)
        self.doc = self.w.doc()

    def hashed(self, seed: int):
        if seed not in self.words:
            self.words[seed] = words(self.data, self.offsets, seed=seed)
        return self.words[seed]

    def search(self, test: TestSet) -> Hits:
        """All occurrences of the test set's windows."""
        self.suffixes = s = Suffixes(test.numbers(self.hashed(test.seed)), self.w.first)
        length, low, high = s.find(test.suffixes, test.windows, test.need, test.lcp)
        found = np.flatnonzero((length == test.need)[test.group])
        first, last = test.group[found], np.r_[test.group[1:], len(test.windows)][found] - 1
        k = (high - low)[first]
        at = np.repeat(low[first] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        return Hits(np.searchsorted(s.place, s.array[at]), np.repeat(test.need[first], k), np.repeat(first, k), np.repeat(last, k))

    def longest(self, test: TestSet, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For places in words: the words of the longest match with any item there, and the range of test.suffixes.array that has it."""
        at = self.suffixes.place[places]
        return test.suffixes.find(self.suffixes, at, self.suffixes.known[at])


class Block:
    """A test set in the shared folder."""

    def __init__(self, path: str):
        self.path = path

    @property
    def value(self) -> TestSet:
        where, path = fs.FileSystem.from_uri(self.path)
        with where.open_input_stream(path) as f:
            return pickle.loads(f.read())


def test_blocks(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """The test set as one broadcast, or as Blocks if it has more than block_bytes of text."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [spark.sparkContext.broadcast(TestSet([tuple(r) for r in rows.collect()], window))]
    folder = f"{shared_dir(spark)}/tests"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if items:
            where, top = fs.FileSystem.from_uri(folder)
            where.create_dir(top, recursive=True)
            name = uuid.uuid4().hex
            with where.open_output_stream(f"{top}/{name}") as f:
                f.write(pickle.dumps(TestSet(items, window)))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    dealt = rows.distinct().repartition(2 * total // block_bytes + 1, F.xxhash64("item", "text"))
    return [Block(r.path) for r in dealt.mapInArrow(write, "path string").collect()]


def _shards(batches: Iterator[pa.RecordBatch], blocks: list) -> Iterator[list[pa.RecordBatch]]:
    """Slabs, several at a time if there are several blocks to read for them."""
    held, size = [], 0
    for slab in text_slabs(batches, SLAB):
        held.append(slab)
        size += slab.column(1).nbytes
        if len(blocks) == 1 or size >= HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Verdict:
    n_words: np.ndarray
    n_hit: np.ndarray
    n_longest: np.ndarray
    longest_at: np.ndarray  # in words of the text; -1 without a match
    items: dict[int, set[str]]  # of each text that has some


def _judge(columns: list[pa.Array], blocks: list) -> list[Verdict]:
    shards = [Shard(c) for c in columns]
    edges = [np.zeros(len(s.doc) + 1, np.int64) for s in shards]
    out = [Verdict(np.diff(s.w.first), None, np.zeros(len(s.w.first) - 1, np.int64), np.full(len(s.w.first) - 1, -1), {}) for s in shards]
    for block in blocks:
        test = block.value
        for s, edge, v in zip(shards, edges, out):
            hits = s.search(test)
            if not len(hits.place):
                continue
            n = len(edge)
            edge += np.bincount(hits.place, minlength=n) - np.bincount(hits.place + hits.need, minlength=n)
            doc = s.doc[hits.place]
            pairs = np.unique(np.stack([doc, hits.first, hits.last], axis=1), axis=0)
            for d, a, b in pairs.tolist():
                found = v.items.setdefault(d, set())
                found.update([i for t in np.unique(test.item[test.windows[a : b + 1]]).tolist() if (i := test.names[t]) is not None])
            length = hits.need.copy()
            full = np.flatnonzero(hits.need == test.window)
            length[full] = s.longest(test, hits.place[full])[0]
            order = np.lexsort((hits.place, -length, doc))
            best = order[np.flatnonzero(np.r_[True, doc[order][1:] != doc[order][:-1]])]
            d, at = doc[best], hits.place[best] - s.w.first[doc[best]]
            better = (length[best] > v.n_longest[d]) | (length[best] == v.n_longest[d]) & (at < v.longest_at[d])
            v.n_longest[d[better]], v.longest_at[d[better]] = length[best][better], at[better]
    for s, edge, v in zip(shards, edges, out):
        hit = np.zeros(len(edge), np.int64)
        np.cumsum(np.cumsum(edge[:-1]) > 0, out=hit[1:])
        v.n_hit = hit[s.w.first[1:]] - hit[s.w.first[:-1]]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_longest (words of the longest match of a window or more, or of a whole shorter item; 0 without), longest_at (the first place that has it, in words from 0; -1 without) for every row."""
    df, blocks = texts_of(docs, id_col, text_col), test_blocks(benchmark, window, block_bytes=block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for slabs in _shards(batches, blocks):
            for slab, v in zip(slabs, _judge([s.column(1) for s in slabs], blocks)):
                sha, many = [nothing] * len(slab), np.zeros(len(slab), np.int64)
                for d, found in v.items.items():
                    many[d], sha[d] = len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(v.n_words), pa.array(v.n_hit), pa.array(many), pa.array(sha, pa.string()), pa.array(v.n_longest > 0), pa.array(v.n_longest), pa.array(v.longest_at)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_longest", "longest_at"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_longest long, longest_at long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of docs whose longest match is shorter than a window and than a whole item; all their columns stay."""
    blocks, names, at = test_blocks(benchmark, window), docs.columns, docs.columns.index(text_col)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(at).cast(pa.string()), *batch.columns], names=["#", "##", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slabs in _shards(own(batches), blocks):
            for slab, v in zip(slabs, _judge([s.column(1) for s in slabs], blocks)):
                yield pa.RecordBatch.from_arrays(slab.columns[2:], names=names).filter(pa.array(v.n_longest == 0))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id (string), doc_word, item_word, n_words: the maximal verbatim matches and where they begin, in words from 0. One row for each place of an item at each place of a document from which a match can grow no further to the left."""
    df, blocks = texts_of(docs, id_col, text_col), test_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slabs in _shards(batches, blocks):
            shards = [Shard(s.column(1)) for s in slabs]
            for block in blocks:
                test = block.value
                for slab, s in zip(slabs, shards):
                    hits = s.search(test)
                    k = hits.last - hits.first + 1
                    p = np.repeat(hits.place, k)
                    q = test.windows[np.repeat(hits.first - (np.cumsum(k) - k), k) + np.arange(len(p))]
                    x, a, b = s.suffixes.place[p], s.suffixes.seq, test.suffixes.seq
                    # seq has a 0 before each text but the first, so what is before a first word never matches
                    fresh = (x == 0) | (q == 0) | (a[x - 1] == 0) | (a[x - 1] != b[q - 1])
                    p, q, x, size = p[fresh], q[fresh], x[fresh], np.repeat(hits.need, k)[fresh]
                    live = np.arange(len(p))
                    while len(live):
                        live = live[(a[x[live] + size[live]] != 0) & (a[x[live] + size[live]] == b[q[live] + size[live]])]
                        size[live] += 1
                    d, item = s.doc[p], test.item[q]
                    yield pa.RecordBatch.from_arrays([slab.column(0).take(pa.array(d)), pa.array([test.names[t] for t in item.tolist()], pa.string()), pa.array(p - s.w.first[d]), pa.array(q - test.begin[item]), pa.array(size)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, item_id string, doc_word long, item_word long, n_words long")
