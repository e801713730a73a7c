"""N-gram Jaccard self-join by chosen paths.

A text's set is that of its word 5-grams (words as in words.ALNUM, A-Z lower-cased; a text of fewer words has all of them as its only element; texts without words have no set and no links). Elements are compared by 64-bit hashes; texts are one node if their sets have equal fingerprints of 192 bits, made from two independent hashes of every element.

Every node follows paths of sampled shared tokens: in each run the root splits all nodes by one sampled token (the element that a run's random order puts first, a coordinate of a MinHash signature), and a bucket of more than LIMIT nodes splits again on SPLITS more tokens that its path draws. Small buckets are compared by brute force. So are, in pairs of blocks, buckets that splitting no longer makes smaller (texts that are nearly all alike) or that are DEPTH levels deep, so no bucket is capped. Runs are repeated until a pair at the threshold has met with probability `recall`.

A pair is judged in one bucket only, the least of the leaves that both nodes are in, so no list of pairs needs to be made distinct. First signatures alone decide who has a possible partner in which bucket (a pair with fewer equal coordinates than `agreement_for` gives isn't: at the threshold that is a tenth as likely as never to meet), then only those nodes' sets are made again from their texts, sent to these buckets and compared exactly. A bucket gives each node's count of links, weighted by the copies that the other has, and a spanning forest of its links, never a list of all pairs. Classes are the connected components.

Joins on keys that many rows can have (a path, an end of a link, a class, a set) broadcast those with over 1/2000 of the rows, see shared.hot_joined. Texts are shuffled only if over SENT nodes are compared exactly; else these are sent to the texts.

Result: one row per row of the input. Null ids keep their rows (the class id is the least id that isn't null). Repeated rows are copies. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_joined, raw, shared_dir, text_slabs, texts_of, written
from .words import grams, mix, words

#: Coordinates of a signature, unless the runs of a low similarity need more, and the most there can be.
COORDINATES, MOST = 64, 1024
#: Nodes of a bucket, or of one side of a pair of blocks, that are compared in one place.
LIMIT = 1024
SPLITS = 2
DEPTH = 4
#: Nodes to be compared exactly that are broadcast to their texts (under 100 bytes each).
SENT = 500_000
_rng = np.random.default_rng(8128)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_A = np.concatenate([_A, _rng.integers(1, 1 << 63, MOST - COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
_B = np.concatenate([_B, _rng.integers(0, 1 << 63, MOST - COORDINATES, dtype=np.uint64)])


def runs_for(similarity: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, even if its buckets split to the last level."""
    one = similarity * (1 - (1 - similarity) ** SPLITS) ** (DEPTH - 1)
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))
    if runs > MOST // 2:
        raise ValueError(f"similarity {similarity} at recall {recall} needs {runs} runs; {MOST // 2} are possible")
    return runs


def coordinates_for(runs: int) -> int:
    """Coordinates of a signature: half of them at least are left to splits."""
    return max(COORDINATES, 2 * runs)


def agreement_for(similarity: float, recall: float, coordinates: int) -> int:
    """The most equal coordinates that a pair at the threshold falls short of with probability (1 - recall) / 10 at most (a binomial tail)."""
    below, least = 0.0, 0
    while least < coordinates:
        below += math.comb(coordinates, least) * similarity**least * (1 - similarity) ** (coordinates - least)
        if below > (1 - recall) / 10:
            break
        least += 1
    return least


def sets(column: pa.Array, k: int, marked: bool = False) -> tuple[list[np.ndarray], list[bytes | None]]:
    """Sorted distinct shingle hashes of each text; with `marked`, their fingerprints as well (None for texts without words)."""
    data, offsets = raw(column)
    w = words(data, offsets)
    other = w.other_hashes() if marked else w.hashes
    g, g2 = grams(w.hashes, k), grams(other, k) if marked else None
    out, marks = [], []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            s = g[a : b - k + 1]
            order = np.argsort(s) if marked else None
            s = s[order] if marked else np.sort(s)
            new = np.r_[True, s[1:] != s[:-1]]
            out.append(s[new])
            if marked:
                marks.append(fingerprint(out[-1], g2[a : b - k + 1][order[new]]))
        else:
            size = np.uint64(b - a)
            out.append(grams(w.hashes[a:b], b - a) ^ size if b > a else g[:0])
            if marked:
                marks.append(fingerprint(out[-1], grams(other[a:b], b - a) ^ size) if b > a else None)
    return out, marks


def fingerprint(s: np.ndarray, other: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) + int(other.sum(dtype=np.uint64)).to_bytes(8, "little")


def signatures(parts: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """MinHash values (uint32) of each set; zeros for empty ones."""
    out = np.zeros((len(parts), coordinates), np.uint32)
    full = [i for i, s in enumerate(parts) if len(s)]
    if full:
        h = np.concatenate([parts[i] for i in full])
        starts = np.cumsum([0, *(len(parts[i]) for i in full[:-1])])
        for c in range(coordinates):
            out[full, c] = np.minimum.reduceat((h * _A[c] + _B[c]) >> np.uint64(32), starts).astype(np.uint32)
    return out


def _child(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix(path * np.uint64(0x9E3779B97F4A7C15) + (coordinate.astype(np.uint64) << np.uint64(32)) + value.astype(np.uint64)).view(np.int64)


def _sized(nodes: DataFrame, path: str, rows: int) -> DataFrame:
    """Nodes (path, fp, above) with their bucket's size, without those alone in theirs; rows: about how many there are."""
    size = nodes.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    return written(hot_joined(nodes, size, "path", "size", rows, ["fp"]).where("size is not null"), path)


def grouped(f: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]], key: str) -> Callable:
    """For mapInArrow over rows sorted by key: f gets one key's rows at a time, whatever batches they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:]):
                if held and k[a] != last:
                    yield from f(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = k[a]
        if held:
            yield from f(pa.Table.from_batches(held))

    return run


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _possible(t: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a bucket's rows that are to be judged in it: in both blocks if it has two, in no lesser leaf together, with at least `least` equal coordinates."""
    n, home = len(t), t["leaf"][0].as_py()
    lo, hi, block = t["lo"][0].as_py(), t["hi"][0].as_py(), t["block"].to_numpy()
    left = np.flatnonzero(block == lo)
    right = left if lo == hi else np.flatnonzero(block == hi)
    sig = _matrix(t["sig"], "<u2")
    lists = [x[x < home] for x in (np.array(y, np.int64) for y in t["leaves"].to_pylist())]
    step = max(1, (1 << 21) // max(1, len(right) * 8))
    values, code = np.unique(np.concatenate(lists), return_inverse=True)
    member = np.zeros((n, len(values)), np.float32) if len(values) * n <= 1 << 22 else None
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    if member is not None:
        member[row, code] = 1
    for at in range(0, len(left), step):
        a = left[at : at + step]
        agree = np.zeros((len(a), len(right)), np.uint8 if sig.shape[1] < 256 else np.uint16)
        for c in range(sig.shape[1]):
            agree += sig[a, c][:, None] == sig[right, c][None, :]
        i, j = np.nonzero(agree >= least)
        i, j = a[i], right[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        if len(i) and len(values):
            if member is not None:
                first = np.concatenate([(member[i[x : x + 65536]] * member[j[x : x + 65536]]).any(axis=1) for x in range(0, len(i), 65536)])
            else:
                first = np.array([len(np.intersect1d(lists[x], lists[y], assume_unique=True)) > 0 for x, y in zip(i.tolist(), j.tolist())])
            i, j = i[~first], j[~first]
        if len(i):
            yield i, j


def _wanted(least: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """The nodes of a bucket that have a possible partner there."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(len(t), bool)
        for i, j in _possible(t, least):
            keep[i] = keep[j] = True
        if keep.any():
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _linked(similarity: float, least: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Exact comparison of a bucket: each node's links, and a forest of them."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(t)
        parts = [np.frombuffer(x, "<u8") for x in t["elements"].to_pylist()]
        size = np.array([len(x) for x in parts])
        copies, fps = t["copies"].to_numpy(), t["fp"].to_pylist()
        links, top = np.zeros(n, np.int64), list(range(n))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        dense = None
        for i, j in _possible(t, least):
            if dense is None and len(i) > 8 * n:
                dense = _incidence(parts)
            if dense is not None:
                both = np.concatenate([_both(dense, i[x : x + 8192], j[x : x + 8192]) for x in range(0, len(i), 8192)])
            else:
                both = np.array([len(np.intersect1d(parts[x], parts[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())])
            ok = both >= similarity * (size[i] + size[j] - both) - 1e-9
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for x, y in zip(i.tolist(), j.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    top[max(x, y)] = min(x, y)
        out = [x for x in range(n) if links[x]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([fps[x] for x in out], pa.binary()), pa.array([fps[find(x)] for x in out], pa.binary()), pa.array(links[out])], names=["fp", "other", "links"])

    return run


def _incidence(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Bit rows of which elements a set has, without elements that only one set has."""
    values, code, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    keep = count[code] > 1
    width = int((count > 1).sum())
    owner, code = owner[keep], number[code[keep]]
    bits = np.zeros((len(parts), (width + 63) // 64 or 1), np.uint64)
    np.bitwise_or.at(bits, (owner, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return bits


def _both(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.bitwise_count(bits[i[x : x + 512]] & bits[j[x : x + 512]]).sum(axis=1, dtype=np.int64) for x in range(0, len(i), 512)])


def components(edges: DataFrame, top: str) -> DataFrame:
    """(node, label): the least node of each node's component, by alternating large and small stars. Every step is written; a node of very many edges is only aggregated by min, and its minimum broadcast."""
    e, step, before = edges.selectExpr("fp as a", "other as b").where("a <> b"), 0, None
    rows = e.count()
    while True:
        both = e.union(e.selectExpr("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        star = hot_joined(both, low, "a", "n", 2 * rows, ["b"])
        e = star.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        e = written(e, f"{top}/large{step}")
        low = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        star = hot_joined(e, low, "a", "n", rows, ["b"])
        e = star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = written(e, f"{top}/small{step}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.selectExpr("a as node", "b as label")
        rows, before, step = now[0], now, step + 1


def linked_rows(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, label (of the class), class_id, n_links for every row of docs."""
    spark = docs.sparkSession
    top, runs = shared_dir(spark), runs_for(similarity, recall)
    coordinates = coordinates_for(runs)
    agreement = agreement_for(similarity, recall, coordinates)
    df = texts_of(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    parallel = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in text_slabs(batches):
            parts, marks = sets(slab.column(1), shingle, marked=True)
            sig = signatures(parts, coordinates)
            yield pa.RecordBatch.from_arrays([slab.column(0), slab.column(2), pa.array(range(len(slab)), pa.int32()), pa.array(marks, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "text_hash", "place", "fp", "sig"])

    rows = written(df.withColumn("text_hash", F.xxhash64("text")).mapInArrow(signed, f"doc_id {kind}, text_hash long, place int, fp binary, sig binary"), f"{top}/rows")
    nodes = written(rows.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("text_hash"), F.count("*").alias("copies"), F.min("sig").alias("sig")), f"{top}/nodes")

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column(1), "<u4") if len(b) else np.zeros((0, coordinates), np.uint32)
            run = np.tile(np.arange(runs), len(b))
            path = _child(np.zeros(len(run), np.uint64), run, sig[:, :runs].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(path), b.column(0).take(pa.array(np.repeat(np.arange(len(b)), runs)))], names=["path", "fp"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            path = b.column(0).to_numpy().view(np.uint64)
            sig = _matrix(b.column(3), "<u4")
            # a path draws among the coordinates that no run has at its root
            c = np.stack([(mix(path + np.uint64(7 * s + 1)) % np.uint64(coordinates - runs)).astype(np.int64) + runs for s in range(SPLITS)], axis=1)
            c[:, 1:] = np.where(c[:, 1:] == c[:, :1], runs + (c[:, 1:] - runs + 1) % (coordinates - runs), c[:, 1:])
            child = _child(np.repeat(path, SPLITS), c.ravel(), sig[np.repeat(np.arange(len(b)), SPLITS), c.ravel()])
            at = pa.array(np.repeat(np.arange(len(b)), SPLITS))
            yield pa.RecordBatch.from_arrays([pa.array(child), b.column(1).take(at), b.column(2).take(at)], names=["path", "fp", "above"])

    n = nodes.count()
    level = _sized(nodes.select("fp", "sig").mapInArrow(root, "path long, fp binary").withColumn("above", F.lit(n).cast("long")), f"{top}/level1", n * runs)
    leaves = []
    for depth in range(1, DEPTH + 1):
        final = F.col("size") <= LIMIT
        if depth > 1:
            final |= F.col("size") * 2 > F.col("above")
        if depth == DEPTH:
            final = F.lit(True)
        leaves.append(level.where(final).select("path", "fp", "size"))
        big = level.where(~final)
        many = 0 if depth == DEPTH else big.count()
        if not many:
            break
        level = _sized(big.select("path", "fp", F.col("size").alias("above")).join(nodes.select("fp", "sig"), "fp").select("path", "fp", "above", "sig").mapInArrow(split, "path long, fp binary, above long"), f"{top}/level{depth + 1}", many * SPLITS)
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.union(x)

    short = F.expr("unhex(regexp_replace(hex(sig), '(.{4}).{4}', '$1'))")  # of each coordinate its low 16 bits
    known = written(leaf.groupBy("fp").agg(F.sort_array(F.collect_set("path")).alias("leaves")).join(nodes, "fp").select("fp", "leaves", "copies", short.alias("sig"), "doc_id", "text_hash"), f"{top}/known")
    blocks = F.ceil(F.col("size") / LIMIT)
    placed = leaf.distinct().withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("fp", F.col("path").alias("leaf"), "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    placed = placed.withColumn("bucket", F.xxhash64("leaf", "lo", "hi"))
    order = ["bucket", "leaf", "lo", "hi", "block", "fp", "leaves", "copies", "sig"]
    schema = "bucket long, leaf long, lo long, hi long, block long, fp binary, leaves array<long>, copies long, sig binary"
    first = placed.join(known, "fp").select(order).repartition(parallel, "bucket").sortWithinPartitions("bucket").mapInArrow(grouped(_wanted(agreement), "bucket"), schema)
    first = written(first, f"{top}/wanted")

    wanted = written(first.select("fp").distinct().join(known, "fp").select("fp", "doc_id", "text_hash"), f"{top}/partners")
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)

    def remade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in text_slabs(batches):
            parts, marks = sets(slab.column(1), shingle, marked=True)
            keep = [i for i, m in enumerate(marks) if m == slab.column(0)[i].as_py()]
            yield pa.RecordBatch.from_arrays([slab.column(0).take(pa.array(keep, pa.int64())), pa.array([parts[i].tobytes() for i in keep], pa.binary())], names=["fp", "elements"])

    texts = df.withColumn("text_hash", F.xxhash64("text")).alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.text_hash = w.text_hash")).select("fp", "text").mapInArrow(remade, "fp binary, elements binary").dropDuplicates(["fp"])
    found = first.join(texts, "fp").select(*order, "elements").repartition(parallel, "bucket").sortWithinPartitions("bucket").mapInArrow(grouped(_linked(similarity, agreement), "bucket"), "fp binary, other binary, links long")
    found = written(found, f"{top}/links")

    label = components(found, top)
    linked = found.groupBy("fp").agg(F.sum("links").alias("links")).join(label, F.col("fp") == F.col("node"), "left").select("fp", "links", F.coalesce("label", "fp").alias("label")).join(nodes.select("fp", "doc_id"), "fp")
    linked = written(linked, f"{top}/linked")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    classed = hot_joined(linked, least, "label", "n", linked.count(), ["fp"])
    classes = nodes.join(classed.select("fp", "label", "links", "class_id"), "fp", "left")
    classes = written(classes.select("fp", "copies", F.coalesce("label", "fp").alias("label"), F.coalesce("class_id", "doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), f"{top}/classes")
    out = hot_joined(rows.select("doc_id", "text_hash", "place", "fp"), classes, "fp", "copies", rows.count(), ["doc_id", "text_hash", "place"])
    return out.select("doc_id", "text_hash", "fp", "label", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.99999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its connected component), n_links (other rows at `similarity` or more) for every row."""
    return linked_rows(docs, similarity, shingle, recall, id_col, text_col).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each class: that of the least id stays, ids before nulls. Rows without words all stay."""
    rows = linked_rows(docs, similarity, shingle, id_col=id_col, text_col=text_col)
    rank = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    own = f"#{uuid.uuid4().hex}"
    first = rows.where("fp is not null").groupBy("label").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias(f"{own}id"), F.col("r.text_hash").alias(f"{own}h"))
    first = written(first.distinct(), shared_dir(docs.sparkSession))
    keyed = docs.withColumn(f"{own}t", F.xxhash64(F.col(text_col).cast("string")))
    kept = keyed.join(first, F.col(id_col).eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}t") == F.col(f"{own}h")), "left_semi").dropDuplicates([id_col, f"{own}t"])
    none = docs.where(~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"))
    return kept.drop(f"{own}t").unionByName(none)
