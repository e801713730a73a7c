"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted on one feature at a time, in turn, and add up to one lookup table for each feature; then trees over two features are boosted in turn on the pairs that explain most of what is left, and add up to a table over both features' bins. A score is the logistic of the sum of what the bins of a text's features hold, added as arrays.

The features are ratios and counts of the text alone; labels, lang, source and id are never among them. Null texts count as empty and, like empty ones, get the score of their bins. Repeated rows get equal scores, other columns are ignored. Without two kinds of labels the model is a constant, the share of ones (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import ROWS, fetched, remainder, sample
from .quality_rules import measure
from .shared import raw, text_slabs, texts_of
from .words import NONSPACE, byte_class, mix, words

UPPER = byte_class(lambda b: 65 <= b <= 90)
DIGIT = byte_class(lambda b: 48 <= b <= 57)
STOP = byte_class(lambda b: chr(b) in ".!?")
COMMA = byte_class(lambda b: chr(b) in ",;:")
FEATURES = ("words", "length", "symbols", "copies", "repeats", "lost", "bangs", "bars", "upper", "digits", "stops", "commas", "distinct", "doubled", "lines", "line_words", "longest", "wide", "marks", "capital")


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of a column without nulls."""
    data, offsets = raw(column)
    m = measure(column)
    w = words(data, offsets, NONSPACE, fold=False)
    doc, n = w.doc(), len(offsets) - 1
    k = np.maximum(m["n_words"], 1)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]

    def by_doc(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc[flag], minlength=n)

    size = w.ends - w.starts
    longest = np.zeros(n)
    np.maximum.at(longest, doc, size)
    _, once = np.unique(w.hashes ^ mix(doc.astype(np.uint64)), return_index=True)
    doubled = np.zeros(len(doc), bool)
    doubled[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
    lines = np.maximum(np.bincount(m["lines"][0], minlength=n), 1)
    last, first = data[w.ends - 1], data[w.starts]
    chars = np.maximum(m["word_chars"], 1)
    return np.stack(
        [np.log1p(m["n_words"]), m["word_chars"] / k, m["n_symbols"] / k, m["n_dup_lines"] / lines, m["n_repeat_words"] / k, m["lost_chars"] / chars, count(data == 33) / k, count(data == 124) / k, count(UPPER[data]) / chars, count(DIGIT[data]) / chars]
        + [count(STOP[data]) / k, count(COMMA[data]) / k, np.bincount(doc[once], minlength=n) / k, by_doc(doubled) / k, np.log1p(lines), k / lines, np.log1p(longest), count(data >= 128) / chars, by_doc(~(np.char.isalnum(_chr(last)) | (last >= 128))) / k, by_doc(UPPER[first]) / k],
        axis=1,
    )


def _chr(b: np.ndarray) -> np.ndarray:
    return np.where(b < 128, b, 32).astype(np.uint8).view("S1") if len(b) else np.zeros(0, "S1")


@dataclass
class Gam:
    """cuts: of each feature; tables: a value for each bin; pairs: (i, j, table over both features' bins)."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.bins(x), np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _halves(g: np.ndarray, h: np.ndarray, least: float) -> tuple[int, float]:
    """The cut of a row of bins that gains most, and its gain."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -np.inf)
    at = int(np.argmax(gain)) if len(gain) else 0
    return at + 1, float(gain[at]) if len(gain) else -np.inf


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The Newton steps of a tree of a few leaves over one feature's bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_halves(g[a:b], h[a:b], least), a, b) for a, b in parts]
        cut, gain, a, b = max(found, key=lambda x: x[1])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """A tree of four leaves over two features' bins, a cut of one and then one of the other on either side; and its gain."""
    best, gain_of = np.zeros_like(g), -np.inf
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        cut, gain = _halves(a.sum(axis=1), b.sum(axis=1), least)
        if not np.isfinite(gain):
            continue
        out, total = np.zeros_like(a), gain
        for s in (slice(0, cut), slice(cut, None)):
            c, more = _halves(a[s].sum(axis=0), b[s].sum(axis=0), least)
            for t in (slice(0, c), slice(c, None)) if np.isfinite(more) else (slice(None),):
                out[s, t] = -a[s, t].sum() / (b[s, t].sum() + 1)
            total += max(more, 0)
        if total > gain_of:
            best, gain_of = out.T if turn else out, total
    return best, gain_of


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles, halfway between the values that are there."""
    values = np.unique(x)
    at = np.searchsorted(values, np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower")))
    at = at[at > 0]
    return (values[at] + values[at - 1]) / 2


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 8, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3, least: float = 4.0) -> Gam:
    n = len(y)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return Gam(float(np.log(share / (1 - share))))
    gam = Gam(float(np.log(y.mean() / (1 - y.mean()))))
    gam.cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    gam.tables = [np.zeros(len(c) + 1) for c in gam.cuts]
    b, z = gam.bins(x), np.full(n, gam.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(gam.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)), leaves, least)
            t += step
            z += step[b[:, f]]

    def grid(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = len(gam.tables[i]), len(gam.tables[j])
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-_tree2(*grid(i, j, g, h), least)[1], i, j) for i in range(x.shape[1]) for j in range(i)))[:pairs]
    gam.pairs = [(i, j, np.zeros((len(gam.tables[i]), len(gam.tables[j])))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, t in gam.pairs:
            step = rate * _tree2(*grid(i, j, *slopes()), least)[0]
            t += step
            z += step[b[:, i], b[:, j]]
    return gam


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held: int = 0, rows: int = ROWS) -> Gam:
    """Fit on at most `rows` labelled texts, none of them with crc32(doc_id) mod `mod` equal to `held`. Their features are made by the tasks; the driver gets these alone."""
    texts = sample(docs, labels, label, remainder("doc_id", mod) != held, rows).select("y", "text", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in text_slabs(batches):
            x = features(slab.column(1))
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), slab.column(2)], names=["y", "x", "order"])

    # in one order, so that sums and with them the trees are the same whenever it is run
    t = fetched(texts.mapInArrow(run, "y int, x array<double>, order long")).sort_by("order")
    x = np.array(t["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, (t["y"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, gam: Gam, mod: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    df = texts_of(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in text_slabs(batches):
            s = gam.score(features(slab.column(1)))
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "score", "predicted")
