"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A token's input joins a word embedding with one composed of its characters (the embeddings of hashed prefixes and of the 4-grams at every byte of it) and three fixed numbers: the log odds of its word, and the sum and the largest of those of its characters' buckets. Two recurrent layers read a window in either direction, attention pools their states, and a linear layer gives the window's logit. A word of more than PIECE bytes (a compound, a run of text without spaces) is several tokens: overlapping pieces that together have all its 4-grams, each with the whole word's bucket. All overlapping windows of a text are scored; the largest logit, calibrated, is the text's score.

Training uses a bounded sample (ROWS texts, however long, read whole). The log odds of either half of it come from the other half, so that the network learns what they are worth on texts that they don't know; for scoring they come from the whole sample. Everything else is trained by back-propagation through time on windows: of texts labelled 1 the most suspect one, of the others that and random ones. A logistic over the largest logit calibrates texts. The sample's texts stay with the tasks, which count buckets, choose windows and score them; one task trains on the windows (ROWS * (1 + RANDOM) of about 2 KB at most), and the driver gets counts, logits and the network.

Null texts count as empty; texts without words score as the least suspect training text. Labels, lang, source and id are no inputs. Repeated rows get equal scores but for the last digits of 32-bit sums, whose order depends on the slab; other columns are ignored by the scores and kept by the filter. Without two kinds of labels every score is the share of ones (0 without labels).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labelled import fetched, remainder, sample
from .shared import raw, slabs, text_slabs, texts_of
from .words import FOLD, mix, words

WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 16
#: Sizes: of either embedding, of a recurrent layer's state, of the attention.
EMBED, STATE, ATTEND = 6, 12, 8
FIXED = 3
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 32, 16
PREFIXES = range(3, 9)
#: Bytes of a token, and from one piece of a longer word to the next: what has PIECE - PIECE_STEP bytes lies whole in some piece.
PIECE, PIECE_STEP = 24, 12
FOURS = range(PIECE - 3)
GRAMS = len(PREFIXES) + len(FOURS)
GRAM_SCALE = 0.3
PRIOR = 8
#: Least steps of training (three turns over the windows at least, as more of them lose on texts held out), windows of a step, and windows of a text with label 0 besides the most suspect one.
STEPS, STEP_WINDOWS, RANDOM = 200, 128, 2
#: Bytes of text whose tokens the trainer holds at a time.
TRAIN_SLAB = 1 << 18
BATCH = 4096
ROWS = 6000


@dataclass
class Tokens:
    first: np.ndarray  # of each text, its first token
    kind: np.ndarray  # of each token, the number of its distinct word or piece
    word: np.ndarray  # of each distinct one, its word's bucket
    grams: np.ndarray  # of each distinct one, its GRAMS buckets; 0 is none


def tokens(column: pa.Array) -> Tokens:
    data, offsets = raw(column)
    w = words(data, offsets)
    length = w.ends - w.starts
    k = np.maximum(1, -(-(length - PIECE) // PIECE_STEP) + 1)
    of = np.repeat(np.arange(len(k)), k)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
    keys = w.hashes[of]
    later = turn > 0
    keys[later] = mix(keys[later] + turn[later].astype(np.uint64))
    _, at, kind = np.unique(keys, return_index=True, return_inverse=True)
    turn, of = turn[at], of[at]
    size = np.minimum(length[of], PIECE)
    begin = w.starts[of] + np.minimum(turn * PIECE_STEP, length[of] - size)
    place = np.minimum(begin[:, None] + np.arange(PIECE), max(len(data) - 1, 0))
    b = FOLD[data[place]] if len(at) else np.zeros((0, PIECE), np.uint8)
    b = np.where(np.arange(PIECE) < size[:, None], b, 0)
    head = np.ascontiguousarray(b[:, :8]).view("<u8").ravel()
    grams = np.zeros((len(at), GRAMS), np.uint16)
    bucket = lambda h: h % np.uint64(GRAM_BUCKETS - 1) + np.uint64(1)
    for i, n in enumerate(PREFIXES):
        on = np.flatnonzero((size >= n) & (turn == 0))
        grams[on, i] = bucket(mix((head[on] & np.uint64((1 << 8 * n) - 1)) + (np.uint64(n) << np.uint64(56) if n < 8 else np.uint64(n))))
    for j in FOURS:
        on = np.flatnonzero(size >= j + 4)
        four = b[on, j : j + 4].astype(np.uint64)
        code = four[:, 0] | four[:, 1] << np.uint64(8) | four[:, 2] << np.uint64(16) | four[:, 3] << np.uint64(24)
        grams[on, len(PREFIXES) + j] = bucket(mix(code + np.uint64(1 << 40)))
    first = np.concatenate([[0], np.cumsum(k)])[w.first]
    return Tokens(first, kind, (w.hashes[of] % np.uint64(WORD_BUCKETS)).astype(np.int32), grams)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, tokens) of all windows: every STRIDE words, the last one ending with the text."""
    n = np.diff(first)
    k = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1))
    text = np.repeat(np.arange(len(n)), k)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    size = np.minimum(n[text], WINDOW)
    return text, first[text] + np.minimum(turn * STRIDE, n[text] - size), size


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def recur(g: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, window, STATE) of gated units over projected inputs (time, window, 3 STATE); where mask is 0 the state stays."""
    h, out, kept = np.zeros((g.shape[1], STATE), np.float32), np.empty((*g.shape[:2], STATE), np.float32), []
    for t in range(len(g)):
        a = h @ u
        zr = sigmoid(g[t, :, : 2 * STATE] + a[:, : 2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        n = np.tanh(g[t, :, 2 * STATE :] + r * a[:, 2 * STATE :])
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if keep:
            kept.append((h, z, r, n, a[:, 2 * STATE :]))
        h = out[t] = new
    return out, kept


def recur_back(d_out: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the projected inputs and of u."""
    dg, du, d = np.zeros((*d_out.shape[:2], 3 * STATE), np.float32), np.zeros_like(u), np.zeros(d_out.shape[1:], np.float32)
    for t in range(len(d_out) - 1, -1, -1):
        h, z, r, n, an = kept[t]
        d = d + d_out[t]
        stay = 0 if mask is None else np.where(mask[t][:, None], 0, d)
        d = d - stay
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        dg[t] = np.concatenate([dz, dr, dn], axis=1)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        du += h.T @ da
        d = d * z + da @ u.T + stay
    return dg, du


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": 0.05 * rng.standard_normal((WORD_BUCKETS, EMBED)).astype(np.float32), "gram": 0.05 * rng.standard_normal((GRAM_BUCKETS, EMBED)).astype(np.float32)}
        for s in "fb":
            self.p |= {f"x{s}": f(FIXED + 2 * EMBED, 3 * STATE), f"c{s}": np.zeros(3 * STATE, np.float32), f"u{s}": f(STATE, 3 * STATE)}
        self.p |= {"a": f(2 * STATE, ATTEND), "v": f(ATTEND), "w": f(2 * STATE), "o": np.zeros(1, np.float32)}
        self.p["gram"][0] = 0
        self.odds = np.zeros(WORD_BUCKETS, np.float32), np.zeros(GRAM_BUCKETS, np.float32)
        self.calibration = (1.0, 0.0)
        self.least, self.constant = -4.0, None

    def fixed(self, t: Tokens) -> np.ndarray:
        g = self.odds[1][t.grams]
        return np.stack([self.odds[0][t.word], GRAM_SCALE * g.sum(axis=1), g.max(axis=1)], axis=1)

    def inputs(self, t: Tokens) -> np.ndarray:
        chars = np.zeros((len(t.grams), EMBED), np.float32)
        for g in t.grams.T:
            on = np.flatnonzero(g)
            chars[on] += self.p["gram"][g[on]]
        return np.concatenate([self.fixed(t), self.p["word"][t.word], GRAM_SCALE * chars], axis=1)

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Logits of windows; x: projected inputs of distinct words for either direction, at: (time, window) rows of them."""
        p = self.p
        hf, kf = recur(x[0][at], p["uf"], mask, keep)
        back = None if mask is None else mask[::-1]
        hb, kb = recur(x[1][at[::-1]], p["ub"], back, keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        e = np.tanh(h @ p["a"])
        s = e @ p["v"]
        if mask is not None:
            s = np.where(mask, s, -1e9)
        s = np.exp(s - s.max(axis=0))
        alpha = s / s.sum(axis=0)
        c = np.einsum("tw,twh->wh", alpha, h)
        return c @ p["w"] + p["o"][0], (kf, kb, h, e, alpha, c)

    def projected(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(inputs @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb")

    def logits(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(text, logit) of all windows of the texts."""
        text, start, size = windows(t.first)
        x, out = self.projected(self.inputs(t)), np.zeros(len(text), np.float32)
        for full in (True, False):
            which = np.flatnonzero((size == WINDOW) == full)
            for i in range(0, len(which), BATCH):
                k = which[i : i + BATCH]
                place = start[k] + np.arange(WINDOW)[:, None]
                mask = None if full else np.arange(WINDOW)[:, None] < size[k]
                at = t.kind[place] if full else t.kind[np.where(mask, place, start[k])]
                out[k] = self.forward(x, at, mask)[0]
        return text, out

    def suspect(self, t: Tokens) -> np.ndarray:
        """The largest window logit of each text."""
        text, z = self.logits(t)
        out = np.full(len(t.first) - 1, -np.inf, np.float32)
        np.maximum.at(out, text, z)
        return np.where(np.isfinite(out), out, self.least)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.suspect(tokens(column)).astype(float) + b)))


def bucket_counts(column: pa.Array, y: np.ndarray, half: np.ndarray) -> np.ndarray:
    """(half, label, bucket): how many texts have a word bucket or, after these, a gram bucket; and last how many texts there are."""
    out = np.zeros((2, 2, WORD_BUCKETS + GRAM_BUCKETS + 1), np.int64)
    for a, b in slabs(column, TRAIN_SLAB):
        t = tokens(column.slice(a, b - a))
        text = np.repeat(np.arange(b - a), np.diff(t.first))
        pairs = np.unique(text * len(t.word) + t.kind) if len(text) else np.zeros(0, np.int64)
        text, kind = pairs // max(len(t.word), 1), pairs % max(len(t.word), 1)
        group = 2 * half[a:b] + (y[a:b] > 0)
        for at, size, of in ((0, WORD_BUCKETS, t.word[:, None]), (WORD_BUCKETS, GRAM_BUCKETS, t.grams)):
            seen = np.unique((text[:, None] * size + of[kind]).ravel())
            for g in range(4):
                out[g // 2, g % 2, at : at + size] += np.bincount((seen % size)[group[seen // size] == g], minlength=size)
        out[..., -1] += np.bincount(group, minlength=4).reshape(2, 2)
    return out


def odds_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of label 1 among the texts that have a word or gram bucket, over those among all; shrunk as if PRIOR more texts had the usual share. counts: (label, bucket)."""
    (no, yes), (n0, n1) = counts[:, :-1], counts[:, -1]
    share = (n1 + 0.5) / (n0 + n1 + 1)
    q = (yes + PRIOR * share) / (yes + no + PRIOR)
    out = (np.log(q / (1 - q)) - np.log(share / (1 - share))).astype(np.float32)
    out[WORD_BUCKETS] = 0
    return out[:WORD_BUCKETS], out[WORD_BUCKETS:]


WINDOW_FIELDS = (("word", "<u2", 1), ("grams", "<u2", GRAMS), ("fixed", "<f4", FIXED))


def windows_to_learn(net: Network, column: pa.Array, y: np.ndarray, half: np.ndarray, order: np.ndarray, known: list) -> pa.RecordBatch:
    """order, turn, y, n (tokens), and the tokens of each window to be trained on. A text's odds are those of the other half."""
    rows: list[tuple] = []
    for h in (0, 1):
        net.odds, own = known[1 - h], np.flatnonzero(half == h)
        some = column.take(pa.array(own))
        for a, b in slabs(some, TRAIN_SLAB):
            t = tokens(some.slice(a, b - a))
            text, start, n = windows(t.first)
            fixed, top = net.fixed(t), np.zeros(len(text), np.float32)
            suspect = fixed[:, 0] + fixed[:, 2]
            for i in range(0, len(text), BATCH):
                place = start[i : i + BATCH, None] + np.minimum(np.arange(WINDOW), (n[i : i + BATCH] - 1)[:, None])
                top[i : i + BATCH] = suspect[t.kind[place]].max(axis=1)
            ends = np.searchsorted(text, np.arange(b - a + 1))
            for d in range(b - a):
                x, i, j = own[a + d], ends[d], ends[d + 1]
                if i == j:
                    continue
                best = i + int(np.argmax(top[i:j]))
                chosen = {best} if y[x] > 0 else {best, *np.random.default_rng(abs(int(order[x]))).choice(np.arange(i, j), min(RANDOM, j - i), replace=False).tolist()}
                for turn, k in enumerate(sorted(chosen)):
                    at = t.kind[start[k] + np.minimum(np.arange(WINDOW), n[k] - 1)]
                    rows.append((int(order[x]), turn, float(y[x] > 0), int(n[k]), t.word[at].astype("<u2").tobytes(), t.grams[at].astype("<u2").tobytes(), fixed[at].astype("<f4").tobytes()))
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.float32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["order", "turn", "y", "n", *(f for f, _, _ in WINDOW_FIELDS)])


WINDOW_SCHEMA = "order long, turn int, y float, n int, word binary, grams binary, fixed binary"


def learned(rows: pa.Table, rate: float = 0.01, seed: int = 5) -> Network:
    """A network without odds and calibration from rows of windows_to_learn, taken in their order."""
    net, rng = Network(seed), np.random.default_rng(seed)
    rows = rows.sort_by([("order", "ascending"), ("turn", "ascending"), ("y", "ascending"), ("n", "ascending")])
    ids, grams, fixed = (np.frombuffer(b"".join(rows[f].to_pylist()), kind).reshape(len(rows), WINDOW, k) for f, kind, k in WINDOW_FIELDS)
    ids, target = ids[..., 0], rows["y"].to_numpy()
    masks = np.arange(WINDOW) < rows["n"].to_numpy()[:, None]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, per = 0, -(-len(target) // STEP_WINDOWS)
    epochs = min(12, max(3, -(-STEPS // per)))
    for epoch in range(epochs):
        turn = rng.permutation(len(target))
        for i in range(0, len(turn), STEP_WINDOWS):
            step += 1
            k = turn[i : i + STEP_WINDOWS]
            speed = rate * 0.2 ** (epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for name, g in _slopes(net, ids[k], grams[k], fixed[k], masks[k].T, target[k]).items():
                m, v = moments[name]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * (g * g)
                net.p[name] -= np.float32(speed) * m / (np.sqrt(v) + np.float32(1e-6))
            net.p["gram"][0] = 0
    return net


def suspects(net: Network, column: pa.Array, half: np.ndarray, known: list) -> np.ndarray:
    """The largest logit of each text under the odds of the other half."""
    z = np.zeros(len(column))
    for h in (0, 1):
        net.odds, own = known[1 - h], np.flatnonzero(half == h)
        some = column.take(pa.array(own))
        for a, b in slabs(some, TRAIN_SLAB):
            z[own[a:b]] = net.suspect(tokens(some.slice(a, b - a)))
    return z


def _constant(counts: np.ndarray) -> Network | None:
    """What to do without two kinds of labels."""
    n0, n1 = counts[..., -1].sum(axis=0)
    if n0 and n1:
        return None
    net = Network()
    net.constant = float(n1 > 0)
    return net


def _finished(net: Network, counts: np.ndarray, z: np.ndarray, y: np.ndarray) -> Network:
    net.least, net.calibration, net.odds = float(z.min()), _logistic(z, y), odds_of(counts.sum(axis=0))
    return net


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
    """The steps of `fit` over texts in memory."""
    column, y, order = pa.array(texts, pa.large_string()), np.asarray(y), np.random.default_rng(seed).permutation(len(texts))
    half = order & 1
    counts = bucket_counts(column, y, half)
    if net := _constant(counts):
        return net
    known = [odds_of(c) for c in counts]
    net = learned(pa.Table.from_batches([windows_to_learn(Network(seed), column, y, half, order, known)]), seed=seed)
    return _finished(net, counts, suspects(net, column, half, known), y)


def _slopes(net: Network, ids: np.ndarray, grams: np.ndarray, fixed: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, n = net.p, len(y)
    flat = grams.reshape(-1, GRAMS)
    x = np.concatenate([fixed.reshape(-1, FIXED), p["word"][ids.ravel()], GRAM_SCALE * p["gram"][flat].sum(axis=1)], axis=1)
    at = np.arange(n * WINDOW).reshape(n, WINDOW).T
    logit, (kf, kb, h, e, alpha, c) = net.forward(net.projected(x), at, mask, keep=True)
    d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
    out = {"w": c.T @ d, "o": d.sum(keepdims=True)}
    dc = d[:, None] * p["w"]
    dh = alpha[..., None] * dc
    da = np.einsum("twh,wh->tw", h, dc)
    ds = alpha * (da - (alpha * da).sum(axis=0))
    out["v"] = np.einsum("tw,twa->a", ds, e)
    de = ds[..., None] * p["v"] * (1 - e * e)
    out["a"] = h.reshape(-1, 2 * STATE).T @ de.reshape(-1, ATTEND)
    dh = dh + de @ p["a"].T
    dx = np.zeros_like(x)
    for s, kept, dhs, m in (("f", kf, dh[..., :STATE], mask), ("b", kb, dh[::-1, :, STATE:], mask[::-1])):
        dg, out[f"u{s}"] = recur_back(dhs, kept, p[f"u{s}"], m)
        if s == "b":
            dg = dg[::-1]
        dg = dg.transpose(1, 0, 2).reshape(-1, 3 * STATE)
        out[f"x{s}"], out[f"c{s}"] = x.T @ dg, dg.sum(axis=0)
        dx += dg @ p[f"x{s}"].T
    out["word"], out["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(out["word"], ids.ravel(), dx[:, FIXED : FIXED + EMBED])
    row, column = np.nonzero(flat)
    np.add.at(out["gram"], flat[row, column], GRAM_SCALE * dx[row, FIXED + EMBED :])
    return out


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of y's log odds over z, by Newton's method with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a * z + b)))
        w, r = q * (1 - q) + 1e-6, y - q
        hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(hess, [(r * z).sum() - 1e-2 * (a - 1), r.sum() - 1e-2 * b])
        a, b = max(a + float(np.clip(da, -1, 1)), 0.0), b + float(np.clip(db, -2, 2))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held: int = 2, rows: int = ROWS) -> Network:
    """Train on at most `rows` labelled texts, none of them with crc32(doc_id) mod `mod` equal to `held`. No text comes to the driver."""
    spark = docs.sparkSession
    texts = sample(docs, labels, label, remainder("doc_id", mod) != held, rows).select("order", "text", "y")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for slab in text_slabs(batches, TRAIN_SLAB):
            order = slab.column(0).to_numpy()
            yield slab.column(1), slab.column(2).to_numpy(), order & 1, order

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((bucket_counts(column, y, half) for column, y, half, _ in parts(batches)), np.zeros(1, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([total.ravel()[at].astype("<i4").tobytes()], pa.binary())], names=["at", "n"])

    counts = np.zeros(4 * (WORD_BUCKETS + GRAM_BUCKETS + 1), np.int64)
    for at, n in texts.mapInArrow(count, "at binary, n binary").toLocalIterator():
        counts[np.frombuffer(at, "<i4")] += np.frombuffer(n, "<i4")
    counts = counts.reshape(2, 2, -1)
    if net := _constant(counts):
        return net
    known = [odds_of(c) for c in counts]
    sent = spark.sparkContext.broadcast(known)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        for column, y, half, order in parts(batches):
            yield windows_to_learn(net, column, y, half, order, sent.value)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learned(pa.Table.from_batches(found)).p)], pa.binary())], names=["p"])

    net, got = Network(), texts.mapInArrow(choose, WINDOW_SCHEMA).repartition(1).mapInArrow(learn, "p binary").first()
    if got:
        net.p = pickle.loads(got.p)
    model = spark.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column, y, half, _ in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(suspects(model.value, column, half, sent.value)), pa.array(y)], names=["z", "y"])

    t = fetched(texts.mapInArrow(judge, "z double, y int")).sort_by([("z", "ascending"), ("y", "ascending")])
    return _finished(net, counts, t["z"].to_numpy(), (t["y"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, net: Network, mod: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    df, sent = texts_of(docs, "doc_id", "text"), docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in text_slabs(batches):
            s = sent.value.score(slab.column(1))
            yield pa.RecordBatch.from_arrays([slab.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, net: Network, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold; all their columns stay."""
    sent, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in text_slabs([pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(at).cast(pa.string()), *batch.columns], names=["#", "##", *batch.schema.names])]):
                yield pa.RecordBatch.from_arrays(slab.columns[2:], names=batch.schema.names).filter(pa.array(sent.value.score(slab.column(1)) < threshold))

    return docs.mapInArrow(run, docs.schema)
