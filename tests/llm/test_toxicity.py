import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from framemill.llm import toxicity as t
from framemill.llm.labelled import sample

from .helpers import frame, sentence


def texts(n, seed):
    """Toxic ones have a bad word, or words that share a bad beginning."""
    rng, out, y = random.Random(seed), [], []
    for i in range(n):
        ws = sentence(rng, rng.randrange(5, 90)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(["scoundrel", "grumblix" + rng.choice(["a", "en", "ost", "ur"])]))
        out.append(" ".join(ws))
        y.append(float(bad))
    return out, np.array(y, np.float32)


def test_slopes_are_right():
    rng = np.random.default_rng(0)
    net = t.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    ids, grams = rng.integers(0, t.WORD_BUCKETS, (3, t.WINDOW)), rng.integers(1, t.GRAM_BUCKETS, (3, t.WINDOW, t.GRAMS))
    fixed, y = rng.normal(size=(3, t.WINDOW, t.FIXED)), np.array([1.0, 0.0, 1.0])
    mask = (np.arange(t.WINDOW)[:, None] < np.array([t.WINDOW, 7, 20]))

    def loss():
        x = np.concatenate([fixed.reshape(-1, t.FIXED), net.p["word"][ids.ravel()], t.GRAM_SCALE * net.p["gram"][grams.reshape(-1, t.GRAMS)].sum(axis=1)], axis=1)
        z = net.forward(net.projected(x), np.arange(3 * t.WINDOW).reshape(3, t.WINDOW).T, mask)[0].astype(float)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    got = t._slopes(net, ids, grams, fixed, mask, y)
    for name in ("xf", "ub", "uf", "cb", "a", "v", "w", "o"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * step) - got[name][at]) < 2e-4 + 0.05 * abs(got[name][at]), name


def test_windows_cover_texts():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        text, start, size = t.windows(np.array([0, n]))
        seen = {int(a) + k for a, s in zip(start, size) for k in range(int(s))}
        assert seen == set(range(n)) and (size <= t.WINDOW).all() and (n < t.WINDOW or (size == t.WINDOW).all())


def test_learns_words_and_beginnings():
    x, y = texts(1500, 1)
    net = t.train(x, y)
    x, y = texts(400, 2)
    p = net.score(pa.array([*x, "", " . "]))
    assert ((p[:400] >= 0.3) == y).mean() > 0.97 and (p[400:] < 0.3).all()
    long = net.score(pa.array([sentence(random.Random(5), 20_000), sentence(random.Random(5), 20_000) + " scoundrel grumblixa scoundrel"]))
    assert long[1] >= 0.3 > long[0]


def test_sample(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(300)] + [(5, "another 5", "en", "s", 1), (7, None, "en", "s", 1), (8, "y " * 300_000, "en", "s", 1)]
    docs = frame(spark, [r for r in rows if r[0] != 9])
    labels = spark.createDataFrame([(i, i % 2) for i in range(280)] + [(i, 1) for i in range(5000, 9000)] + [(None, 1), (9, 1), (10, None), (4, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in sample(docs, labels, "toxic", F.lit(True), 100).collect()}
    order = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).collect() if r.doc_id < 280]
    assert set(got) == set(order[:100])
    everything = {r.doc_id: r for r in sample(docs, labels, "toxic", F.lit(True)).collect()}
    assert set(everything) == set(range(280)) - {9} and len(everything[8].text) in (6, 600_000) and everything[4].y == 1 and everything[10].y == 0
    assert sample(docs, labels.limit(0), "toxic", F.lit(True)).count() == 0


def test_network_over_tasks_equals_one_in_memory(spark):
    x, y = texts(300, 4)
    docs = frame(spark, [(i, s, "en", "s", 1) for i, s in enumerate(x)])
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    rows = sample(docs, labels, "toxic", F.lit(True)).collect()
    net, column = t.fit(docs, labels, held=-1), pa.array([r.text for r in rows], pa.large_string())
    order, target = np.array([r.order for r in rows]), np.array([r.y for r in rows])
    counts = t.bucket_counts(column, target, order & 1)
    known = [t.odds_of(c) for c in counts]
    own = t.learned(pa.Table.from_batches([t.windows_to_learn(t.Network(), column, target, order & 1, order, known)]))
    assert all(np.allclose(own.p[k], net.p[k], atol=1e-5) for k in own.p) and np.array_equal(t.odds_of(counts.sum(axis=0))[0], net.odds[0])


def test_scores_of_frames(spark):
    x, y = texts(600, 3)
    rows = [(i, s, "en", "s", 1) for i, s in enumerate(x)] + [(None, None, None, None, None), (9000, "", "en", "s", 0), (9001, None, None, None, None), (3, x[3], "en", "s", 1)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    net = t.fit(docs, labels)
    out = t.scored(docs, net).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    held = out[out.held_out & (out.doc_id < 600)]
    assert len(held) > 100 and ((held.predicted == 1) == (held.doc_id % 5 == 0)).mean() > 0.9
    kept = t.without_toxic(docs, net)
    assert kept.columns == docs.columns and kept.count() == (out.predicted == 0).sum()
    assert t.without_toxic(docs.limit(0), net).count() == 0
    assert np.ptp(out[out.doc_id == 3].score) < 1e-4 and len(out[out.doc_id == 3]) == 2
    empty = out[out.doc_id.isna() | (out.doc_id == 9000) | (out.doc_id == 9001)]
    assert np.ptp(empty.score) < 1e-4 and len(empty) == 3
    named = docs.withColumns({"#": F.lit("a"), "##": F.lit("b")})
    assert {(r["#"], r["##"]) for r in t.without_toxic(named, net).collect()} == {("a", "b")}
    flat = t.fit(docs, labels.limit(0))
    assert (t.scored(docs, flat).toPandas().score == 0).all()


def test_every_byte_of_a_word_is_read():
    four = len(t.PREFIXES)
    for word in ("a", "abcd", "donaudampfschifffahrts", "x" * 8 + "abcdefghijklmnopqrstuvwxyz0123456789", "\u8fd9\u662f\u4e00\u6bb5\u6ca1\u6709\u7a7a\u683c\u7684\u6587\u5b57" * 40):
        raw = word.encode()
        got = t.tokens(pa.array(["no", word, "no"]))
        assert got.first[0] == 0 and got.first[1] == 1 and got.first[3] - got.first[2] == 1
        own = got.kind[got.first[1] : got.first[2]]
        seen = set(got.grams[own][:, four:].ravel().tolist()) - {0}
        alone = [t.tokens(pa.array([raw[i : i + 4]], pa.binary())).grams[0, four] for i in range(len(raw) - 3)]
        assert seen == {int(g) for g in alone}
        assert len(set(got.word[own].tolist())) == 1
    assert t.tokens(pa.array(["abcdefghijklmnopqrstuvwxyz" * 9])).first[1] > 10
    a, b = (t.tokens(pa.array(["unabhaengigkeits" + x])).grams for x in ("erklaerung", "bestrebung"))
    assert (a != b).any()


def test_insults_behind_other_bytes_count():
    x, y = texts(1500, 1)
    net = t.train(x, y)
    rng = random.Random(9)
    glue = ["".join(rng.choice("abcdefghijklmnop") for _ in range(14)) for _ in range(100)]
    clean = [sentence(rng, 20) for _ in glue]
    low, high = (net.score(pa.array([f"{c} {g}{end} {c}" for c, g in zip(clean, glue)])) for end in ("", "scoundrel"))
    assert (low < 0.3).mean() > 0.9 and (high >= 0.3).mean() > 0.9
    run = "\u3042\u308a\u304c\u3068\u3046" * 30
    low, high = net.score(pa.array([run, run + "scoundrel" + run]))
    assert high >= 0.3 > low
