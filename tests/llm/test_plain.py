"""The classifiers' queries and the whole pipeline against plain loops over single texts."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline as p
from framemill.llm import quality_gam as g
from framemill.llm import quality_rules as q
from framemill.llm import queries
from framemill.llm import toxicity as t
from framemill.llm.bpe import load_ranks
from framemill.llm.secret_scan import BASE, MORE

from .helpers import SCHEMA, documents, sentence, words
from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as joined
from .test_quality import W, brute as measured
from .test_secrets import brute as spans


def plain_features(text):
    n, chars, symbols, dups, repeats, _ = measured(text)
    ws, k, c = W.findall(text), max(n, 1), max(chars, 1)
    lines = max(sum(1 for x in text.split("\n") if x), 1)
    lost = int(q.measure(pa.array([text]))["lost_chars"][0])
    count = lambda kind: len(re.findall(kind, text))
    marks = sum(1 for w in ws if ord(w[-1]) < 128 and not w[-1].isalnum())
    return [
        math.log1p(n), chars / k, symbols / k, dups / lines, repeats / k, lost / c, count("!") / k, count(r"\|") / k, count("[A-Z]") / c, count("[0-9]") / c, count("[.!?]") / k, count("[,;:]") / k, len(set(ws)) / k,
        sum(a == b for a, b in zip(ws, ws[1:])) / k, math.log1p(lines), k / lines, math.log1p(max((len(w.encode()) for w in ws), default=0)), sum(b >= 128 for b in text.encode()) / c, marks / k, sum("A" <= w[0] <= "Z" for w in ws) / k,
    ]


def plain_quality(gam, text):
    bins = [bisect.bisect_right(list(c), x) for c, x in zip(gam.cuts, plain_features(text))]
    z = gam.base + sum(table[b] for table, b in zip(gam.tables, bins)) + sum(table[bins[i], bins[j]] for i, j, table in gam.pairs)
    return 1 / (1 + math.exp(-z))


def plain_toxicity(net, text):
    tokens = []
    for w in words(text):
        got = t.tokens(pa.array([w]))
        tokens += [(int(got.word[k]), got.grams[k].astype(int)) for k in got.kind.tolist()]
    x = []
    for word, grams in tokens:
        odds = net.odds[1][grams]
        x.append(np.concatenate([[net.odds[0][word], t.GRAM_SCALE * odds.sum(), odds.max()], net.p["word"][word], t.GRAM_SCALE * sum(net.p["gram"][k] for k in grams)]))
    starts = sorted({*range(0, max(1, len(x) - t.WINDOW + 1), t.STRIDE), max(0, len(x) - t.WINDOW)})
    logits = [plain_window(net.p, x[a : a + t.WINDOW]) for a in starts] if x else [net.least]
    a, b = net.calibration
    return 1 / (1 + math.exp(-(a * max(logits) + b)))


def plain_window(p, x):
    def read(x, s):
        h, out = np.zeros(t.STATE), []
        for v in x:
            i, r = v @ p[f"x{s}"] + p[f"c{s}"], h @ p[f"u{s}"]
            z, k = (1 / (1 + np.exp(-(i[j * t.STATE : (j + 1) * t.STATE] + r[j * t.STATE : (j + 1) * t.STATE]))) for j in (0, 1))
            new = np.tanh(i[2 * t.STATE :] + k * r[2 * t.STATE :])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    h = [np.concatenate(s) for s in zip(read(x, "f"), read(x[::-1], "b")[::-1])]
    weight = np.array([np.exp(np.tanh(s @ p["a"]) @ p["v"]) for s in h])
    return float(sum(w * s for w, s in zip(weight / weight.sum(), h)) @ p["w"] + p["o"][0])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, top = random.Random(12), str(tmp_path_factory.mktemp("sf"))
    item = sentence(rng, 25)
    rows, labels = [], []
    for i in range(300):
        text = sentence(rng, rng.randrange(15, 120)) + rng.choice([".", "!\n", " | a | b | c\n" * 3, ""])
        if i % 4 == 0:
            text += " scoundrel " + sentence(rng, 5) + " scoundrel"
        labels.append((i, int(i % 3 > 0), int(i % 4 == 0)))
        rows.append((i, text, "en", "s", len(text)))
    rows += [(1000 + i, rows[1][1] + ("" if i % 2 else "!"), "en", "s", 1) for i in range(5)]
    rows += [(1100, "before it " + item + " after it", "en", "s", 1), (1101, "my password = abcdefghijklmnop and more words", "en", "s", 1), (1102, None, None, None, None), (1103, "", "en", "s", 0), (1, rows[1][1], "en", "s", 1)]
    rows += [(2000 + k, r[1], *r[2:]) for k, r in enumerate(documents()) if r[0] is not None and len(r[1] or "") < 20_000]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, [(1, item)]


def near(got, want):
    """Equal rows but for the last digits of scores."""
    got, want = sorted(got), sorted(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4) and (a[3] == b[3] or abs(b[2] - 0.3) < 1e-3)


def test_quality_query(spark, tables):
    top, rows, _ = tables
    docs, labels = (spark.read.parquet(f"{top}/{n}.parquet") for n in ("documents", "labels"))
    gam = g.train(docs, labels)
    want = [(i, zlib.crc32(str(i).encode()) % 5 == 0, s := plain_quality(gam, text or ""), int(s >= 0.3)) for i, text, *_ in rows]
    near(map(tuple, queries.op4_quality_classifier(spark, top).collect()), want)
    assert len({round(w[2], 3) for w in want}) > 10


def test_toxicity_query(spark, tables):
    top, rows, _ = tables
    docs, labels = (spark.read.parquet(f"{top}/{n}.parquet") for n in ("documents", "labels"))
    net = t.fit(docs, labels)
    want = [(i, zlib.crc32(str(i).encode()) % 4 == 2, s := plain_toxicity(net, text or ""), int(s >= 0.3)) for i, text, *_ in rows]
    near(map(tuple, queries.op9_toxicity(spark, top).collect()), want)
    assert sum(w[3] for w in want) > 50


def test_whole_pipeline(spark, tables):
    top, rows, items = tables
    net = t.fit(*(spark.read.parquet(f"{top}/{n}.parquet") for n in ("documents", "labels")))
    kept = [r for r in rows if plain_toxicity(net, r[1] or "") < 0.3]
    classes = joined(kept)
    single, seen = [], set()
    by_id = {i: c for i, c, _ in classes}
    for r in kept:
        if not words(r[1]) or by_id[r[0]] == r[0] and r[0] not in seen:
            single.append(r)
            seen.add(r[0])
    bad = {k[0] for k in contaminated(single, items) if k[5]}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, text, *_ in single:
        if i in bad:
            continue
        parts, done = [], 0
        for a, _, b in spans(text or "", BASE + MORE):
            if a >= done:
                parts += [(text or "")[done:a], "[secret]"]
            done = max(done, b)
        said = "".join(parts) + (text or "")[done:]
        ids = enc.encode_ordinary(said)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in p.run(spark, top).collect())
    assert got == want and len(bad) == 1 and len(want) < len(rows) - 70
