import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import decontaminate as d

from .helpers import documents, frame, sentence, thue_morse, words


def bench():
    rng = random.Random(9)
    items = [(i, sentence(rng, n)) for i, n in enumerate([12, 30, 10, 9, 3, 1, 25])]
    return [*items, (7, None), (8, " .,! "), (9, items[0][1]), (None, sentence(rng, 15)), (1, items[1][1])]


def rows():
    rng, b = random.Random(10), bench()
    out = documents()
    for k, (_, text) in enumerate(b):
        if text:
            w = text.split()
            out.append((800 + k, sentence(rng, 20) + " " + text.upper() + ", " + sentence(rng, 20), "en", "s", 1))
            out.append((850 + k, sentence(rng, 5) + " " + " ".join(w[1:11]) + " " + sentence(rng, 5), "en", "s", 1))
            out.append((900 + k, " ".join(w[:9]) + " other " + " ".join(w[9:]), "en", "s", 1))
    return [*out, (990, b[1][1] + " " + b[1][1], "en", "s", 1), (991, b[1][1][: len(b[1][1]) // 2], "en", "s", 1)]


def longest_from(w, a, item, k):
    """The most words of an item, k or else all of a shorter one, that stand in w from place a on."""
    best = 0
    for b in range(len(item)):
        n = 0
        while a + n < len(w) and b + n < len(item) and w[a + n] == item[b + n]:
            n += 1
        if n >= min(k, len(item)):
            best = max(best, n)
    return best


def brute(rows, items, k=10):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(k, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes, texts = {len(x) for x in windows}, [words(t) for _, t in items]
    out = Counter()
    for i, text, *_ in rows:
        w, hit, found, starts = words(text), set(), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    starts.add(a)
                    found |= windows[g]
        ids = sorted(str(x) for x in found if x is not None)
        n, at = max(((n, -a) for a in starts for item in texts if (n := longest_from(w, a, item, k))), default=(0, 1))
        out[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), n, -at] += 1
    return out


@pytest.fixture(scope="module")
def benchmark_df(spark):
    return spark.createDataFrame(bench(), "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_equals_brute_force(spark, benchmark_df, block):
    got = Counter(map(tuple, d.contamination(frame(spark, rows()), benchmark_df, block_bytes=block).collect()))
    assert got == brute(rows(), bench())
    assert sum(n for r, n in got.items() if r[5]) > 10


def test_empty_tables(spark, benchmark_df):
    assert d.contamination(frame(spark, []), benchmark_df).count() == 0
    assert not any(r.contaminated for r in d.contamination(frame(spark, rows()), benchmark_df.limit(0)).collect())


def test_decontaminated(spark, benchmark_df):
    df = frame(spark, rows())
    kept = d.decontaminated(df, benchmark_df)
    bad = brute(rows(), bench())
    assert kept.columns == df.columns and kept.count() == sum(n for r, n in bad.items() if not r[5])


def test_longest_matches(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(1, "a b " + item + " c", "en", "s", 1), (2, " ".join(item.split()[5:17]) + " z " + " ".join(item.split()[:10]), "en", "s", 1), (3, None, None, None, None)])
    got = sorted(map(tuple, d.longest_matches(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()))
    assert got == [(1, "4", 2, 0, 30), (2, "4", 0, 5, 12), (2, "4", 13, 0, 10)]


def test_words_that_arithmetic_hashes_confuse(spark):
    one, other = thue_morse(2048)
    items = spark.createDataFrame([(1, one), (2, other)], "item_id long, text string")
    docs = frame(spark, [(1, f"x {one}", "en", "s", 1), (2, f"y {other}", "en", "s", 1)])
    got = {r.doc_id: r.items_sha256 for r in d.contamination(docs, items).collect()}
    assert got == {i: hashlib.sha256(str(i).encode()).hexdigest() for i in (1, 2)}


def test_hashes_decide_nothing(spark, benchmark_df, monkeypatch):
    """With hashes of 6 bits most words share theirs with others."""
    monkeypatch.setattr(d, "words", lambda *a, f=d.words, **k: (w := f(*a, **k), setattr(w, "hashes", w.hashes & np.uint64(63)))[0])
    items = [(i, t) for i, t in bench() if i in (3, 4, 5)]
    test = d.TestSet(items, 10)
    v = d._judge([pa.array([r[1] or "" for r in rows()])], [type("B", (), {"value": test})])[0]
    want = brute(rows(), items)
    assert sorted(zip(v.n_hit.tolist(), v.n_longest.tolist())) == sorted((r[2], r[6]) for r, n in want.items() for _ in range(n))


@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_suffix_arrays(texts):
    ids, first = np.array([x for t in texts for x in t], np.int32), np.cumsum([0, *map(len, texts)])
    s = d.Suffixes(ids, first)
    said = lambda p: s.seq[p : p + s.known[p]].tolist()
    assert sorted(s.array.tolist()) == np.flatnonzero(s.seq).tolist()
    assert [said(p) for p in s.array] == sorted(map(said, s.array))


def test_clashing_columns(spark, benchmark_df):
    from pyspark.sql import functions as F

    more = benchmark_df.withColumns({c: F.lit("x") for c in ("item", "doc_id", "path", "#")})
    df = frame(spark, rows()).withColumns({"#": F.lit("a"), "##": F.lit("b")})
    assert Counter(map(tuple, d.contamination(df, more).collect())) == brute(rows(), bench())
    assert {(r["#"], r["##"]) for r in d.decontaminated(df, more).collect()} == {("a", "b")}
