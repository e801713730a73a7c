import random
from collections import Counter

import pytest

from framemill.llm import jaccard_join as j

from .helpers import documents, frame, key, sentence, thue_morse, words


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, t=0.8):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    links, top = [0] * n, list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= t * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted([(r[0], least.get(find(i)), links[i]) for i, r in enumerate(rows)], key=key)


def near(seed, groups=6, size=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = sentence(rng, rng.randrange(30, 200)).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append((len(rows), " ".join(w), "en", "s", 1))
    passage = sentence(rng, 60)
    rows += [(1000 + i, passage + " " + sentence(rng, rng.randrange(5, 60)), "en", "s", 1) for i in range(30)]
    return rows


def test_equals_all_pairs(spark):
    got = sorted(map(tuple, j.jaccard_join(frame(spark)).collect()), key=key)
    assert got == brute(documents())
    assert j.jaccard_join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1024, 8])
def test_near_copies_at_any_bucket_size(spark, monkeypatch, limit):
    """With a small limit buckets are split along paths, and what doesn't split is compared in pairs of blocks."""
    monkeypatch.setattr(j, "LIMIT", limit)
    rows = near(4)
    assert sorted(map(tuple, j.jaccard_join(frame(spark, rows)).collect()), key=key) == brute(rows)


def test_runs_follow_the_recall():
    assert j.runs_for(0.8, 0.9) < j.runs_for(0.8, 0.999999) <= j.COORDINATES // 2


def test_components_of_long_chains(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(bytes([100]), bytes([i])) for i in range(101, 140)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "fp binary, other binary")
    from framemill.llm.shared import shared_dir

    got = {bytes(r.node): bytes(r.label) for r in j.components(df, shared_dir(spark)).collect()}
    assert got == {bytes([i]): b"\0" for i in range(1, 41)} | {bytes([i]): bytes([100]) for i in range(101, 140)}


def test_one_of_each_stays(spark):
    rows = documents()
    df = frame(spark, rows)
    kept = j.one_of_each(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    of = brute(rows)
    classes = {c for i, c, _ in of if i is not None}
    alone = [r for r in rows if not words(r[1])]
    assert sorted(i for i, t in got if i is not None and words(t)) == sorted(c for c in classes if c is not None and c not in {r[0] for r in alone})
    assert sum(got[r[0], r[1]] for r in alone) >= len(alone) and got[None, "a text without an id but with words"] == 1


def alike(seed, similarity, pairs=150):
    """Pairs of texts that share just over `similarity` of all their 5-grams: 80 of them, and n more on either side."""
    rng, rows = random.Random(seed), []
    n = int(80 * (1 / similarity - 1) / 2)
    for _ in range(pairs):
        base = [f"w{rng.randrange(10**9)}" for _ in range(84)]
        rows += [(len(rows) + k, " ".join([*base, *(f"v{rng.randrange(10**9)}" for _ in range(n))]), "en", "s", 1) for k in (0, 1)]
    return rows


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.7, 0.8])
def test_no_pairs_are_lost_at_the_threshold(spark, similarity):
    rows = alike(7, similarity)
    got = sorted(map(tuple, j.jaccard_join(frame(spark, rows), similarity=similarity).collect()), key=key)
    assert got == brute(rows, similarity) and all(n == 1 for _, _, n in got)


def test_texts_are_shuffled_if_many_are_compared(spark, monkeypatch):
    monkeypatch.setattr(j, "SENT", 3)
    rows = near(5)
    assert sorted(map(tuple, j.jaccard_join(frame(spark, rows)).collect()), key=key) == brute(rows)


def test_words_that_arithmetic_hashes_confuse(spark):
    one, other = thue_morse(2048)
    rows = [(1, one, "en", "s", 1), (2, other, "en", "s", 1), (3, f"{one} {other}", "en", "s", 1), (4, f"{other} {one}", "en", "s", 1), (5, one, "en", "s", 1)]
    assert sorted(map(tuple, j.jaccard_join(frame(spark, rows)).collect()), key=key) == brute(rows)


def test_columns_with_working_names(spark):
    from pyspark.sql import functions as F

    df = frame(spark).withColumns({c: F.lit(c) for c in ("#t", "#id", "#h", "#hot", "#cold", "#salt", "path", "label", "place")})
    kept = j.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == j.one_of_each(frame(spark)).count()


def test_agreement_and_runs_follow_the_similarity():
    assert j.agreement_for(0.8, 0.99999, 64) >= 33 > j.agreement_for(0.5, 0.99999, 64) > 0
    assert j.runs_for(0.5, 0.99999) > 32 and j.coordinates_for(j.runs_for(0.8, 0.99999)) == j.COORDINATES
    with pytest.raises(ValueError):
        j.runs_for(0.1, 0.99999)
