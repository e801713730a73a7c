import math
from collections import Counter

import pytest

from framemill.llm import ngram_lm as lm

from .helpers import documents, frame, key, thue_morse, words


def brute(rows, least=2):
    texts = [words(t) for _, t, *_ in rows]
    uni, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    n, out = sum(uni.values()), []
    m = lambda x: round(1e6 * math.log(x))
    for (i, *_), t in zip(rows, texts):
        score, backed = 0, 0
        for k, w in enumerate(t):
            if k and two[t[k - 1], w] >= least:
                score += m(two[t[k - 1], w] / uni[t[k - 1]])
            else:
                score += m(uni[w] / n) + (m(0.4) if k else 0)
                backed += k > 0
        out.append((i, len(t), backed, score / 1e6, score / 1e6 / max(len(t), 1)))
    return sorted(out, key=key)


def same_scores(got, want):
    got = sorted(map(tuple, got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=2e-6 * (1 + w[1]))


@pytest.mark.parametrize("hot", [1 << 17, 50, 1])
@pytest.mark.parametrize("words_of_a_bucket", [2_000_000, 900])
def test_equals_counting_by_hand(spark, monkeypatch, hot, words_of_a_bucket):
    """With few frequent words and small buckets, partitions have several, and tasks hold little."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "SLAB", 2000)
    monkeypatch.setattr(lm, "PARTS", 7)
    monkeypatch.setattr(lm, "PARTS_MOST", 9)
    monkeypatch.setattr(lm, "BUCKET_WORDS", words_of_a_bucket)
    same_scores(lm.lm_scores(frame(spark)).collect(), brute(documents()))


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 50)
    same_scores(lm.lm_scores(frame(spark), bits=8).collect(), brute(documents()))


def test_words_that_arithmetic_hashes_confuse(spark):
    one, other = thue_morse(2048)
    rows = [(1, f"{one} a {one} a", "en", "s", 1), (2, f"{other} a", "en", "s", 1)]
    same_scores(lm.lm_scores(frame(spark, rows)).collect(), brute(rows))


def test_a_task_that_runs_again_makes_the_same_rows(spark, monkeypatch):
    from framemill.llm.shared import settled, shared_dir, texts_of, written

    monkeypatch.setattr(lm, "SLAB", 2000)
    df = settled(texts_of(frame(spark).repartition(5), "doc_id", "text"), shared_dir(spark))
    counts = written(lm.unigrams(df), shared_dir(spark))
    plan = lm.planned(df, counts, 2)
    one, two = (sorted(map(str, lm.exploded(df, plan).collect())) for _ in range(2))
    assert one == two and len(one) > 20
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_more_texts_than_a_slab_numbers(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        df = spark.range(0, 70_000, 1, 1).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b c') as text")
        got = lm.lm_scores(df).groupBy("n_words").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(1, 35_000), (2, 35_000)]


def test_no_rows_and_no_words(spark):
    assert lm.lm_scores(frame(spark, [])).count() == 0
    rows = [tuple(r) for r in lm.lm_scores(frame(spark, [(1, None, None, None, None), (2, " ", "en", "s", 1)])).collect()]
    assert sorted(rows) == [(1, 0, 0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0)]
