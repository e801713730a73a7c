import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from framemill.llm import quality_gam as g
from framemill.llm import quality_rules as q

from .helpers import documents, frame, sentence, thue_morse

W = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [*documents(), *((700 + i, t, "en", "s", 1) for i, t in enumerate(["a b\na b\n\n\nb a", "w " * 40, "one two three four five six seven one two three four five x", "a | b | c | d\n" + "good words are here. " * 3, "#%& $$ <>|*\n", "x\ry\x0bz\x0c1\x852\xa03", "A!! B!! C!! D!!\nA!! B!! C!! D!!"]))]


def brute(text):
    text = text or ""
    ws = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = {i + j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(ws) < 10 or 100 * len(hit) > 20 * len(ws)


def test_base_measures(spark):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.quality_rules(frame(spark, ROWS)).collect())
    assert got == Counter((i, *brute(t)) for i, t, *_ in ROWS)
    assert all(not r.kept for r in q.quality_rules(frame(spark, ROWS)).where("base_failed").collect())
    assert q.quality_rules(frame(spark, [])).count() == 0


def test_equal_is_equal_by_bytes(monkeypatch):
    one, other = thue_morse(2048)
    texts = [f"{one}\n{other}", f"{one}\n{one}", f"x {one} {other} y {one} " * 2 + f"x {other} {one} y {other}", "a b c d e f g\na b c d e f h\na b c d e f g"]
    for _ in range(2):
        m = q.measure(pa.array(texts))
        assert [(m["n_dup_lines"][i], m["n_repeat_words"][i]) for i in range(4)] == [(brute(t)[3], brute(t)[4]) for t in texts]
        # once more with hashes that say nothing
        monkeypatch.setattr(q, "_first_like", lambda keys: np.zeros(len(keys), np.int64))


def test_marks_of_any_script():
    lines = ["यह एक लंबा वाक्य है जो बिना किसी अन्य विराम के चलता है और अंत में केवल एक पूर्ण विराम के साथ समाप्त होता है।", "他 说 了 很 多 话 但 是 没 有 人 听 到 他 在 说 什 么 事 情 啊。", "كان " * 24 + "هنا؟"]
    m = q.measure(pa.array(lines + [x[:-1] for x in lines]))
    assert m["n_lines_removed"].tolist()[0] == 0 and m["n_lines_removed"].tolist()[3:5] == [1, 1]
    assert q.punctuation(np.frombuffer("a.é、x।—y".encode(), np.uint8)).sum() == 4


def test_clean_lines_keeps_columns_with_working_names(spark):
    from pyspark.sql import functions as F

    df = frame(spark).withColumns({"#": F.lit("a"), "##": F.lit("b")})
    assert {(r["#"], r["##"]) for r in q.clean_lines(df).collect()} == {("a", "b")} and q.clean_lines(df).columns == df.columns


def test_lines_go_and_documents_that_lose_too_much():
    good = "Here is a sentence with words, as people write them.\nAnd here is another one; it says something else."
    texts = [good, good + "\nhome | news | sport | about", good + "\nAll rights reserved, 2020.", "a | b | c | d\ne | f | g | h\nreal words are few here.", good + "\n" + good.split("\n")[0], "### $$$ %%% &&& ### $$$ %%% &&& ### $$$ %%%\n" * 2]
    m = q.measure(pa.array(texts))
    assert m["n_lines_removed"].tolist() == [0, 1, 1, 2, 1, 2]
    assert m["kept"].tolist()[:3] == [True] * 3 and not m["kept"][5]


def test_clean_lines(spark):
    good = "Here is a sentence with words, as people write them.\nAnd here is another one; it says something else."
    df = frame(spark, [(1, good + "\nhome | news | sport | about\nThe last line, which stays as it is.", "en", "s", 1), (2, "### ### ###", "en", "s", 1), (None, good, None, None, None), (3, None, None, None, None)])
    rows = q.clean_lines(df).collect()
    assert {r.doc_id: r.text for r in rows} == {1: good + "\nThe last line, which stays as it is.", None: good} and rows[0].key == "k"


def test_gam_is_additive_and_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = (np.sin(3 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + 0.2 * rng.normal(size=3000) > 0).astype(float)
    gam = g.fit(x[:2000], y[:2000])
    p = gam.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.85
    b, z = gam.bins(x[:5]), np.full(5, gam.base)
    for k in range(5):
        z[k] += sum(t[b[k, f]] for f, t in enumerate(gam.tables)) + sum(t[b[k, i], b[k, j]] for i, j, t in gam.pairs)
    assert np.allclose(1 / (1 + np.exp(-z)), gam.score(x[:5]))
    assert any({i, j} == {1, 2} for i, j, _ in gam.pairs)


def test_classifier_on_held_out_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        text = sentence(rng, rng.randrange(20, 60)) + "." if good else " | ".join(sentence(rng, 1) for _ in range(rng.randrange(20, 60)))
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good)))
    labels += [(None, 1), (5, None), (9999, 0)]
    docs = frame(spark, [*rows, (1000, None, None, None, None), (None, "", None, None, None)])
    gam = g.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    out = g.scored(docs, gam).toPandas()
    assert len(out) == 602 and out.score.between(0, 1).all() and out.score.notna().all()
    held = out[out.held_out & (out.doc_id < 600)]
    assert len(held) > 60 and ((held.predicted == 1) == (held.doc_id % 3 > 0)).mean() > 0.95
    again = g.scored(frame(spark, [(1, rows[0][1], "en", "s", 1), (1, rows[0][1], "en", "s", 1), (2, "word " * 400_000, "en", "s", 1), (3, "", "en", "s", 1), (4, None, "en", "s", 1)]), gam).toPandas()
    assert again[again.doc_id == 1].score.nunique() == 1 and again[again.doc_id == 1].score.iloc[0] == out[out.doc_id == 0].score.iloc[0]
    assert again[again.doc_id > 2].score.nunique() == 1 and again.score.between(0, 1).all()
    none = g.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert (g.scored(docs, none).toPandas().score == 0.5).all() and g.scored(docs.limit(0), gam).count() == 0
