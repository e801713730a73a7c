import random

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as p
from framemill.llm.bpe import load_ranks

from .helpers import SCHEMA, sentence, words
from framemill.llm.secret_scan import BASE, MORE

from .test_jaccard import brute
from .test_secrets import brute as spans


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, top = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    item = sentence(rng, 25)
    rows, labels = [], []
    for i in range(400):
        text = sentence(rng, rng.randrange(15, 80))
        if i % 5 == 0:
            text += " scoundrel scoundrel scoundrel"
        labels.append((i, 1, int(i % 5 == 0)))
        rows.append((i, text, "en", "s", len(text)))
    rows += [(1000 + i, rows[1][1] + ("" if i % 2 else "!"), "en", "s", 1) for i in range(5)]
    rows += [(1100, "before it " + item + " after it", "en", "s", 1), (1101, "my password = abcdefghijklmnop and more words", "en", "s", 1), (1102, None, None, None, None), (1103, "", "en", "s", 0), (1104, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, item


def test_stages_by_hand(spark, sf_dir):
    top, rows, item = sf_dir
    docs, by = spark.read.parquet(f"{top}/documents.parquet"), {r[0]: r for r in rows}
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE"]

    calm = stages["toxicity"](spark, docs, top)
    ids = {r.doc_id for r in calm.collect()}
    assert calm.columns == docs.columns and sum((i in ids) == (i % 5 > 0) for i in range(400)) >= 396 and {1100, 1101, 1102, 1103} <= ids

    single = stages["n-gram Jaccard join"](spark, docs, top)
    want = {c for i, c, _ in brute(rows)}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns

    clean = stages["benchmark decontamination"](spark, docs, top)
    assert {r.doc_id for r in clean.collect()} == set(by) - {1100} and clean.columns == docs.columns

    safe = {r.doc_id: r for r in stages["secret scans"](spark, docs, top).collect()}
    assert safe[1101].text == "my [secret] and more words" and safe[1101].n_chars == len(safe[1101].text) and safe[1102].text is None and len(safe) == len(by)
    assert all(safe[i].text == by[i][1] for i in by if not spans(by[i][1] or "", BASE + MORE))

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in stages["byte-level BPE"](spark, docs, top).collect():
        assert r.n_tokens == len(enc.encode_ordinary(by[r.doc_id][1] or ""))


def test_whole_run(spark, sf_dir):
    top, rows, _ = sf_dir
    out = {r.doc_id: r for r in p.run(spark, top).collect()}
    assert not {1100, *range(1000, 1005)} & set(out) and {1, 1101, 1102, 1103, 1104} <= set(out)
    assert out[1102].n_tokens == 0 and sum(i in out for i in range(0, 400, 5)) <= 2
    assert all(words(r[1]) == [] or r[0] is not None for r in rows)


def test_empty(spark, sf_dir, tmp_path):
    top, _, _ = sf_dir
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{top}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
