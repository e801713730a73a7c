import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm.bpe import Encoder, MergeReplay, encoded, load_ranks
from framemill.llm.segments import segments
from framemill.llm.token_counts import token_counts

from .helpers import documents, frame

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load_ranks(MULTI), P.PATTERN)


@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  \n\t'sdabAB.!?\x1c\x85　́")), max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(encoder, library, texts):
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def by_definition(word, ranks):
    """Of all neighbours that are a token together, those of the lowest rank are merged, the leftmost first, until there are none."""
    parts = [bytes([b]) for b in word]
    while True:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=40, unique=True), st.randoms(), st.lists(st.text("abcd", max_size=30), max_size=12))
@settings(max_examples=400, deadline=None)
def test_replay_of_any_rank_table(tokens, rng, words):
    """In tables in random order, merges often make pairs of lower ranks."""
    rng.shuffle(tokens)
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
    words = [w.encode() for w in words]
    replay = MergeReplay(ranks)
    for word, ids in zip(words, replay.replay(words) if all(words) else replay.encode(words)):
        want = [ranks[word]] if word in ranks and not all(words) else by_definition(word, ranks)
        assert np.frombuffer(ids, "<u4").tolist() == want
    assert all(np.frombuffer(replay.alone(w), "<u4").tolist() == by_definition(w, ranks) for w in words if w)


def test_long_pretokens(encoder, library):
    for text in ("a" * 5000, "abcab" * 900, "!" * 700 + "?" * 700, " " * 900, "日本" * 500):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_segments_are_the_text(text):
    assert "".join(segments(text)) == text


def test_encoded(spark, library):
    got = Counter(map(tuple, encoded(frame(spark), MULTI, P.PATTERN, digests=True).collect()))
    want = Counter()
    for i, text, *_ in documents():
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert encoded(frame(spark, []), MULTI, P.PATTERN).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert encoded(frame(spark, []), MULTI, P.PATTERN).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [*documents(), (400, "a<|endoftext|>b <|endoftext|>", "en", "s", 1), (401, "<|endoftext|>" * 3 + "\n\n x", "en", "s", 1)]
    got = Counter(map(tuple, token_counts(frame(spark, rows), P.path("byte_bpe_50k.json")).collect()))
    want = Counter()
    for i, text, *_ in rows:
        n = len(t.encode(text or "", add_special_tokens=False))
        want[i, len((text or "").encode()), n, n > 1024] += 1
    assert got == want
    assert token_counts(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0
