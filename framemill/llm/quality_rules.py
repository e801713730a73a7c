"""Quality rules, line first: lines that fail a rule are removed, then documents that lost too much text are rejected.

A line fails if it
  * has too many symbols or exclamation marks for its words, or is long and has no punctuation at all (punctuation);
  * is a row of separated short items (navigation);
  * holds a boilerplate phrase (boilerplate);
  * says the same few words over and over, or equals an earlier line of its text (repetition).
All measures of a slab are array operations over its bytes. Equal lines and equal windows are found by hashes of their words and then compared byte by byte; where a hash deceives, the text is counted again by its bytes alone. Distinct words within a line are counted by hashes.

Nulls and empty texts have no words, so they fail the base rules. Repeated rows are each judged, other columns ignored by the measures and kept by clean_lines.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import per_slab, raw, text_slabs, texts_of
from .words import FOLD, NONSPACE, byte_class, grams, mix, same, words

#: Phrases that mark a line as boilerplate, lower case.
BOILERPLATE = (b"licensed under", b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy", b"cookie policy", b"use of cookies", b"enable javascript", b"lorem ipsum", b"powered by", b"subscribe to our", b"sign up for our")
SYMBOLS = byte_class(lambda b: chr(b) in "#*$%&|<>")
#: Code points up to U+FFFF that count as punctuation: of ASCII those that end or part clauses, of the rest all that Unicode calls so.
PUNCTUATION = np.array([chr(c) in ".,;:!?" if c < 128 else unicodedata.category(chr(c))[0] == "P" for c in range(1 << 16)])
LINE = byte_class(lambda b: b != 10)


@dataclass(frozen=True)
class Limits:
    symbols: float = 0.3  # of a line's words
    bangs: float = 0.5  # of a line's words, from 4 words on
    unpunctuated: int = 20  # words that a line without punctuation may have
    separators: float = 0.25  # of a line's words, from 3 separators on
    distinct: float = 0.3  # least share of distinct words, from 10 words on
    lost: float = 0.6  # share of a text's word characters that may go with failing lines


def _per(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of a kind each range holds."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[ends] - total[starts]


def punctuation(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 begin a punctuation character."""
    out = PUNCTUATION[data] & (data < 128)
    two, three = np.flatnonzero(data >> 5 == 6), np.flatnonzero(data >> 4 == 14)
    at = lambda i, k: data[i + k].astype(np.int32) & 63
    out[two] = PUNCTUATION[(data[two].astype(np.int32) & 31) << 6 | at(two, 1)]
    out[three] = PUNCTUATION[(data[three].astype(np.int32) & 15) << 12 | at(three, 1) << 6 | at(three, 2)]
    return out


def _first_like(keys: np.ndarray) -> np.ndarray:
    """Of each key, the first place that has it."""
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return first[at]


def _copies(line, of: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Which of the real lines equal an earlier one of their text."""
    first = real[_first_like(line.hashes[real] ^ mix(of[real].astype(np.uint64)))]
    like = first != real
    a, b = real[like], first[like]
    ok = (of[a] == of[b]) & same(line.pieces, line.starts[a], line.ends[a], line.pieces, line.starts[b], line.ends[b])
    copy = np.zeros(len(of), bool)
    copy[a[ok]] = True
    for d in np.unique(of[np.r_[a[~ok], b[~ok]]]).tolist():
        seen: set[bytes] = set()
        for j in real[of[real] == d].tolist():
            text = line.pieces[line.starts[j] : line.ends[j]].astype(np.uint8).tobytes()
            copy[j] = text in seen
            seen.add(text)
    return copy


def _repeated(w, doc: np.ndarray, size: int = 5) -> np.ndarray:
    """The first words of windows of `size` words that are in their text twice or more."""
    g = grams(w.hashes, size)
    inside = np.flatnonzero(doc[size - 1 :] == doc[: len(g)]) if len(g) else np.zeros(0, np.int64)
    first = inside[_first_like(g[inside] ^ mix(doc[inside].astype(np.uint64)))]
    like = first != inside
    a, b = inside[like], first[like]
    ok = doc[a] == doc[b]
    for k in range(size):
        ok &= same(w.pieces, w.starts[a + k], w.ends[a + k], w.pieces, w.starts[b + k], w.ends[b + k])
    twice = np.zeros(len(doc), bool)
    twice[a[ok]] = twice[b[ok]] = True
    for d in np.unique(doc[np.r_[a[~ok], b[~ok]]]).tolist():
        own = range(int(w.first[d]), int(w.first[d + 1]))
        text = [w.pieces[w.starts[i] : w.ends[i]].astype(np.uint8).tobytes() for i in own]
        count = Counter(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
        for i in range(len(text) - size + 1):
            twice[own[i]] = count[tuple(text[i : i + size])] > 1
    return np.flatnonzero(twice)


def measure(column: pa.Array, limits: Limits = Limits()) -> dict:
    """Arrays for each text of a column without nulls, and under `lines` for each line with a character: (text, start, end, fails)."""
    data, offsets = raw(column)
    n = len(offsets) - 1
    w = words(data, offsets, NONSPACE, fold=False)
    doc, n_words = w.doc(), np.diff(w.first)
    in_word = NONSPACE[data]
    char = in_word & ((data & 0xC0) != 0x80)
    word_chars = _per(char, offsets[:-1], offsets[1:])
    n_symbols = _per(SYMBOLS[data], offsets[:-1], offsets[1:])

    twice = _repeated(w, doc)
    edge = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    n_repeat = _per(np.cumsum(edge[:-1]) > 0, w.first[:-1], w.first[1:])

    line = words(data, offsets, LINE, fold=False)
    of = line.doc()
    a, b = np.searchsorted(w.starts, line.starts), np.searchsorted(w.starts, line.ends)
    k = b - a
    real = np.flatnonzero(k)
    copy = _copies(line, of, real)
    n_dup = np.bincount(of[copy], minlength=n)

    per = lambda flag: _per(flag, line.starts, line.ends)
    lw = np.repeat(np.arange(len(of)), k)
    at = np.repeat(a - (np.cumsum(k) - k), k) + np.arange(len(lw))
    _, once = np.unique(w.hashes[at] ^ mix(lw.astype(np.uint64)), return_index=True)
    distinct = np.bincount(lw[once], minlength=len(of))
    fails = per(SYMBOLS[data]) > limits.symbols * k
    fails |= (k >= 4) & (per(data == 33) >= limits.bangs * k)
    fails |= (k >= limits.unpunctuated) & (per(punctuation(data)) == 0)
    bars = per(data == 124)
    fails |= (bars >= 3) & (bars >= limits.separators * k)
    fails |= (k >= 10) & (distinct < limits.distinct * k)
    fails |= copy
    low = FOLD[data].tobytes()
    for phrase in BOILERPLATE:
        i = low.find(phrase)
        while i >= 0:
            j = int(np.searchsorted(line.starts, i, "right")) - 1
            if i + len(phrase) <= line.ends[j]:
                fails[j] = True
            i = low.find(phrase, i + 1)
    fails &= k > 0
    lost = np.bincount(of, weights=per(char) * fails, minlength=n).astype(np.int64)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & (lost <= limits.lost * word_chars), "n_lines_removed": np.bincount(of[fails], minlength=n), "lost_chars": lost, "lines": (of, line.starts, line.ends, fails)}


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_lines_removed": "long", "lost_chars": "long"}


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COLUMNS for every row."""
    df = texts_of(docs, id_col, text_col)

    def judge(slab: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(slab.column(1), limits)
        return pa.RecordBatch.from_arrays([slab.column(0), *(pa.array(m[c], pa.bool_() if t == "boolean" else pa.int64()) for c, t in COLUMNS.items())], names=["doc_id", *COLUMNS])

    return df.mapInArrow(per_slab(judge), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def clean_lines(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The kept rows of docs without their failing lines; all columns stay. A text without failing lines stays as it is."""
    at = docs.columns.index(text_col)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in text_slabs([pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(at), *batch.columns], names=["#", "##", *batch.schema.names])]):
                m = measure(slab.column(1), limits)
                of, a, b, fails = m["lines"]
                data, offsets = raw(slab.column(1))
                texts = slab.column(1).to_pylist()
                for d in np.unique(of[fails]).tolist():
                    lines = data[offsets[d] : offsets[d + 1]].tobytes().split(b"\n")
                    gone = {int(x) - int(offsets[d]) for x in a[fails & (of == d)]}
                    kept, place = [], 0
                    for x in lines:
                        if place not in gone:
                            kept.append(x)
                        place += len(x) + 1
                    texts[d] = b"\n".join(kept).decode()
                columns = slab.columns[2:]
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(m["kept"]))

    return docs.mapInArrow(run, docs.schema)
