"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams (letters folded): an alternation gives an OR, a sequence gives an AND, and every run of fixed characters gives the trigrams that any match must hold. A slab of texts is indexed by those trigrams (postings: sorted numbers of the texts that hold them), the queries intersect and unite the postings, and the expression itself runs over the candidates only. Rules without mandatory trigrams scan every text.

Nulls and empty texts have no spans. Spans count code points, ends exclusive. Repeated rows are each scanned, other columns ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw, text_slabs, texts_of

#: Fixed strings of a run of optional parts and alternatives; beyond it the run counts as unknown, which only makes a query weaker.
STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap; those whose `group` is shorter than `least` are dropped after that."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Rules that add spans: published formats of well-known credentials.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s:/@]+:([^\s:/@]{6,})@", 1, 6),
)

Query = tuple | None  # ("and" | "or", parts) or ("tri", code); None: every text may match


def _strings(node) -> set[str] | None:
    """The fixed strings that one item of a parsed expression can match, or None."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg)}
    if op is C.IN:
        out = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        if (low, high) == (0, 1) and (s := _sequence(body)) is not None:
            return s | {""}
        return _sequence(list(body) * int(low)) if low == high and low < 8 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    return {""} if op is C.AT else None


def _sequence(items) -> set[str] | None:
    out = {""}
    for node in items:
        s = _strings(node)
        if s is None or len(out) * len(s) > STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _join(op: str, parts: list[Query]) -> Query:
    if op == "or" and any(p is None for p in parts):
        return None
    parts = sorted({p for p in parts if p is not None}, key=repr)
    return None if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _trigrams(strings: set[str]) -> Query:
    folded = [fold(s.encode()) for s in strings]
    return _join("or", [_join("and", [("tri", (b[i] << 16) | (b[i + 1] << 8) | b[i + 2]) for i in range(len(b) - 2)]) for b in folded])


def fold(b: bytes) -> bytes:
    return b.lower()  # ASCII letters only


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What a text must hold to match at all; None if there are no mandatory trigrams."""

    def of(items) -> Query:
        parts, run = [], {""}

        def close():
            nonlocal run
            parts.append(_trigrams(run))
            run = {""}

        for node in items:
            s = _strings(node)
            if s is not None and len(run) * len(s) <= STRINGS:
                run = {a + b for a in run for b in s}
                continue
            close()
            op, arg = node
            if s is not None:
                run = s
            elif op is C.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is C.BRANCH:
                parts.append(_join("or", [of(b) for b in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                parts.append(of(arg[2]))
        close()
        return _join("and", parts)

    return of(_parser.parse(pattern, flags))


def codes(query: Query) -> set[int]:
    return set() if query is None else {query[1]} if query[0] == "tri" else set().union(*map(codes, query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over a slab of texts."""

    def __init__(self, wanted: np.ndarray, table: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3 or not len(wanted):
            return
        low = FOLD[data]
        tri = low[:-2].astype(np.int32) << 16
        tri |= low[1:-1].astype(np.int32) << 8
        tri |= low[2:]
        number = table[tri]
        at = np.flatnonzero(number)
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        keys = np.unique(number[at[inside]].astype(np.int64) * self.n + doc[inside])
        which, docs = keys // self.n, keys % self.n
        ends = np.searchsorted(which, np.arange(1, len(wanted) + 2))
        self.postings = {int(w): docs[ends[i] : ends[i + 1]] for i, w in enumerate(wanted)}

    def search(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(query[1], np.zeros(0, np.int64))
        found = [self.search(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for x in sorted(found[1:], key=len):
            out = np.intersect1d(out, x, assume_unique=True)
        return out


FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for i, r in enumerate(rules)]
        wanted = sorted(set().union(*[codes(q) for *_, q in self.rules]))
        self.wanted = np.array(wanted, np.int64)
        self.table = np.zeros(1 << 24, np.uint16)
        self.table[self.wanted] = np.arange(1, len(wanted) + 1)

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule's number, end), sorted."""
        data, offsets = raw(column)
        index = TrigramIndex(self.wanted, self.table, data, offsets)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for i, rule, regex, query in self.rules:
            for d in index.search(query).tolist():
                if d not in texts:
                    texts[d] = column[d].as_py()
                for m in regex.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), i, m.end()))
        for spans in out:
            spans.sort()
        return out


def _scanned(df: DataFrame, rules: tuple[Rule, ...], make: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for slab in text_slabs(batches):
            yield make(slab, scanner.scan(slab.column(1)))

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> for every row; an empty array where there are none."""

    def make(slab: pa.RecordBatch, found: list) -> pa.RecordBatch:
        spans = pa.array([[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in s] for s in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
        return pa.RecordBatch.from_arrays([slab.column(0), spans], names=["doc_id", "spans"])

    return _scanned(texts_of(docs, id_col, text_col), rules, make, "spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: what the base rules found, and all spans as kind:start:end."""
    rules = BASE + MORE

    def make(slab: pa.RecordBatch, found: list) -> pa.RecordBatch:
        said = lambda spans: ",".join([f"{rules[i].kind}:{a}:{b}" for a, i, b in spans])
        base = [[x for x in s if x[1] < len(BASE)] for s in found]
        counts = [pa.array([sum(x[1] == i for x in s) for s in base], pa.int64()) for i in range(len(BASE))]
        sha = pa.array([hashlib.sha256(said(s).encode()).hexdigest() for s in base], pa.string())
        return pa.RecordBatch.from_arrays([slab.column(0), *counts, sha, pa.array([said(s) for s in found], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return _scanned(texts_of(docs, id_col, text_col), rules, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[secret]") -> DataFrame:
    """docs with every span (overlapping ones united) replaced by `mark`; all other columns, rows and nulls stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for slab in text_slabs([pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(at), *batch.columns], names=["#", "##", *batch.schema.names])]):
                texts = slab.column(at + 2).to_pylist()
                for d, spans in enumerate(scanner.scan(slab.column(1))):
                    if spans:
                        parts, done, to = [], 0, -1
                        for a, _, b in spans:
                            if a >= to:
                                parts += [texts[d][done:a], mark]
                            to = max(to, b)
                            done = to
                        texts[d] = "".join(parts) + texts[d][done:]
                columns = slab.columns[2:]
                columns[at] = pa.array(texts, slab.column(at + 2).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    at = docs.columns.index(text_col)
    if dict(docs.dtypes)[text_col] != "string":
        docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return docs.mapInArrow(run, docs.schema)
