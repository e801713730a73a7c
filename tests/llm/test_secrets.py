import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import secret_scan as s

from .helpers import documents, frame

TEXTS = [
    'password = "abcdefghijkl" and api_key:0123456789abcdef0123', "PASSWD='short' token=token=abcdefghijklmnop", "secret: token: abcdefghijklmnopq", "AKIA" + "A1" * 7 + " AKIAABC", "deadbeefdeadbeef" * 3, "é" * 30 + "apikey=zzzzzzzzzzzzzz", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop",
    "-----BEGIN RSA PRIVATE KEY-----\nabc=\n-----END RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890-abc", "AIza" + "b" * 35, "sk_live_" + "c" * 20, "https://user:hunter22@host/", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9,
]
ROWS = [*documents(), *((500 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)), (600, "word " * 30_000 + TEXTS[0], "en", "s", 1)]


def brute(text, rules):
    """Every rule over the whole text, by hand."""
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, r.flags):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def test_digests(spark):
    got = Counter(map(tuple, s.secret_digests(frame(spark, ROWS)).collect()))
    want, rules = Counter(), s.BASE + s.MORE
    say = lambda spans: ",".join(f"{rules[i].kind}:{a}:{b}" for a, i, b in spans)
    for i, text, *_ in ROWS:
        base, every = brute(text or "", s.BASE), brute(text or "", rules)
        want[i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(every)] += 1
    assert got == want and sum(1 for r in got if r[5]) >= len(TEXTS) - 1
    assert s.secret_digests(frame(spark, [])).count() == 0


def test_queries_are_necessary():
    assert s.trigram_query(r"[0-9a-f]+") is None and s.trigram_query(r"(abc)?x*") is None
    assert s.trigram_query("AKIA[A-Z0-9]+") == ("and", (("tri", 0x616B69), ("tri", 0x6B6961)))
    assert s.trigram_query("(?:abc|d)") is None
    q = s.trigram_query("x(?:abc|def)y")
    assert q[0] == "or" and all(p[0] == "and" and len(p[1]) == 3 for p in q[1])


@given(st.lists(st.text(alphabet="pasword=: tokenAKI1\"'xgh_é", max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_scan_equals_full_scan(texts):
    import pyarrow as pa

    rules = s.BASE + s.MORE
    assert s.Scanner(rules).scan(pa.array(texts, pa.string())) == [brute(t, rules) for t in texts]


def test_redact(spark):
    df = frame(spark, ROWS)
    got = s.redact(df)
    assert got.columns == df.columns and got.count() == len(ROWS)
    rows = {r.doc_id: r.text for r in got.collect() if r.doc_id is not None}
    assert rows[500] == '[secret]" and [secret]' and rows[200] is None and rows[300] == dict((r[0], r[1]) for r in ROWS)[300]
    assert rows[513] == "[secret]" and "hunter22" not in rows[512]


def test_columns_with_working_names(spark):
    from pyspark.sql import functions as F

    df = frame(spark, ROWS).withColumns({"#": F.lit("a"), "##": F.lit("b")})
    out = s.redact(df)
    assert out.columns == df.columns and {(r["#"], r["##"]) for r in out.collect()} == {("a", "b")}


def test_long_passwords_in_urls(spark):
    text = "see ftp://" + "u" * 90 + ":" + "p" * 300 + "@host and more"
    (row,) = s.redact(frame(spark, [(1, text, "en", "s", 1)])).collect()
    assert "ppp" not in row.text and row.text.startswith("see ") and row.text.endswith("host and more")
