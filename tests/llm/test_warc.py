import hashlib
from collections import defaultdict

import pytest
import zstandard

from framemill.llm import warc

from .helpers import key

SCHEMA = "page_id long, url string, html string, lang string, key int, digest string"
BIG = "<p>" + "x" * 200 + "</p>"


def pages():
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i * 7 % 40), "en", 1, "d") for i in range(60)]
    rows += [(100 + i, "u", BIG, None, None, None) for i in range(30)] + [(5000, "u", BIG, None, None, None), (100, "u", BIG, None, None, None)]
    rows += [(200, None, None, None, None, None), (201, "a b\nc", "", "en", 1, "d"), (None, "u", BIG, "en", 1, "d"), (None, "v", "alone" * 40, "en", 1, "d"), (202, "u", "WARC/1.1\r\n\r\nis text\r\n\r\n" * 9, "en", 1, "d"), (203, "é", "é" * 50, "en", 1, "d"), (204, "é", "é" * 50, "en", 1, "d"), (205, "s", "short", "en", 1, "d"), (206, "s", "short", "en", 1, "d")]
    rows += [(300, "u", "long " * 200_000, "en", 1, "d")]
    return rows


def brute(rows):
    first = defaultdict(list)
    for p, _, h, *_ in rows:
        if p is not None:
            first[h or ""].append(p)
    out = []
    for p, _, h, *_ in rows:
        b = (h or "").encode()
        of = min(first[h or ""], default=None) if len(b) >= 100 else None
        revisit = of is not None and p != of
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=key)


def test_written_and_read_back(spark, monkeypatch):
    df = spark.createDataFrame(pages(), SCHEMA)
    assert sorted(map(tuple, warc.archived(df).collect()), key=key) == brute(pages())
    assert warc.archived(df.limit(0)).count() == 0


def test_hot_payloads_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(warc, "heavy_digests", lambda repeated, rows, f=warc.heavy_digests: f(repeated, rows, 5))
    df = spark.createDataFrame(pages(), SCHEMA)
    assert sorted(map(tuple, warc.archived(df).collect()), key=key) == brute(pages())


def test_random_access(spark, tmp_path):
    top = f"file://{tmp_path}"
    index = warc.write_archives(spark.createDataFrame(pages(), SCHEMA), top)
    r = index.where("page_id = 202").first()
    head, payload = warc.read_record(r.archive, r.frame, r.frame_offset, r.record_bytes)
    assert head["WARC-Record-ID"] == "<urn:page:202>" and payload.startswith(b"WARC/1.1\r\n\r\nis text")
    # independent frames: any zstd reader gets the whole archive, and steps over the seek table
    path = r.archive.removeprefix("file://")
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain.count(b"WARC-Record-ID") == index.where(index.archive == r.archive).count()
    reader = warc.ArchiveReader(r.archive)
    assert sum(n for _, n in reader.table) == len(plain)
    (tmp_path / "broken").write_bytes(b"0" * 20)
    with pytest.raises(ValueError):
        warc.ArchiveReader(f"{top}/broken")


def test_page_ids_of_any_text(spark):
    ids = ["", " ", "a b", "x\r\n\r\ny", "<urn:page:1>", "%41", "A", "日本", None, "", "a: b", "<urn:no-page>"]
    rows = [(i, "u\u2028v", BIG if k % 2 else f"page {k}" * 30, "en", 1, "d") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, SCHEMA.replace("page_id long", "page_id string"))
    assert sorted(map(tuple, warc.archived(df).collect()), key=key) == brute(rows)
