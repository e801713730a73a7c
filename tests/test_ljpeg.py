"""The lossless coder against a plain one that goes bit by bit."""

import struct
import tracemalloc

import numpy as np
import pytest

from framemill.operators import ljpeg as j


def guess(v, y, x, c, top, predictor, half):
    """The prediction of one sample; rows from `top` on are an interval."""
    if y == top:
        return int(v[y, x - 1, c]) if x else half
    if x == 0:
        return int(v[y - 1, 0, c])
    a, b, d = int(v[y, x - 1, c]), int(v[y - 1, x, c]), int(v[y - 1, x - 1, c])
    return {1: a, 2: b, 3: d, 4: a + b - d, 5: a + ((b - d) >> 1), 6: b + ((a - d) >> 1), 7: (a + b) >> 1}[predictor]


#: Code lengths of categories 0 to 16: for the first component few bits for small ones, for others 5 each.
LENGTHS = ([2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14], [5] * 17)


def codes(lengths):
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        out[s], code, last = format(code, f"0{n}b"), code + 1, n
    return out


def plain(samples, bits, predictor, restart=0, shift=0):
    """T.81 step by step, with strings of bits. restart: rows."""
    h, w, n = samples.shape
    v, parts, text = samples.astype(int) >> shift, [], ""
    tables = [codes(LENGTHS[min(c, 1)]) for c in range(n)]
    for y in range(h):
        top = y // restart * restart if restart else 0
        if y and y == top:
            parts.append(text)
            text = ""
        for x in range(w):
            for c in range(n):
                d = (int(v[y, x, c]) - guess(v, y, x, c, top, predictor, 1 << (bits - shift - 1)) + 32768) % 65536 - 32768
                k = abs(d).bit_length()
                text += tables[c][k]
                if 0 < k < 16:
                    text += format(d if d > 0 else d + (1 << k) - 1, f"0{k}b")
    parts.append(text)
    data = b""
    for i, t in enumerate(parts):
        t += "1" * (-len(t) % 8)
        data += bytes(int(t[k : k + 8], 2) for k in range(0, len(t), 8)).replace(b"\xff", b"\xff\x00")
        if i < len(parts) - 1:
            data += bytes([0xFF, 0xD0 + i % 8])
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    dht = b"".join(seg(0xC4, bytes([t, *(ls.count(n) for n in range(1, 17)), *[s for _, s in sorted((n, s) for s, n in enumerate(ls))]])) for t, ls in enumerate(LENGTHS))
    dri = seg(0xDD, struct.pack(">H", restart * w)) if restart else b""
    sof = seg(0xC3, struct.pack(">BHHB", bits, h, w, n) + b"".join(bytes([7 + c, 0x11, 0]) for c in range(n)))
    sos = seg(0xDA, bytes([n]) + b"".join(bytes([7 + c, min(c, 1) << 4]) for c in range(n)) + bytes([predictor, 0, shift]))
    return b"\xff\xd8" + seg(0xFE, b"a comment") + dht + sof + dri + sos + data + b"\xff\xd9"


def image(rng, h, w, n, bits, rough):
    if rough:
        return rng.integers(0, 1 << bits, (h, w, n)).astype(np.uint16)
    return np.clip(rng.normal(1 << (bits - 1), 40, (h, w, n)).cumsum(axis=1) / 3, 0, (1 << bits) - 1).astype(np.uint16)


CASES = [(p, n, bits, restart, shift) for p in range(1, 8) for n, bits, restart, shift in ((1, 16, 0, 0), (2, 16, 1, 0), (2, 12, 3, 0), (3, 8, 2, 1), (2, 14, 0, 2))]


@pytest.mark.parametrize("how", ["one by one", "together", "from many places"])
def test_streams_of_a_plain_coder(monkeypatch, how):
    monkeypatch.setattr(j, "TOGETHER", 1 if how == "together" else 1000)
    if how == "from many places":
        monkeypatch.setattr(j, "LONG", 8)
        monkeypatch.setattr(j, "SEGMENT", 256)
        monkeypatch.setattr(j, "STRETCH", 2048)
    rng = np.random.default_rng(1)
    samples = [image(rng, *rng.integers(2, 14, 2).tolist(), n, bits, k % 2) for k, (_, n, bits, _, _) in enumerate(CASES)]
    got = j.decode_many([plain(v, bits, p, restart, shift) for v, (p, _, bits, restart, shift) in zip(samples, CASES)])
    for v, g, (*_, shift) in zip(samples, got, CASES):
        assert (g == v >> shift << shift).all()


@pytest.mark.parametrize("predictor", range(1, 8))
def test_encoder_says_what_the_plain_one_says(monkeypatch, predictor):
    monkeypatch.setattr(j, "BLOCK", 30)
    rng = np.random.default_rng(predictor)
    for restart in (0, 1, 4):
        v = image(rng, 11, 9, 2, 16, True)
        assert (j.decode(j.encode(v, 16, predictor, restart)) == v).all()
        d = j.differences(v, 16, predictor=predictor)
        want = [(int(v[y, x, c]) - guess(v, y, x, c, 0, predictor, 32768) + 32768) % 65536 - 32768 for y in range(11) for x in range(9) for c in range(2)]
        assert d.ravel().tolist() == want


def test_long_streams_and_cut_ones(monkeypatch):
    monkeypatch.setattr(j, "SEGMENT", 1 << 9)
    monkeypatch.setattr(j, "STRETCH", 1 << 14)
    rng = np.random.default_rng(4)
    v = image(rng, 300, 240, 2, 16, False)
    b = j.encode(v)
    monkeypatch.setattr(j, "LONG", 1000)
    assert (j.decode(b) == v).all()
    cut = b[: len(b) // 2]
    with pytest.raises(j.Damaged) as long:
        j.decode(cut)
    monkeypatch.setattr(j, "LONG", 1 << 30)
    with pytest.raises(j.Damaged) as short:
        j.decode(cut)
    assert (long.value.partial == short.value.partial).all() and (long.value.partial[:140] == v[:140]).all()
    monkeypatch.setattr(j, "LONG", 1000)
    same = image(rng, 60, 50, 1, 16, False)
    assert (j.decode(j.encode(np.repeat(same, 2, axis=2))) == np.repeat(same, 2, axis=2)).all() and (j.decode(j.encode(same)) == same).all()
    flat = np.full((200, 100, 2), 32768, np.uint16)
    assert (j.decode(j.encode(flat)) == flat).all()


def plain_bits(d, table, parts="both"):
    k = abs(d).bit_length()
    low = format(d if d > 0 else d + (1 << k) - 1, f"0{k}b") if 0 < k < 16 else ""
    return {"both": table[k] + low, "code": table[k], "low": low}[parts]


def wrap(d):
    return (d + 32768) % 65536 - 32768


def headed(text, bits, h, w, sampling, predictor, stuffed):
    text += "1" * (-len(text) % 32)
    data = bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))
    data = data.replace(b"\xff", b"\xff\x00") if stuffed else b"".join(data[k : k + 4][::-1] for k in range(0, len(data), 4))
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    dht = b"".join(seg(0xC4, bytes([t, *(ls.count(n) for n in range(1, 17)), *[s for _, s in sorted((n, s) for s, n in enumerate(ls))]])) for t, ls in enumerate(LENGTHS))
    sof = seg(0xC3, struct.pack(">BHHB", bits, h, w, len(sampling)) + b"".join(bytes([c, f, 0]) for c, f in enumerate(sampling)))
    return b"\xff\xd8" + dht + sof + seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([c, min(c, 1) << 4]) for c in range(len(sampling))) + bytes([predictor, 0, 0])) + data + b"\xff\xd9"


@pytest.mark.parametrize("rows", [1, 2])
@pytest.mark.parametrize("together", [1, 1000])
def test_half_size_raw(monkeypatch, rows, together):
    monkeypatch.setattr(j, "TOGETHER", together)
    rng = np.random.default_rng(rows)
    y, c = rng.integers(0, 32768, (6, 10)), rng.integers(0, 32768, (6 // rows, 5, 2))
    text, start = "", [1 << 14] * 3
    tables = [codes(x) for x in LENGTHS]
    for r in range(0, 6, rows):
        last = list(start)
        for x in range(0, 10, 2):
            for k, v in [(0, y[r + a, x + b]) for a in range(rows) for b in (0, 1)] + [(1, c[r // rows, x // 2, 0]), (2, c[r // rows, x // 2, 1])]:
                text += plain_bits(wrap(int(v) - last[k]), tables[min(k, 1)])
                last[k] = int(v)
        start = [int(y[r, 0]), *map(int, c[r // rows, 0])]
    want = np.concatenate([y[..., None], np.repeat(np.repeat(c, rows, axis=0), 2, axis=1)], axis=2)
    got = j.decode_many([headed(text, 15, 6, 10, [0x20 | rows, 0x11, 0x11], 1, True), j.encode_half_size(y, c, rows)])
    assert (got[0] == want).all() and (got[1] == want).all()
    with pytest.raises(j.Damaged):
        j.decode(j.encode_half_size(y, c, rows)[:120])


def test_pairs_of_columns():
    rng = np.random.default_rng(3)
    for v in (rng.integers(0, 65536, (5, 8)), np.clip(rng.normal(30000, 30, (9, 14)), 0, 65535).astype(int)):
        text, table = "", codes(LENGTHS[0])
        for row in v.tolist():
            last = [32768, 32768]
            for x in range(0, len(row), 2):
                d = [wrap(row[x + k] - last[k]) for k in (0, 1)]
                text += "".join(plain_bits(k, table, "code") for k in d) + "".join(plain_bits(k, table, "low") for k in d)
                last = row[x : x + 2]
        for b in (headed(text, 16, *v.shape, [0x11], 8, False), j.encode_pairs(v.astype(np.uint16))):
            assert (j.decode(b)[..., 0] == v).all()
            with pytest.raises(j.Damaged):
                j.decode(b[: len(b) - 14])


def test_markers_out_of_turn_and_damage():
    v = image(np.random.default_rng(5), 12, 6, 2, 16, True)
    b = plain(v, 16, 1, 2)
    assert (j.decode(b) == v).all()
    with pytest.raises(j.Damaged, match="turn") as e:
        j.decode(b.replace(b"\xff\xd1", b"\xff\xd4", 1))
    assert (e.value.partial[:4] == v[:4]).all() and not e.value.partial[4:].any()
    rng = np.random.default_rng(6)
    for at in rng.integers(0, len(b), 300).tolist():
        bad = b[:at] + bytes([int(rng.integers(256))]) + b[at + 1 :]
        (got,) = j.decode_many([bad])
        assert isinstance(got, (np.ndarray, j.Damaged))


def test_a_strip_takes_little_memory():
    v = image(np.random.default_rng(7), 1024, 1024, 2, 16, False)
    tracemalloc.start()
    b = j.encode(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20 and (j.decode(b) == v).all()
