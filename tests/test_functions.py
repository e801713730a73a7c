import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framemill.functions import curves, frames, scalars
from framemill.operators.dither import diffused


def test_packed_vectors_by_hand():
    assert frames.unpack(bytes.fromhex("123456"), "12p").tolist() == [0x4120, 0x5630]
    assert frames.unpack(bytes.fromhex("123456"), "12p_v2").tolist() == [0x1240, 0x5630]
    assert frames.unpack(bytes.fromhex("FF0080011B"), "10p").tolist() == [0xFFC0, 0x0080, 0x8040, 0x0100]
    assert frames.pack_12(np.array([0x1230, 0x4560], np.uint16)) == bytes.fromhex("123456")
    assert frames.unpack(bytes.fromhex("FF0F"), "dark16").tolist() == [0xFFF0]


def test_column_codecs_equal_frame_codecs(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(int(x) for x in r) for r in rng.integers(0, 256, (50, 5))]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    got = df.select(scalars.unpack_12p("a", "b", "c").alias("p"), scalars.unpack_12p_v2("a", "b", "c").alias("q"), scalars.unpack_10p("a", "b", "c", "d", "e").alias("t")).collect()
    for r, g in zip(rows, got):
        assert g.p == frames.unpack(bytes(r[:3]), "12p").tolist()
        assert g.q == frames.unpack(bytes(r[:3]), "12p_v2").tolist()
        assert g.t == frames.unpack(bytes(r), "10p").tolist()


@given(st.lists(st.integers(0, 4095), min_size=9, max_size=90).filter(lambda v: len(v) % 9 == 0))
@settings(max_examples=50, deadline=None)
def test_cri10_round_trip(v):
    v = np.array(v, np.uint16) << 4
    assert (frames.unpack_cri10(frames.pack_cri10(v)) == v).all()


def test_lengths_that_do_not_fit_are_refused():
    for kind, b in (("12p", b"1234"), ("10p", b"123")):
        with pytest.raises(ValueError):
            frames.unpack(b, kind)
    with pytest.raises(ValueError):
        frames.unpack(b"", "unheard of")


def test_linlog_parameters_solve_their_equation():
    for (i, o), a in {(16, 10): 0.005831706, (16, 8): 0.0302183135, (16, 7): 0.0684535277, (12, 8): 0.0167852377, (12, 5): 0.2507092346}.items():
        assert curves.linlog_parameter(i, o) == pytest.approx(a, rel=1e-7)
    assert curves.gamma_exponent() == pytest.approx(0.62491276, rel=1e-7)


def test_curves_over_all_values(spark):
    v = np.arange(65536)
    df = spark.range(65536).select(curves.gamma_reduce(F.col("id")).alias("g"), curves.linlog_reduce(F.col("id"), 16, 8).alias("l")).toPandas()
    assert (df.g.to_numpy() == curves.gamma_reduce_array(v)).all()
    assert (df.l.to_numpy() == curves.linlog_reduce_array(v, curves.linlog_parameter(16, 8))).all()
    assert (np.diff(df.l) >= 0).all() and df.l.max() == 255
    table = curves.linlog_table_array(16, 8)
    assert table[0] == 0 and table[-1] == 65535 and (np.diff(table.astype(int)) > 0).all()


def scanned(frame, a, pattern):
    """Error diffusion, pixel by pixel."""
    h, w = frame.shape
    s = np.zeros(h * w + 2 * w + 2)
    s[: h * w] = frame.ravel()
    out = np.zeros(h * w, int)
    for y in range(h):
        for x in range(w):
            i, green = y * w + x, pattern is not None and pattern[(y % 2) * 2 + x % 2] == 1
            q = np.clip(np.rint(np.log(a * max(s[i], 0) + 1) / np.log(a + 1)), 0, 65535)
            e = s[i] - np.clip(np.rint(((a + 1) ** q - 1) / a), 0, 65535)
            out[i] = q
            d = 1 if pattern is None else 2
            near = pattern is None or green
            if x < w - d:
                s[i + d] += e * 7 / 16
                s[i + (w + 1 if near else 2 * w + 2)] += e / 16
            if x >= (1 if near else 2):
                s[i + (w - 1 if near else 2 * w - 2)] += e * 3 / 16
            s[i + (w if pattern is None else 2 * w)] += e * 5 / 16
    return out.reshape(h, w)


@pytest.mark.parametrize("pattern", [None, (1, 0, 2, 1), (0, 1, 1, 2)])
def test_dither_equals_a_scan(pattern):
    frame = np.random.default_rng(4).integers(0, 65536, (17, 12)).astype(np.uint16)
    a = curves.linlog_parameter(16, 7)
    assert (diffused(frame, a, pattern) == scanned(frame, a, pattern)).all()
