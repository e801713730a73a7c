import struct

import numpy as np
import pytest

from framemill.functions.cfa import GRBG
from framemill.functions.frames import pack_cri10
from framemill.operators.brackets import Shot, parse_shots
from framemill.operators.ljpeg import Damaged, encode
from framemill.operators.hdr import exposure_ratios, ratio_sums
from framemill.plans.convert import convert, convert_folder, refine_folder
from framemill.sinks import files
from framemill.sinks.files import FORMATS, Output
from framemill.sources import cri, folders, seq, tiff
from framemill.streaming.watch import watched


def frame(seed=1, h=24, w=32):
    return np.random.default_rng(seed).integers(0, 65536, (h, w)).astype(np.uint16)


def test_raw_folder_to_dng_and_back(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in (1, 2, 10):
        (src / f"f{i}.raw").write_bytes(frame(i).tobytes())
    (src / "f11.raw").write_bytes(b"123")
    raw = folders.read_raw(spark, str(src), 32, 24, GRBG)
    rows = {r.frame_index: r for r in raw.collect()}
    assert [rows[i].name.rsplit("/", 1)[-1] for i in range(4)] == ["f1.raw", "f2.raw", "f10.raw", "f11.raw"]
    assert rows[3].payload is None and rows[3].errors[0].code == "ORIGINAL_FILE_CORRUPTED"
    out = tmp_path / "out"
    done = convert(raw, str(out), [Shot(0, 1.0)], Output("bright16", tile=16)).collect()
    assert sorted(r.output_name for r in done) == ["f1.dng", "f10.dng", "f11.dng.errors.csv", "f2.dng"]
    back = {r.name.rsplit("/", 1)[-1]: r for r in folders.read_dng(spark, str(out)).collect()}
    assert back["f10.dng"].payload == frame(10).tobytes() and list(back["f10.dng"].cfa) == list(GRBG)
    # the same files again are no conflict, others are
    convert(raw, str(out), [Shot(0, 1.0)], Output("bright16", tile=16)).collect()
    with pytest.raises(Exception, match="FileExistsError"):
        convert(raw, str(out), [Shot(0, 1.0)], Output("dark16")).collect()
    assert not any(r.written for r in convert(raw, str(out), [Shot(0, 1.0)], Output("dark16"), mode="ignore").collect())


def test_brackets_are_merged(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.raw").write_bytes((frame(i) >> 3).tobytes())
    raw = folders.read_raw(spark, str(tmp_path), 32, 24, GRBG)
    convert(raw, str(tmp_path / "o"), parse_shots(["E*4", "E"]), Output("bright16", encoding="strip"), new_name="m").collect()
    from framemill.operators.hdr import merged_arrays

    want = merged_arrays([frame(3) >> 3, frame(2) >> 3], [1.0, 4.0])
    got = tiff.linear(tiff.Tiff((tmp_path / "o" / "m_000001.dng").read_bytes()))
    assert (got == want).all()


@pytest.mark.parametrize("kind", FORMATS)
@pytest.mark.parametrize("encoding", ["strip", "deflate", "ljpeg", "ljpeg_tiles"])
def test_output_formats(kind, encoding):
    f = frame(2)
    b = tiff.dng(files.image(f, GRBG, Output(kind, encoding, tile=16, gains=(2.0, 1.0, 1.5), dither=False), "a.raw", b"private"))
    t = tiff.Tiff(b)
    d = t.raw()
    assert d[tiff.WIDTH] == (32,) and tuple(d[tiff.CFA]) == GRBG and d[tiff.NEUTRAL] == pytest.approx((0.5, 1, 1 / 1.5), abs=1e-5)
    v = tiff.linear(t)
    if kind == "bright16":
        assert (v == f).all()
    elif kind == "dark16":
        assert tiff.header(t).format == "dark16" and (v == f >> 4 << 4).all()
    elif kind == "packed12":
        assert (v == f >> 4 << 4).all()
    else:
        table = np.array(d[tiff.LINEARIZATION])
        assert len(table) == 1 << int(kind.lstrip("abcdefghijklmnopqrstuvwxyz_")) and (np.diff(table) >= 0).all()
        # what is read back is the step of the table below or above each sample
        steps = table * (16 if kind.startswith("dark") else 1)
        at = np.clip(np.searchsorted(steps, f), 1, len(steps) - 1)
        assert ((v == steps[at]) | (v == steps[at - 1])).mean() > 0.99


def seq_file(path, frames, real=16, fmt=101):
    h = bytearray(8192)
    n = frames[0].nbytes
    for at, x in ((28, 5), (548, 32), (552, 24), (556, 16), (560, real), (564, n), (568, fmt), (572, len(frames)), (580, n + 64), (608, 1), (620, 0)):
        struct.pack_into("<I", h, at, x)
    path.write_bytes(bytes(h) + b"".join(f.tobytes() + b"\0" * 64 for f in frames))


def test_seq(spark, tmp_path):
    seq_file(tmp_path / "a.b.seq", [frame(i) for i in range(5)], real=12)
    rows = seq.read_seq(spark, str(tmp_path / "a.b.seq"), framesPerTask="2").orderBy("frame_index").collect()
    assert [bytes(r.payload) == frame(i).tobytes() for i, r in enumerate(rows)] == [True] * 5
    assert rows[3].name == "a_b_3" and rows[0].format == "dark16" and tuple(rows[0].cfa) == GRBG
    assert seq.read_seq(spark, str(tmp_path / "a.b.seq"), flip12in16="true", payload="false").first().format == "bright16"
    seq_file(tmp_path / "bad.seq", [frame()], fmt=200)
    with pytest.raises(Exception, match="Bayer"):
        seq.read_seq(spark, str(tmp_path / "bad.seq")).collect()


def tlv(*values):
    return b"".join(struct.pack("<II", t, len(v)) + v for t, v in values)


def test_cri(spark, tmp_path):
    w, h = 36, 20
    f = frame(3, h, w) & 0xFFF0
    tiles = [encode(f[:, a : a + 18].reshape(h // 2, 18, 2)) for a in (0, 18)]
    sizes = b"".join(struct.pack("<Q", len(t)) for t in tiles)
    head = [(100, struct.pack("<IIII", w, h, 88, 1)), (110, b"01:02"), (123, struct.pack("<f", 1.5)), (124, struct.pack("<f", -2.25)), (119, sizes)]
    data = b"".join(tiles)
    (tmp_path / "1.cri").write_bytes(tlv(*head[:2]) + b"\0" * 8 + tlv(*head[2:], (103, data)))
    (tmp_path / "2.cri").write_bytes(tlv(*head, (103, data[: len(tiles[0]) + len(tiles[1]) // 2])))
    (tmp_path / "3.cri").write_bytes(tlv(*head, (103, tiles[0])))
    (tmp_path / "4.cri").write_bytes(tlv((100, struct.pack("<IIII", w, h, 45, 0)), (103, pack_cri10(f.ravel()))))
    (tmp_path / "5.cri").write_bytes(tlv((110, b"x"), (110, b"y")))
    rows = folders.read_cri(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert bytes(rows[0].payload) == f.tobytes() and rows[0].errors == [] and "36x20,88,1" in rows[0].meta[0].text
    half = np.frombuffer(rows[1].payload, "<u2").reshape(h, w)
    assert (half[:, :18] == f[:, :18]).all() and (half[:6, 18:] == f[:6, 18:]).all() and len(rows[1].errors) == 2
    assert rows[2].errors[0].severity == "SEVERE" and not np.frombuffer(rows[2].payload, "<u2").reshape(h, w)[:, 18:].any()
    assert bytes(rows[3].payload) == f.tobytes() and rows[4].errors[0].severity == "CRITICAL"
    stab = folders.read_stabilisation(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert (stab[0].h, stab[0].v) == (1.5, -2.25)
    lines = [r.value for r in files.keyframes(folders.read_stabilisation(spark, str(tmp_path)), w, h).orderBy("order").collect()]
    assert lines[10] == "\t0\t1.5\t-2.25\t" and lines[-1] == "End of Keyframe Data"
    assert folders.read_cri_tags(spark, str(tmp_path)).where("frame_index = 0").first().tags[110] == b"01:02"
    with pytest.raises(Damaged):
        cri.frame(tlv((110, b"x")))


def test_error_reports(spark):
    errors = spark.createDataFrame([("a.dng", "X", "NOTE", 'say "no"', "f", bytearray(b"\x01\xff"))], "output_name string, code string, severity string, description string, filename string, data binary")
    r = files.error_reports(errors).first()
    assert r.output_name == "a.dng.errors.csv" and bytes(r.content).decode().splitlines()[1] == 'X,NOTE,"say ""no""","f",01ff'
    assert bytes(r.content) == files.error_csv([{"code": "X", "severity": "NOTE", "description": 'say "no"', "filename": "f", "data": b"\x01\xff"}])


def test_reports_are_numbered(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.raw").write_bytes(b"12")
    (tmp_path / "in" / "2.raw").write_bytes(frame(2).tobytes())
    out = tmp_path / "out"
    raw = folders.read_raw(spark, str(tmp_path / "in"), 32, 24, GRBG)
    run = lambda: sorted(r.output_name for r in convert(raw, str(out), [Shot(0, 1.0)], Output("bright16", "strip")).collect())
    assert run() == run() == ["1.dng.errors.csv", "2.dng"]
    first = (out / "1.dng.errors.csv").read_text()
    assert first.startswith("ErrorCode,") and "1 samples where 32 x 24 are due" in first
    (out / "1.dng.errors.csv").write_text("another one")
    assert run() == ["1.dng.errors.2.csv", "2.dng"] and (out / "1.dng.errors.2.csv").read_text() == first
    assert not [r for r in convert(raw, str(tmp_path / "none"), [Shot(0, 1.0)], reports=False).collect() if "errors" in r.output_name]


def test_folders_are_converted_without_shuffling_payloads(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(7):
        (src / f"f{i}.raw").write_bytes((frame(i) >> 3).tobytes())
    shots = parse_shots(["E*4", "E"])
    raw = folders.read_raw(spark, str(src), 32, 24, GRBG)
    convert(raw, str(tmp_path / "a"), shots, Output("bright16", "strip"), new_name="m").collect()
    df = convert_folder(spark, str(src), "*.raw", folders.raw_frame(32, 24, GRBG), str(tmp_path / "b"), shots, Output("bright16", "strip"), new_name="m")
    assert len(df.collect()) == 3 and "payload" not in df._jdf.queryExecution().executedPlan().toString()
    for k in range(3):
        assert (tmp_path / "a" / f"m_{k:06}.dng").read_bytes() == (tmp_path / "b" / f"m_{k:06}.dng").read_bytes()


def test_shots_are_refined_over_folders(spark, tmp_path):
    rng = np.random.default_rng(3)
    for k in range(4):
        base = rng.integers(3000, 9000, (24, 32))
        for j, m in enumerate((4, 1, 2)):
            (tmp_path / f"{k}_{j}.raw").write_bytes((base * m).astype(np.uint16).tobytes())
    (tmp_path / "9_9.raw").write_bytes(b"12")
    shots = refine_folder(spark, str(tmp_path), "*.raw", folders.raw_frame(32, 24, GRBG), parse_shots(["E*5", "E", "E*3"]), clip=0.9)
    assert [s.order_index for s in shots] == [1, 2, 0] and [s.multiplier for s in shots] == pytest.approx([1, 2, 4])
    pixels = spark.createDataFrame([(k, y, x, j, int(v)) for k in range(2) for j in range(3) for (y, x), v in np.ndenumerate(frame(3 * k + j, 4, 6))], "set_index int, y int, x int, shot int, v int")
    got = {r.shot: (r.ratio, r.n) for r in exposure_ratios(pixels, 3).collect()}
    want = [ratio_sums([frame(3 * k + j, 4, 6) for j in range(3)]) for k in range(2)]
    assert got == {k + 1: (pytest.approx(sum(w[k][1] for w in want) / n), n) for k in range(2) if (n := sum(w[k][2] for w in want))}


def test_cut_files_are_error_rows(spark, tmp_path):
    good = {}
    for e in ("strip", "deflate", "ljpeg", "ljpeg_tiles"):
        good[f"{e}.dng"] = tiff.dng(files.image(frame(5), GRBG, Output("bright16", e, tile=16)))
    w, h = 36, 20
    f = frame(3, h, w) & 0xFFF0
    good["raw.cri"] = tlv((110, b"01:02"), (100, struct.pack("<IIII", w, h, 88, 1)), (103, (f >> 4).tobytes()))
    rng, n = np.random.default_rng(1), 0
    for name, b in good.items():
        for cut in sorted({1, 7, 8, len(b) // 2, len(b) - 1, *rng.integers(1, len(b), 25).tolist()}):
            (tmp_path / f"{n}_{name}").write_bytes(b[:cut])
            n += 1
        for at in rng.integers(0, len(b), 25).tolist():
            (tmp_path / f"{n}_{name}").write_bytes(b[:at] + bytes([b[at] ^ 0x55]) + b[at + 1 :])
            n += 1
    dngs, cris = folders.read_dng(spark, str(tmp_path)).collect(), folders.read_cri(spark, str(tmp_path)).collect()
    assert len(dngs) + len(cris) == n
    assert all(r.payload is not None or r.errors[0].code == "ORIGINAL_FILE_CORRUPTED" for r in dngs + cris) and sum(r.payload is None for r in dngs) > 100
    folders.read_cri_tags(spark, str(tmp_path)).collect()


def test_only_some_frames_are_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.raw").write_bytes(frame(i).tobytes())
    some = spark.createDataFrame([(1,), (3,), (3,), (9,)], "frame_index long")
    df = folders.read_raw(spark, str(tmp_path), 32, 24, GRBG, only=some)
    assert {r.frame_index: bytes(r.payload) for r in df.collect()} == {i: frame(i).tobytes() for i in (1, 3)}


def test_lines_are_written_in_order(spark, tmp_path):
    df = spark.range(500).selectExpr("(id * 7919) % 500 as `order`").selectExpr("`order`", "concat('line ', `order`) as value")
    files.write_lines(df, str(tmp_path / "t"))
    parts = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts).splitlines() == [f"line {i}" for i in range(500)]


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.raw").write_bytes(frame().tobytes())
    q = watched(spark, str(tmp_path / "in"), "dark16").writeStream.format("memory").queryName("came").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert bytes(spark.table("came").first().payload) == (frame() << 4).astype(np.uint16).tobytes()
    finally:
        q.stop()


def test_dng_data_source(spark, tmp_path):
    from framemill.sinks.datasource import register

    register(spark)
    rows = [(f"{i}.dng", 32, 24, list(GRBG), bytearray(frame(i).tobytes())) for i in range(3)]
    df = spark.createDataFrame(rows, "output_name string, width int, height int, cfa array<int>, payload binary")
    write = lambda d, **o: d.write.format("bayer_dng").options(format="bright16", tile="16", **o).mode("append").save(str(tmp_path / "out"))
    write(df)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.dng", "1.dng", "2.dng"]
    assert (tiff.linear(tiff.Tiff((tmp_path / "out" / "2.dng").read_bytes())) == frame(2)).all()
    write(df)
    other = spark.createDataFrame([(r[0], *r[1:4], bytearray(frame(9).tobytes())) for r in rows], df.schema)
    with pytest.raises(Exception, match="FileExistsError"):
        write(other)
    write(other, ifExists="skip")
    assert (tiff.linear(tiff.Tiff((tmp_path / "out" / "2.dng").read_bytes())) == frame(2)).all()
    write(other, ifExists="replace")
    assert not (tiff.linear(tiff.Tiff((tmp_path / "out" / "2.dng").read_bytes())) == frame(2)).all()
    assert len(list((tmp_path / "out").iterdir())) == 3
