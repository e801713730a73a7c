import numpy as np
import pytest
from pyspark.sql import functions as F

from framemill.functions.cfa import GRBG, RGGB
from framemill.operators import brackets, hdr, ljpeg, pixels, sidechannel
from framemill.ordering import numbered


def test_ljpeg_round_trips():
    rng = np.random.default_rng(5)
    for h, w in ((1, 2), (3, 8), (40, 30)):
        for f in (rng.integers(0, 65536, (h, w)), np.zeros((h, w), int), rng.choice([0, 32767, 32768, 65535], (h, w)), np.cumsum(rng.integers(-9, 10, (h, w)), 1) + 30000):
            f = f.astype(np.uint16)
            assert (ljpeg.decode_frame(ljpeg.encode_frame(f)) == f).all()
    with pytest.raises(ValueError):
        ljpeg.encode_frame(np.zeros((2, 3), np.uint16))


def test_ljpeg_damaged_gives_what_is_there():
    f = np.random.default_rng(6).integers(0, 65536, (20, 20)).astype(np.uint16)
    b = ljpeg.encode_frame(f)
    with pytest.raises(ljpeg.Damaged) as e:
        ljpeg.decode(b[: len(b) // 2])
    got = e.value.partial.reshape(20, 20)
    assert (got[:8] == f[:8]).all() and not got[-1].any()


@pytest.mark.parametrize("predictor", range(1, 8))
def test_predictors(predictor):
    rng = np.random.default_rng(7)
    d = rng.integers(-50, 50, (6, 5, 1))
    out = ljpeg._predicted(d, predictor, 32768)
    assert out[0, 0, 0] == 32768 + d[0, 0, 0]
    a, b, c = (int(out[y, x, 0]) for y, x in ((3, 2), (2, 3), (2, 2)))
    guess = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + ((b - c) >> 1), 6: b + ((a - c) >> 1), 7: (a + b) >> 1}[predictor]
    assert out[3, 3, 0] == (guess + d[3, 3, 0]) % 65536


def test_tiles_put_together_are_the_frame():
    f = np.arange(35 * 22, dtype=np.uint16).reshape(35, 22)
    full = np.zeros((48, 32), np.uint16)
    for y, x, t in ljpeg.tiled(f, 16):
        full[y * 16 : y * 16 + 16, x * 16 : x * 16 + 16] = t
    assert (full[:35, :22] == f).all() and full.sum() == f.sum(dtype=int)


def test_hdr_pixels_equal_frames(spark):
    rng = np.random.default_rng(8)
    shots = [rng.integers(0, 65536, 400).astype(np.uint16) for _ in range(3)]
    df = spark.createDataFrame([(i, *(int(s[i]) for s in shots)) for i in range(400)], "i int, s0 int, s1 int, s2 int")
    for how in (hdr.Merge(), hdr.Merge(0.8, 0.5), hdr.Merge(0.8, 0.25, rising=False)):
        for m in ([1.0, 2.0, 8.0], [0.5, 3.0, 3.7]):
            got = df.select(hdr.merged(["s0", "s1", "s2"], m, how).alias("v"), "i").orderBy("i").toPandas().v.to_numpy()
            assert (got == hdr.merged_arrays(shots, m, how)).all()
    assert (hdr.merged_arrays(shots[:1], [1.0]) == shots[0]).all()


def test_refined_chain():
    assert hdr.refined({1: 4.0, 2: 2.0}, [1, 1, 1]) == [1, 4, 8]
    assert hdr.refined({1: 4.0, 2: 2.0, 3: 2.0}, [1] * 4) == [1, 4, 8, 64]
    assert hdr.refined({1: 4.0, 2: 2.0, 3: 2.0}, [1] * 4, compat=False) == [1, 4, 8, 16]
    assert np.isnan(hdr.refined({}, [1, 1])[1])


def test_shots():
    assert [(s.order_index, s.multiplier) for s in brackets.parse_shots(["E+2", "", "X", "e", "E*1,5"])] == [(1, 1.0), (2, 1.5), (0, 4.0)]
    assert brackets.parse_shots(["", ""]) == []
    with pytest.raises(ValueError):
        brackets.parse_shots(["E"] * 7)


def test_natural_order(spark):
    names = ["f10", "f9", "f09", "f01", "f1", "a2b10", "a2b9", "f" + "9" * 25, "a2"]
    got = [r.name for r in brackets.indexed(spark.createDataFrame([(n,) for n in names], "name string")).orderBy("frame_index").collect()]
    assert got == ["a2", "a2b9", "a2b10", "f1", "f01", "f9", "f09", "f10", "f" + "9" * 25]


def test_jobs(spark):
    frames = spark.createDataFrame([(i, f"/x/y.z/f{i}.raw") for i in range(10) if i != 5], "frame_index long, name string")
    rows = brackets.jobs(frames, 2, delay=1).orderBy("job_index").collect()
    assert [r.shot_indices for r in rows] == [[1, 2], [3, 4], [7, 8]]
    assert [r.output_name for r in rows] == ["f1.dng", "f3.dng", "f7.dng"] and rows[0].original_filename == "f1.raw,f2.raw"
    rows = brackets.jobs(frames, 1, new_name="take", split=2, reverse=True).orderBy("job_index").collect()
    assert [r.output_name for r in rows][:3] == ["1/take_000000.dng", "2/take_000000.dng", "1/take_000001.dng"] and rows[0].shot_indices == [9]
    assert brackets.jobs(frames.limit(0), 2).count() == 0


def test_numbered_is_consecutive(spark):
    df = numbered(spark.range(1000).repartition(5), [F.col("id").desc()], "n").toPandas()
    assert (df.n == 999 - df.id).all()


def test_crop_twice_is_crop(spark):
    df = spark.createDataFrame([(0, y, x, y * 10 + x) for y in range(10) for x in range(10)], "frame_index int, y int, x int, v int")
    once = pixels.crop(df, 10, 10, 4, 2, 2, 2)
    twice = pixels.crop(pixels.crop(df, 10, 10, 2, 2, 0, 0), 8, 8, 2, 0, 2, 2)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_blobs():
    chunk = {"format": 2, "data": b"ab", "text": "é", "filename": "f"}
    error = {"code": "ORIGINAL_FILE_CORRUPTED", "severity": "SEVERE", "description": "d", "filename": "f", "data": b""}
    back = sidechannel.read_metadata_blob(sidechannel.metadata_blob([chunk], [error]))
    assert back[0] == chunk and back[1]["data"] == sidechannel.error_blob([error])


def test_patterns(spark):
    df = spark.createDataFrame([(0, y, x, 65535) for y in range(4) for x in range(4)], "frame_index int, y int, x int, v int")
    for p in (GRBG, RGGB):
        r = pixels.debayer_preview(df, p, (1.0, 0.5, 0.0), gamma=False).first()
        assert (r.r, r.g, r.b) == (255, 127, 0)
