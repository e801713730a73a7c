"""Queries over files: frames of the driver's tables are written below the shared folder by tasks, read back by the sources, and compared with what SQL says of them."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, frames as codecs
from ..functions.cfa import BGGR, GBRG, GRBG, RGGB
from ..operators import brackets, ljpeg
from ..operators.dither import GREEN, PLAIN, SAME_COLOUR, dither
from ..operators.sidechannel import CRI_CHUNK, ERROR, MAGIC, META, error_column, metadata_column
from ..ordering import shared_dir
from ..sinks.files import LINLOG, Output, as_dng, keyframes, write_files
from ..sources import folders, seq
from .carriers import SIDE, payloads, table
from .convert import convert_folder, refine_folder
from .queries import P, dng_frames, query

Frame = np.ndarray
INDEX = "cast(row_number() over (order by i) - 1 as bigint) as frame_index"
GAMMA = f"cast(least(greatest(round_even(pow(v / 65535::double, {curves.gamma_exponent()!r}::double) * 1023, 0), 0), 65535) as integer)"


def payload_sql(v: str = "v") -> str:
    """i and the bytes of each frame in hex, little-endian."""
    return f"(select frame_index as i, string_agg(printf('%02x%02x', s & 255, s >> 8), '' order by y, x) as payload from (select frame_index, y, x, {v} as s from {P}) group by 1)"


def text(cfa: tuple[int, ...]) -> str:
    return ",".join(map(str, cfa))


def files_of(spark: SparkSession, sf_dir: str, make: Callable[[int, Frame], list[tuple[str, bytes]]]) -> DataFrame:
    """output_name, content of the files that are made from each frame."""

    def run(batches):
        for batch in batches:
            for i, b in zip(batch.frame_index, batch.payload):
                yield pd.DataFrame(make(int(i), np.frombuffer(b, "<u2").reshape(SIDE, SIDE)), columns=["output_name", "content"])

    return payloads(spark, sf_dir).repartition("frame_index").mapInPandas(run, "output_name string, content binary")


def folder_of(spark: SparkSession, files: DataFrame) -> str:
    folder = shared_dir(spark)
    write_files(files, folder).agg(F.sum("bytes")).collect()
    return folder


def base(name: str = "name"):
    return F.regexp_extract(name, "([^/]*)$", 1).alias("name")


def shown(df: DataFrame) -> DataFrame:
    return df.select("frame_index", base(), "width", "height", F.array_join(F.transform("cfa", lambda c: c.cast("string")), ",").alias("cfa"), "format", F.lower(F.hex("payload")).alias("payload"), F.size("errors").alias("n_errors"))


def shown_sql(extension: str, v: str = "v", cfa: tuple[int, ...] = GRBG) -> str:
    return f"select {INDEX}, 'f' || i || '.{extension}' as name, 8 as width, 8 as height, '{text(cfa)}' as cfa, 'bright16' as format, payload, 0 as n_errors from {payload_sql(v)}"


# -- headerless files -------------------------------------------------------


def packed_12p(v: Frame) -> bytes:
    """Two samples of 12 bits in three bytes, least significant first."""
    a, b = v.ravel()[::2] >> 4, v.ravel()[1::2] >> 4
    return np.stack([a & 255, a >> 8 | (b & 15) << 4, b >> 4], axis=1).astype(np.uint8).tobytes()


@query(shown_sql("raw", "(v >> 4) << 4"))
def raw_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folder_of(spark, files_of(spark, sf_dir, lambda i, v: [(f"f{i}.raw", packed_12p(v))]))
    return shown(folders.read_raw(spark, folder, SIDE, SIDE, GRBG, "12p"))


@query(f"select frame_index, payload from (select 0::bigint as frame_index, i, payload from {payload_sql('(v >> 4) << 4')}) where i = (select min(vec_id) from embeddings)")
def raw_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folder_of(spark, files_of(spark, sf_dir, lambda i, v: [(f"f{i}.raw", (v >> 4).tobytes())]))
    first = payloads(spark, sf_dir).agg(F.min("frame_index")).first()[0]
    return folders.read_raw(spark, f"{folder}/f{first}.raw", SIDE, SIDE, GRBG, "dark16").select("frame_index", F.lower(F.hex("payload")).alias("payload"))


@query(f"select {INDEX}, 'f' || i || '.raw' as name, 128::bigint as length from (select vec_id as i from embeddings)")
def file_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = folder_of(spark, files_of(spark, sf_dir, lambda i, v: [(f"f{i}.raw", v.tobytes()), (f"f{i}.txt", b"no frame"), (f"f{i}.raw.bak", b"")]))
    return folders.listing(spark, folder, "*.raw").select("frame_index", base(), "length")


@query(f"select frame_index as i, sum(v) as total, arg_min(v, y * 8 + x) as first, arg_max(v, y * 8 + x) as last from {P} group by 1")
def uint16_reinterpret(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            v = [codecs.unpack(b, "bright16").astype(np.int64) for b in batch.payload]
            yield pd.DataFrame({"i": batch.frame_index, "total": [x.sum() for x in v], "first": [x[0] for x in v], "last": [x[-1] for x in v]})

    return payloads(spark, sf_dir).mapInPandas(run, "i long, total long, first int, last int")


# -- DNG files --------------------------------------------------------------


def _dng(name: str, out: Output, v: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = as_dng(dng_frames(spark, sf_dir), out).withColumn("output_name", F.concat(F.lit("f"), "output_name", F.lit(".dng")))
        return shown(folders.read_dng(spark, folder_of(spark, files)))

    run.__name__ = name
    query(shown_sql("dng", v, RGGB))(run)


def linlog_sql(bits_in: int, bits_out: int) -> str:
    """What a reduced sample is read back as."""
    a, v = repr(curves.linlog_parameter(bits_in, bits_out)), "v" if bits_in == 16 else "(v >> 4)"
    code = f"least(greatest(round_even(ln({a}::double * {v} + 1) / ln({a}::double + 1), 0), 0), 65535)"
    back = f"cast(least(greatest(round_even((pow({a}::double + 1, {code}) - 1) / {a}::double, 0), 0), 65535) as integer)"
    return back if bits_in == 16 else f"(({back} << 4) & 65535)"


for _encoding in ("strip", "deflate", "ljpeg", "ljpeg_tiles"):
    _dng(f"dng_{_encoding}", Output("bright16", _encoding, tile=16), "v")
_dng("dng_dark16", Output("dark16", "strip"), "(v >> 4) << 4")
_dng("dng_packed12", Output("packed12", "strip"), "(v >> 4) << 4")
_dng("dng_gamma10", Output("gamma10", "strip"), f"cast(least(greatest(round_even(pow({GAMMA} / 1023::double, {1 / curves.gamma_exponent()!r}::double) * 65535, 0), 0), 65535) as integer)")
for _format, _bits in LINLOG.items():
    _dng(f"dng_{_format}", Output(_format, "strip", dither=False), linlog_sql(*_bits))


# -- sequence files ---------------------------------------------------------

OF = 50
PATTERNS = (GBRG, GRBG, BGGR, RGGB)


def seq_bytes(k: int, frames: list[bytes]) -> bytes:
    """A sequence of frames as stored: even ones of 16 bits, odd ones of 12 in 16, with one of the four patterns."""
    head = bytearray(seq.FIRST_FRAME)
    for at, x in ((28, 5), (548, SIDE), (552, SIDE), (556, 16), (560, 12 if k % 2 else 16), (564, 128), (568, seq.BAYER), (572, len(frames)), (580, 160), (608, k % 4), (620, 0)):
        struct.pack_into("<I", head, at, x)
    return bytes(head) + b"".join(b.ljust(160, b"\0") for b in frames)


@query(f"""select 's.' || i // {OF} || '.seq' as seq_id, cast(row_number() over (partition by i // {OF} order by i) - 1 as bigint) as frame_index, 's_' || i // {OF} || '_' || row_number() over (partition by i // {OF} order by i) - 1 as name,
case when i // {OF} % 2 = 0 then 'bright16' else 'dark16' end as format, ['{"','".join(map(text, PATTERNS))}'][i // {OF} % 4 + 1] as cfa, payload from {payload_sql()}""")
def seq_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.frame_index.iloc[0]) // OF
        return pd.DataFrame([(f"s.{k}.seq", seq_bytes(k, [bytes(b) for b in pdf.sort_values("frame_index").payload]))], columns=["output_name", "content"])

    files = payloads(spark, sf_dir).groupBy(F.expr(f"frame_index div {OF}")).applyInPandas(build, "output_name string, content binary")
    df = seq.read_seq(spark, folder_of(spark, files))
    return df.select(base("seq_id").alias("seq_id"), "frame_index", "name", "format", F.array_join(F.transform("cfa", lambda c: c.cast("string")), ",").alias("cfa"), F.lower(F.hex("payload")).alias("payload"))


# -- film-scan files --------------------------------------------------------

MODEL_CFA = {45: GRBG, 88: BGGR, 89: GBRG, 90: RGGB, 91: GRBG}


def cri_bytes(i: int, v: Frame) -> bytes:
    """By turns 12 bits in 16, 10-bit groups, and tiles of lossless JPEG."""
    tag = lambda t, b: struct.pack("<II", t, len(b)) + b
    model, sizes = 45 if i % 3 == 1 else 88 + i % 4, b""
    if i % 3 == 0:
        data = (v >> 4).tobytes()
    elif i % 3 == 1:
        data = codecs.pack_cri10(np.pad(v.ravel(), (0, 8)))
    else:
        tiles = [ljpeg.encode(np.ascontiguousarray(v[:, a : a + 4]).reshape(4, 4, 2)) for a in (0, 4)]
        data, sizes = b"".join(tiles), tag(119, b"".join(struct.pack("<Q", len(t)) for t in tiles))
    head = tag(100, struct.pack("<IIII", SIDE, SIDE, model, 1)) + b"\0" * 8 + tag(110, f"00:{i}".encode()) + tag(123, struct.pack("<f", i % 9 / 4)) + tag(124, struct.pack("<f", -(i % 7) / 8))
    return head + sizes + tag(1000, b"filler") + tag(103, data)


def cri_folder_of(spark: SparkSession, sf_dir: str) -> str:
    return folder_of(spark, files_of(spark, sf_dir, lambda i, v: [(f"f{i}.cri", cri_bytes(i, v))]))


_MODEL = "case when i % 3 = 1 then 45 else 88 + i % 4 end"
_FLOAT = "rtrim(rtrim(printf('%.9f', {}::double), '0'), '.')"
_H, _V = "(i % 9) / 4::double", "-(i % 7) / 8::double"


@query(f"""select {INDEX}, 'f' || i || '.cri' as name, 8 as width, 8 as height, case {_MODEL} {" ".join(f"when {m} then '{text(c)}'" for m, c in MODEL_CFA.items())} end as cfa, 'bright16' as format, payload, 0 as n_errors
from {payload_sql("case when frame_index % 3 = 2 then v else (v >> 4) << 4 end")}""")
def cri_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(folders.read_cri(spark, cri_folder_of(spark, sf_dir)))


@query(f"select {INDEX}, case when i % 3 = 2 then '100,110,119,123,124' else '100,110,123,124' end as tags, '00:' || i as timecode from (select vec_id as i from embeddings)")
def cri_tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folders.read_cri_tags(spark, cri_folder_of(spark, sf_dir))
    keys = F.transform(F.array_sort(F.map_keys("tags")), lambda k: k.cast("string"))
    return df.select("frame_index", F.array_join(keys, ",").alias("tags"), F.element_at("tags", F.lit(110).cast("long")).cast("string").alias("timecode"))


@query(f"""select {INDEX}, 'tag,value' || chr(10) || 'FrameInfo,"8x8,' || {_MODEL} || ',1"' || chr(10) || 'TimeCode,"00:' || i || '"' || chr(10) || 'OffsetToApplyH,"' || {_FLOAT.format(_H)} || '"' || chr(10) || 'OffsetToApplyV,"' || replace({_FLOAT.format(_V)}, '-0x', '0') || '"' || chr(10) || case when i % 3 = 2 then 'TileSizes,"n,n"' || chr(10) else '' end as text
from (select vec_id as i from embeddings)""")
def cri_metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = folders.read_cri(spark, cri_folder_of(spark, sf_dir))
    return df.select("frame_index", F.regexp_replace(F.regexp_replace(F.col("meta")[0]["text"], r'TileSizes,"\d+,\d+"', 'TileSizes,"n,n"'), '"-0"', '"0"').alias("text"))


@query(f"select {INDEX}, cast({_H} as float) as h, cast({_V} as float) as v from (select vec_id as i from embeddings)")
def cri_stabilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.read_stabilisation(spark, cri_folder_of(spark, sf_dir)).select("frame_index", "h", (F.col("v") + F.lit(0.0)).cast("float").alias("v"))


@query("select vec_id as i, 2::bigint as tiles, true as whole from embeddings")
def tile_size_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles' sizes of each film-scan frame add up to its data."""

    def run(batches):
        for batch in batches:
            for i, b in zip(batch.frame_index, batch.payload):
                v = np.frombuffer(b, "<u2").reshape(SIDE, SIDE)
                values = dict(folders.cri.tags(cri_bytes(int(i) * 3 + 2, v)))
                yield pd.DataFrame({"i": i, "size": list(np.frombuffer(values[119], "<u8").astype(np.int64)), "data": len(values[103])})

    rows = payloads(spark, sf_dir).mapInPandas(run, "i long, size long, data long")
    return rows.groupBy("i").agg(F.count("*").alias("tiles"), (F.sum("size") == F.max("data")).alias("whole"))


@query("""with t as (select unnest([3, 4, 5, 6, 8, 16]) as tile), s as (select tile, cast((select count(*) from embeddings) * pow(ceil(8 / tile::double) * tile, 2) * 2 as bigint) as bytes from t)
select tile, bytes, (select arg_min(tile, (bytes, tile)) from s) as best from s""")
def tile_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all frames' zero-padded tiles by tile size, and the least size of those that take least."""
    sizes = spark.createDataFrame([(t,) for t in (3, 4, 5, 6, 8, 16)], "tile int")
    across = F.ceil(F.lit(SIDE) / F.col("tile")) * F.col("tile")
    rows = sizes.withColumn("bytes", (across * across * 2 * F.lit(table(spark, sf_dir, "embeddings").count())).cast("long"))
    return rows.withColumn("best", rows.agg(F.min_by("tile", F.struct("bytes", "tile"))).scalar())


# -- reports and blobs ------------------------------------------------------

_HEAD = ["Adobe After Effects 8.0 Keyframe Data", "", "\tUnits Per Second\t24", "\tSource Width\t640", "\tSource Height\t480", "\tSource Pixel Aspect Ratio\t1", "\tComp Pixel Aspect Ratio\t1", "", "Effects\tPoint Control\tPoint", "\tFrame\tX pixels\tY pixels\t"]


@query(
    'select o as "order", t as value from (values '
    + ", ".join(f"({k - len(_HEAD)}::bigint, '{s}')" for k, s in enumerate(_HEAD))
    + ", (4611686018427387904::bigint, ''), (4611686018427387905::bigint, ''), (4611686018427387906::bigint, 'End of Keyframe Data')) x(o, t)"
    + " union all select event_id, chr(9) || event_id || chr(9) || event_id % 9 || chr(9) || -(event_id % 7) || chr(9) from events"
)
def keyframe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"), (F.col("event_id") % 9).cast("float").alias("h"), (-(F.col("event_id") % 7)).cast("float").alias("v"))
    return keyframes(rows, 640, 480)


def u32(n: str) -> str:
    return f"printf('%02x%02x0000', cast({n} as integer) & 255, cast({n} as integer) >> 8)"


def field_sql(hexed: str) -> str:
    return f"({u32(f'length({hexed}) // 2')} || {hexed})"


def hex_sql(s: str) -> str:
    return f"lower(hex(encode({s})))"


_ERRORS = f"case when i % 2 = 0 then {u32('1')} || {u32('1')} || {u32('4')} || {field_sql(chr(39) + '01ff' + chr(39))} || {field_sql(hex_sql(chr(39) + 'cut off' + chr(39)))} || {field_sql(hex_sql('i || ' + chr(39) + '.cri' + chr(39)))} else {u32('0')} end"


@query(f"select i, e as errors, '{MAGIC.hex()}' || {u32('2')} || {u32(str(CRI_CHUNK))} || {field_sql('payload')} || {field_sql(hex_sql(chr(39) + 'frame ' + chr(39) + ' || i'))} || {field_sql(hex_sql('i || ' + chr(39) + '.cri' + chr(39)))} || {u32('1')} || {field_sql('e')} || {u32('0')} || {u32('0')} as blob from (select *, {_ERRORS} as e from {payload_sql()})")
def metadata_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The private blob of each frame (a chunk, and its errors as the last one), and the errors' own blob."""
    i, name = F.col("frame_index"), F.concat(F.col("frame_index").cast("string"), F.lit(".cri"))
    chunk = F.struct(F.lit(CRI_CHUNK).alias("format"), F.col("payload").alias("data"), F.concat(F.lit("frame "), i.cast("string")).alias("text"), name.alias("filename"))
    error = F.struct(F.lit("ORIGINAL_FILE_CORRUPTED").alias("code"), F.lit("CRITICAL").alias("severity"), F.lit("cut off").alias("description"), name.alias("filename"), F.unhex(F.lit("01FF")).alias("data"))
    rows = payloads(spark, sf_dir).select(i.alias("i"), F.array(chunk).cast(f"array<{META}>").alias("meta"), F.when(i % 2 == 0, F.array(error)).otherwise(F.array()).cast(f"array<{ERROR}>").alias("errors"))
    return rows.select("i", F.lower(F.hex(error_column("errors"))).alias("errors"), F.lower(F.hex(metadata_column("meta", "errors"))).alias("blob"))


def damaged(i: int, v: Frame) -> bytes:
    return v.tobytes()[: 100 if i % 5 == 0 else 128]


@query("select case when vec_id % 5 = 0 then 'f' || vec_id || '.dng.errors.csv' else 'f' || vec_id || '.dng' end as output_name, true as written, case when vec_id % 5 = 0 then 'ErrorCode,Severity,\"Error Description\",\"Original Filename\",\"Binary Data\"' || chr(10) || 'ORIGINAL_FILE_CORRUPTED,CRITICAL,\"50 samples where 8 x 8 are due\",\"f' || vec_id || '.raw\",' || chr(10) end as report from embeddings")
def conversion_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with cut files is converted: a DNG file for each whole one, a report for each other."""
    folder, out = folder_of(spark, files_of(spark, sf_dir, lambda i, v: [(f"f{i}.raw", damaged(i, v))])), shared_dir(spark)
    done = convert_folder(spark, folder, "*.raw", folders.raw_frame(SIDE, SIDE, RGGB), out, brackets.parse_shots(["E"]), Output("bright16", "strip"))
    kept = shared_dir(spark)
    done.write.parquet(kept)
    reports = spark.read.format("binaryFile").option("pathGlobFilter", "*.errors.csv").load(out).select(F.regexp_extract("path", "([^/]*)$", 1).alias("output_name"), F.regexp_replace(F.col("content").cast("string"), '"[^"]*/', '"').alias("report"))
    return spark.read.parquet(kept).select("output_name", "written").join(reports, "output_name", "left")


@query("select vec_id || '.bin' as output_name, 128::bigint as bytes, vec_id % 2 = 0 as written, true as refused from embeddings")
def sink_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder that has the odd files already, ignore writes the even ones; errorifexists refuses files that are others."""
    folder = shared_dir(spark)
    files = files_of(spark, sf_dir, lambda i, v: [(f"{i}.bin", v.tobytes())])
    write_files(files_of(spark, sf_dir, lambda i, v: [(f"{i}.bin", b"other")] if i % 2 else []), folder).agg(F.sum("bytes")).collect()
    kept = shared_dir(spark)
    write_files(files, folder, "ignore").write.parquet(kept)
    try:
        write_files(files, folder).agg(F.sum("bytes")).collect()
        refused = False
    except Exception as e:
        refused = "FileExistsError" in str(e)
    return spark.read.parquet(kept).withColumn("refused", F.lit(refused))


# -- shots and curves -------------------------------------------------------


@query("select * from (values (0, 2::integer, 1.0::double), (1, 0, 1.5), (2, 3, 4.0), (3, 1, 8.0)) t(place, order_index, multiplier)")
def shots_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = brackets.parse_shots(["E*1.5", "E+3", "X", "", "E", "E+2"])
    return spark.createDataFrame([(k, s.order_index, s.multiplier) for k, s in enumerate(shots)], "place int, order_index int, multiplier double")


@query("select bits_in, bits_out, round(cast(a as double), 7) as p from (values (16, 10, 0.005831706003583573), (16, 8, 0.03021831348618433), (16, 7, 0.06845352770177492), (12, 8, 0.01678523768511033), (12, 7, 0.04126774994288292), (12, 6, 0.10027132444786767), (12, 5, 0.25070923464943545)) t(bits_in, bits_out, a)")
def linlog_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve's parameter for each pair of bit depths, solved; SQL has known solutions."""
    return spark.createDataFrame([(*b, round(curves.linlog_parameter(*b), 7)) for b in sorted(set(LINLOG.values()), reverse=True)], "bits_in int, bits_out int, p double")


def _good(v: str, dark: str) -> str:
    return f"{v} / 65535::double <= 0.7 and {v} / 65535::double > 0.03125 and {dark} / 65535::double > 0.03125"


@query(f"""with s as (select set_index, y, x, max(v) filter (shot = 0) as s0, max(v) filter (shot = 1) as s1, max(v) filter (shot = 2) as s2 from (select k // 3 as set_index, k % 3 as shot, y, x, v from (select *, dense_rank() over (order by frame_index) - 1 as k from {P})) group by 1, 2, 3 having count(*) = 3),
r as (select avg(s1 / s0::double) filter ({_good("s1", "s0")}) as r1, avg(s2 / s1::double) filter ({_good("s2", "s1")}) as r2 from s)
select 0 as order_index, 1.0::double as multiplier union all select 1, round(r1, 6) from r union all select 2, round(r1 * r2, 6) from r""")
def refined_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's brackets of three, their multipliers measured."""
    folder = folder_of(spark, files_of(spark, sf_dir, lambda i, v: [(f"f{i}.raw", v.tobytes())]))
    shots = refine_folder(spark, folder, "*.raw", folders.raw_frame(SIDE, SIDE, RGGB), brackets.parse_shots(["E", "E+1", "E+2"]))
    return spark.createDataFrame([(s.order_index, round(s.multiplier, 6)) for s in shots], "order_index int, multiplier double")


def dither_sql(pattern: tuple[int, ...] | None) -> str:
    """Error diffusion of 8 by 8 frames, sample by sample in scan order."""
    a = repr(curves.linlog_parameter(16, 8))

    def gathered(sources, edge: int) -> str:
        out = "px[pos + 1]"
        for dx, dy, share in sources:
            ok = [f"y >= {-dy}", f"x >= {-dx}" if dx < 0 else f"x < {SIDE - dx}", f"x < {SIDE - edge - dx}" if dx < 0 else "true"]
            out = f"({out} + case when {' and '.join(ok)} then errs[(y + {dy}) * 8 + x + {dx} + 1] * {share} / 16 else 0 end)"
        return out

    value = gathered(PLAIN, 1)
    if pattern:
        green = " or ".join(f"(y % 2 = {k // 2} and x % 2 = {k % 2})" for k, c in enumerate(pattern) if c == 1)
        value = f"case when {green} then {gathered(GREEN, 2)} else {gathered(SAME_COLOUR, 2)} end"
    return f"""with recursive f as (select frame_index, list(cast(v as double) order by y, x) as px from {P} group by 1),
s(frame_index, px, pos, codes, errs) as (select frame_index, px, 0, []::integer[], []::double[] from f union all
select frame_index, px, pos + 1, list_append(codes, cast(code as integer)), list_append(errs, val - least(greatest(round_even((pow({a}::double + 1, code) - 1) / {a}::double, 0), 0), 65535))
from (select *, least(greatest(round_even(ln({a}::double * greatest(val, 0) + 1) / ln({a}::double + 1), 0), 0), 65535) as code from (select *, {value} as val from (select *, pos // 8 as y, pos % 8 as x from s where pos < 64))))
select frame_index, list_aggregate([printf('%02x%02x', c & 255, c >> 8) for c in codes], 'string_agg', '') as codes from s where pos = 64"""


def _dither(name: str, pattern: tuple[int, ...] | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return payloads(spark, sf_dir).select("frame_index", F.lower(F.hex(dither("payload", SIDE, 16, 8, pattern))).alias("codes"))

    run.__name__ = name
    query(dither_sql(pattern))(run)


_dither("linlog_dither", GRBG)
_dither("linlog_dither_plain", None)


# -- lossless JPEG ----------------------------------------------------------


@query("select vec_id as frame_index, cast(1 + vec_id % 7 as integer) as predictor, cast(case when vec_id % 2 = 1 then 8 else 0 end as integer) as restart, 16 as bits, 8 as height, 4 as width, 2 as components, true as same from embeddings")
def ljpeg_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of every predictor, every other one with restart markers behind two rows: what their markers say, and whether they give the frame back."""

    def run(batches):
        for batch in batches:
            frames = [np.frombuffer(b, "<u2").reshape(SIDE, SIDE // 2, 2) for b in batch.payload]
            streams = [ljpeg.encode(v, 16, 1 + i % 7, 2 * (i % 2)) for i, v in zip(batch.frame_index, frames)]
            scans = [ljpeg.parse(b) for b in streams]
            same = [isinstance(g, np.ndarray) and bool((g == v).all()) for g, v in zip(ljpeg.decode_many(streams), frames)]
            yield pd.DataFrame({"frame_index": batch.frame_index, "predictor": [s.predictor for s in scans], "restart": [s.restart for s in scans], "bits": [s.bits for s in scans], "height": [s.height for s in scans], "width": [s.width for s in scans], "components": [s.components for s in scans], "same": same})

    return payloads(spark, sf_dir).mapInPandas(run, "frame_index long, predictor int, restart int, bits int, height int, width int, components int, same boolean")


@query("select vec_id as frame_index, true as columns, true as blocks, true as pairs from embeddings")
def ljpeg_camera_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-size raw, with one and with two rows for a sample of the other components, and pairs of columns: whether they give back what went in."""

    def run(batches):
        for batch in batches:
            frames = [np.frombuffer(b, "<u2").reshape(SIDE, SIDE) for b in batch.payload]
            same = []
            for rows in (1, 2):
                others = [np.stack([v[::rows, ::2], v[::rows, 1::2]], axis=2) for v in frames]
                back = ljpeg.decode_many([ljpeg.encode_half_size(v, c, rows) for v, c in zip(frames, others)])
                same.append([bool((b[..., 0] == v).all() and (b[::rows, ::2, 1:] == c).all()) for b, v, c in zip(back, frames, others)])
            back = ljpeg.decode_many([ljpeg.encode_pairs(v) for v in frames])
            yield pd.DataFrame({"frame_index": batch.frame_index, "columns": same[0], "blocks": same[1], "pairs": [bool((b[..., 0] == v).all()) for b, v in zip(back, frames)]})

    return payloads(spark, sf_dir).mapInPandas(run, "frame_index long, columns boolean, blocks boolean, pairs boolean")
