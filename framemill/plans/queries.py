"""Every operator as a query over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves, scalars
from ..functions.cfa import GRBG, RGGB, channel_gain
from ..functions.curves import linlog_parameter
from ..operators import brackets, hdr, pixels as px
from ..operators.ljpeg import category_counts, decode_payload, encode_frame, encode_payload, tiled
from ..operators.sidechannel import error_csv_row
from ..ordering import numbered
from ..sinks.files import Output, as_dng, image, stabilisation_csv
from ..sources import tiff
from .carriers import SIDE, packed_bytes, payloads, pixels, sequence, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Carriers in SQL.
P = "(select vec_id as frame_index, cast(pos // 8 as integer) as y, cast(pos % 8 as integer) as x, cast(least(greatest(round_even((cast(e as double) + 1) / 2 * 65535, 0), 0), 65535) as integer) as v from (select vec_id, unnest(embedding) as e, unnest(range(0, len(embedding))) as pos from embeddings))"
S = "(select event_id as frame_index, 's' || cast(event_id % 13 as varchar) || 'f' || repeat('0', cast(event_id % 3 as integer)) || cast(event_id as varchar) as name from events)"
B = "(select o_orderkey, cast(o_orderkey % 256 as integer) as b0, cast((o_orderkey // 256) % 256 as integer) as b1, cast(o_custkey % 256 as integer) as b2, cast((o_custkey // 256) % 256 as integer) as b3, cast((o_orderkey + o_custkey) % 256 as integer) as b4 from orders)"
SRGB = "case when {v} > 0.0031308::double then 1.055::double * pow({v}, 1 / 2.4::double) - 0.055::double else 12.92::double * {v} end"
LEVEL = "(v / 65535::double)"
PHASE = "cast(y % 2 * 2 + x % 2 as integer)"


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"select {PHASE} as channel, count(*) as n, max(v) as peak, round(avg(v), 6) as mean from {P} group by 1")
def cfa_channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.channel_stats(pixels(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


# -- sample codecs ----------------------------------------------------------


@query(f"select o_orderkey, (b0 | ((b1 & 15) << 8)) << 4 as v0, ((b2 << 4) | (b1 >> 4)) << 4 as v1 from {B}")
def unpack_12p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_bytes(spark, sf_dir).select("o_orderkey", scalars.unpack_12p("b0", "b1", "b2").alias("v")).select("o_orderkey", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"))


@query(f"select o_orderkey, ((b0 << 4) | (b1 & 15)) << 4 as v0, ((b2 << 4) | (b1 >> 4)) << 4 as v1 from {B}")
def unpack_12p_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_bytes(spark, sf_dir).select("o_orderkey", scalars.unpack_12p_v2("b0", "b1", "b2").alias("v")).select("o_orderkey", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"))


@query("select o_orderkey, " + ", ".join(f"((b{k} << 2) | ((b4 >> {2 * k}) & 3)) << 6 as v{k}" for k in range(4)) + f" from {B}")
def unpack_10p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_bytes(spark, sf_dir).select("o_orderkey", scalars.unpack_10p("b0", "b1", "b2", "b3", "b4").alias("v")).select("o_orderkey", *[F.col("v")[k].alias(f"v{k}") for k in range(4)])


@query(f"select o_orderkey, (v0 >> 4) >> 4 as p0, (((v0 >> 4) & 15) << 4) | ((v1 >> 4) >> 8) as p1, (v1 >> 4) & 255 as p2 from (select o_orderkey, b0 * 256 + b2 as v0, b1 * 256 + b4 as v1 from {B})")
def pack_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed_bytes(spark, sf_dir).select("o_orderkey", (F.col("b0") * 256 + F.col("b2")).alias("v0"), (F.col("b1") * 256 + F.col("b4")).alias("v1"))
    return rows.select("o_orderkey", scalars.pack_12("v0", "v1").alias("p")).select("o_orderkey", *[F.col("p")[k].alias(f"p{k}") for k in range(3)])


@query(f"select frame_index, y, x, (v << 4) & 65535 as v from {P}")
def dark_to_intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("v", scalars.dark_to_linear("v"))


@query(f"select frame_index, y, x, v >> 4 as v from {P}")
def intermediate_to_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("v", scalars.linear_to_dark("v"))


@query(f"select frame_index, y, x, cast(least(greatest(round_even(pow({LEVEL}, {curves.gamma_exponent()!r}::double) * 1023, 0), 0), 65535) as integer) as v from {P}")
def gamma10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("v", curves.gamma_reduce(F.col("v")))


def _linlog(bits_in: int, bits_out: int) -> None:
    a = repr(linlog_parameter(bits_in, bits_out))
    v = "v" if bits_in == 16 else "(v >> 4)"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = F.col("v") if bits_in == 16 else scalars.linear_to_dark("v")
        return pixels(spark, sf_dir).withColumn("v", curves.linlog_reduce(x, bits_in, bits_out))

    run.__name__ = f"linlog_{bits_in}_{bits_out}"
    query(f"select frame_index, y, x, cast(least(greatest(round_even(ln({a}::double * {v} + 1) / ln({a}::double + 1), 0), 0), 65535) as integer) as v from {P}")(run)

    def lut(spark: SparkSession, sf_dir: str) -> DataFrame:
        return curves.linlog_table(spark, bits_in, bits_out)

    lut.__name__ = f"linearization_lut_linlog_{bits_in}_{bits_out}"
    query(f"select cast(i as integer) as i, cast(least(greatest(round_even((pow({a}::double + 1, i) - 1) / {a}::double, 0), 0), 65535) as integer) as v from range({2**bits_out}) t(i)")(lut)


for _pair in ((16, 10), (16, 8), (16, 7), (12, 8), (12, 7), (12, 6), (12, 5)):
    _linlog(*_pair)


@query(f"select cast(i as integer) as i, cast(least(greatest(round_even(pow(i / 1023::double, {1 / curves.gamma_exponent()!r}::double) * 65535, 0), 0), 65535) as integer) as v from range(1024) t(i)")
def linearization_lut_gamma10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.gamma_table(spark)


@query(f"select frame_index, y, x, v * case when {PHASE} in (0, 3) then 1.0::double when {PHASE} = 1 then 2.0::double else 1.5::double end as v from {P}")
def channel_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("v", channel_gain("v", GRBG, (2.0, 1.0, 1.5), "y", "x"))


@query("select event_id, rtrim(rtrim(t, '0'), '.') as t, lower(hex(event_type)) as h from (select event_id, event_type, cast(cast(cast(value as varchar) as decimal(38, 20)) as varchar) as t from events)")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.float_text("value").alias("t"), scalars.hex_string(F.col("event_type").cast("binary")).alias("h"))


@query("select o_orderkey, o_custkey - o_custkey % 2 as even, o_custkey + (4 - o_custkey % 4) % 4 as stride, least(greatest(o_custkey, 100), 1000) as c from orders")
def size_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.floor_even("o_custkey").alias("even"), scalars.padded_stride("o_custkey").alias("stride"), scalars.clamp("o_custkey", 100, 1000).cast("long").alias("c"))


# -- geometry and previews --------------------------------------------------


@query(f"select frame_index, y - 2 as y, x - 2 as x, v from {P} where x >= 2 and x < 6 and y >= 2 and y < 8")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.crop(pixels(spark, sf_dir), SIDE, SIDE, left=3, top=2, right=2, bottom=1)


@query(f"select frame_index, y, x, v, cast(y // 6 as integer) as tile_y, cast(x // 6 as integer) as tile_x, y % 6 as in_y, x % 6 as in_x from {P}")
def tile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.tiles(pixels(spark, sf_dir), 6)


@query(f"select frame_index, cast(y // 6 as integer) as tile_y, cast(x // 6 as integer) as tile_x, count(*) as n, 36 - count(*) as padding from {P} group by 1, 2, 3")
def tile_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.padded_tiles(pixels(spark, sf_dir), 6)


@query(f"select frame_index, cast(y // 4 as integer) as y, cast(x // 4 as integer) as x, cast(floor(({SRGB.format(v=LEVEL)}) * 255) as integer) as g from {P} where x % 4 = 0 and y % 4 = 0")
def srgb_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.grey_preview(pixels(spark, sf_dir))


@query(f"""with s as (select frame_index, cast(y // 4 as integer) as py, cast(x // 4 as integer) as px, {PHASE} as p, cast(floor(least(greatest(({SRGB.format(v="w")}) * 255, 0), 255)) as integer) as s
from (select *, {LEVEL} * case when {PHASE} in (0, 3) then 1.0::double when {PHASE} = 1 then 2.0::double else 1.5::double end as w from {P}) where x % 4 < 2 and y % 4 < 2)
select frame_index, py, px, max(s) filter (p = 1) as r, max(s) filter (p = 3) as g, max(s) filter (p = 2) as b from s group by 1, 2, 3""")
def debayer_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.debayer_preview(pixels(spark, sf_dir), GRBG, (2.0, 1.0, 1.5))


@query(f"select frame_index, cast((y - 2) * 2 + dy as integer) as y, cast((x - 1) * 2 + dx as integer) as x, v from {P}, range(2) a(dy), range(2) b(dx) where x >= 1 and x < 4 and y >= 2 and y < 5")
def magnifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.magnifier(pixels(spark, sf_dir), x0=1, y0=2, size=3, zoom=2)


@query(f"""select channel, col, "row", cast(least(count(*), 255) as integer) as n from (select {PHASE} as channel, cast(floor((x - x % 2) / 8::double * 4) as integer) as col, cast(floor(least(greatest({SRGB.format(v=LEVEL)}, 0), 1) * 31) as integer) as "row" from {P}) group by 1, 2, 3""")
def waveform_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.waveform_scope(pixels(spark, sf_dir), SIDE, columns=4, rows=32)


@query(f"select {PHASE} as channel, round(max({LEVEL} * case when {PHASE} in (0, 3) then 1.0::double when {PHASE} = 1 then 2.0::double else 1.5::double end), 9) as peak from {P} group by 1")
def scope_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.scope_peak(pixels(spark, sf_dir), GRBG, (2.0, 1.0, 1.5)).withColumn("peak", F.round("peak", 9))


# -- brackets, jobs, names --------------------------------------------------


@query(f"select cast((frame_index - 5) // 3 as bigint) as set_index, count(*) as shots, min(frame_index) as first from {S} where frame_index >= 5 group by 1 having count(*) = 3")
def bracket_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.brackets(sequence(spark, sf_dir), 3, 5).select("set_index", F.size("shot_indices").cast("long").alias("shots"), F.col("shot_indices")[0].alias("first"))


@query(f"select cast(frame_index // 4 as bigint) as set_index, min(frame_index) as first from {S} group by 1 having count(*) = 4")
def complete_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.brackets(sequence(spark, sf_dir), 4).select("set_index", F.col("shot_indices")[0].alias("first"))


@query(f"select name, cast(row_number() over (order by i % 13, i) - 1 as bigint) as frame_index from (select name, frame_index as i from {S})")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.indexed(sequence(spark, sf_dir).select("name")).select("name", "frame_index")


@query(f"select name, frame_index, cast(frame_index % 3 + 1 as bigint) as folder from {S}")
def split_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence(spark, sf_dir).withColumn("folder", F.pmod("frame_index", F.lit(3)) + 1)


_NAMES = "(select i, list(name order by frame_index) as names from (select frame_index // 2 as i, name, frame_index from {s}) group by 1 having count(*) = 2)"


@query(f"select cast(i % 3 + 1 as varchar) || '/take_' || lpad(cast(i // 3 as varchar), 6, '0') || '.dng' as output_name, array_to_string(names, ',') as original_filename from {_NAMES.format(s=S)}")
def serial_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.jobs(sequence(spark, sf_dir), 2, new_name="take", split=3).select("output_name", "original_filename")


@query(f"select cast((select count(*) from {S}) // 2 - 1 - i as bigint) as job_index, names[1] || '.dng' as output_name from {_NAMES.format(s=S)}")
def reverse_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brackets.jobs(sequence(spark, sf_dir), 2, reverse=True).select("job_index", "output_name")


@query(f"select name from {S} where frame_index % 7 <> 3")
def existing_output_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sequence(spark, sf_dir)
    return brackets.without_existing(frames, frames.where("frame_index % 7 = 3"), "name").select("name")


@query("select cast(frame_index as bigint) as frame_index, coalesce(case when frame_index % 5 <> 0 then name end, 'undefined file [index ' || cast(frame_index as varchar) || ']') as name from " + S)
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sequence(spark, sf_dir)
    return frames.select("frame_index", brackets.frame_name(F.when(F.col("frame_index") % 5 != 0, F.col("name")), "frame_index").alias("name"))


@query("select * from (values ('E', 1.0::double), ('e+2', 4.0::double), ('E*1,5', 1.5::double), ('E-3', 1.0::double), ('E/2', 1.0::double), ('X', null), ('', null), (' E+0.5 ', pow(2::double, 0.5::double))) t(slot, multiplier)")
def shot_dsl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = spark.createDataFrame([(s,) for s in ("E", "e+2", "E*1,5", "E-3", "E/2", "X", "", " E+0.5 ")], "slot string")
    return slots.select("slot", brackets.shot_multiplier("slot").alias("multiplier"))


# -- HDR --------------------------------------------------------------------


def _wide(n: int) -> str:
    return f"(select cast(frame_index // {n} as bigint) as set_index, y, x, " + ", ".join(f"max(v) filter (frame_index % {n} = {k}) as s{k}" for k in range(n)) + f" from {P} group by 1, 2, 3 having count(*) = {n})"


def _merge_sql(acc: str, v: str, eff: float, how: hdr.Merge) -> str:
    f = lambda x: f"cast({x!r} as float)"
    level = f"cast({v} / 65535::double as float)"
    scaled = f"({level} / {f(eff)})"
    out = scaled
    if how.width:
        weight = f"(({f(how.width)} - ({f(float(np.float32(how.clip)))} - {level})) / {f(how.width)})"
        out = f"case when {level} > {f(how.start)} then {weight} * {scaled} + ({f(1.0)} - {weight}) * cast({acc} / 65535::double as float) else {scaled} end"
    return f"case when {level} > {f(float(np.float32(how.clip)))} then {acc} else cast(least(greatest(round_even(cast(({out}) * {f(65535.0)} as double), 0), 0), 65535) as integer) end"


def _hdr(name: str, multipliers: list[float], how: hdr.Merge) -> None:
    n = len(multipliers)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hdr.bracket_pixels(pixels(spark, sf_dir), n).select("set_index", "y", "x", hdr.merged([f"s{k}" for k in range(n)], multipliers, how).alias("v"))

    run.__name__ = name
    scale, inner, acc = np.float32(1) / np.float32(multipliers[0]), _wide(n), "s0"
    for k in range(1, n):
        inner = f"(select *, {_merge_sql(acc, f's{k}', float(np.float32(multipliers[k]) * scale), how)} as a{k} from {inner})"
        acc = f"a{k}"
    query(f"select set_index, y, x, {acc} as v from {inner}")(run)


_hdr("hdr_merge_2shot", [1.0, 4.0], hdr.Merge())
_hdr("hdr_merge_3shot", [0.5, 2.0, 6.0], hdr.Merge(clip=0.6))
_hdr("hdr_merge_feather", [1.0, 3.0], hdr.Merge(clip=0.7, feather=0.5))
_hdr("hdr_merge_feather_falling", [1.0, 3.0], hdr.Merge(clip=0.7, feather=0.5, rising=False))
# weights that fall to 0 at the clipping point
ORACLE_SQL["hdr_merge_feather_falling"] = ORACLE_SQL["hdr_merge_feather"].replace("((cast(0.3499999940395355 as float) - (cast(0.699999988079071 as float) - cast(s1 / 65535::double as float))) / cast(0.3499999940395355 as float))", "((cast(0.699999988079071 as float) - cast(s1 / 65535::double as float)) / cast(0.3499999940395355 as float))")


@query(f"""with t as (select cast(frame_index // 3 as bigint) as set_index, y, x, cast(frame_index % 3 as integer) as shot, v from {P}),
r as (select *, lag(v) over (partition by set_index, y, x order by shot) as d from t)
select shot, round(avg(v / d::double), 6) as ratio, count(*) as n from r where d is not null and v / 65535::double <= 0.7 and v <> 0 and d <> 0 and v / 65535::double > 0.03125 and d / 65535::double > 0.03125 group by 1""")
def refine_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pixels(spark, sf_dir).selectExpr("frame_index div 3 as set_index", "y", "x", "cast(frame_index % 3 as int) as shot", "v")
    return hdr.exposure_ratios(rows, 3, 0.7, 5).withColumn("ratio", F.round("ratio", 6))


# -- codec, side channels, files --------------------------------------------


@query(f"""with g as (select v, coalesce(lag(v) over (partition by frame_index, y, x % 2 order by x), case when x < 2 then lag(v) over (partition by frame_index, x order by y) end, 32768) as g from {P})
select cast(case when v = g then 0 else floor(log2(abs(v - g))) + 1 end as integer) as category, count(*) as n from g group by 1""")
def jpeg_diff_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_counts(payloads(spark, sf_dir), "payload", SIDE)


@query("""select c_custkey, 'UNDEFINED,NOTE,"' || replace(d, '"', '""') || '","' || replace(c_name, '"', '""') || '",' || lower(hex(c_mktsegment)) as line from (select *, 'segment "' || c_mktsegment || '", damaged' as d from customer)""")
def error_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("d", F.concat(F.lit('segment "'), "c_mktsegment", F.lit('", damaged')))
    return rows.select("c_custkey", error_csv_row(F.lit("UNDEFINED"), F.lit("NOTE"), "d", "c_name", F.col("c_mktsegment").cast("binary")).alias("line"))


@query("""select -1::bigint as "order", 'frame,H,V' as value union all select event_id, cast(event_id as varchar) || ',' || cast(event_id % 9 as varchar) || ',' || cast(-(event_id % 7) as varchar) from events""")
def stabilisation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"), (F.col("event_id") % 9).cast("float").alias("h"), (-(F.col("event_id") % 7)).cast("float").alias("v"))
    return stabilisation_csv(rows)


@query("select vec_id as frame_index, true as same from embeddings")
def ljpeg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = payloads(spark, sf_dir).repartition("frame_index")
    return frames.withColumn("jpeg", encode_payload("payload", SIDE)).select("frame_index", (decode_payload("jpeg") == F.col("payload")).alias("same"))


@query("select vec_id as frame_index, 8 as width, 8 as height, true as same from embeddings")
def dng_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to DNG files of tiled lossless JPEG and back."""
    files = as_dng(dng_frames(spark, sf_dir), Output("bright16", tile=16))

    def read(batches):
        for batch in batches:
            back = [tiff.linear(tiff.Tiff(bytes(b))) for b in batch.content]
            yield pd.DataFrame({"frame_index": batch.output_name.astype("int64"), "width": [v.shape[1] for v in back], "height": [v.shape[0] for v in back], "back": [v.astype("<u2").tobytes() for v in back]})

    back = files.mapInPandas(read, "frame_index long, width int, height int, back binary")
    return back.join(payloads(spark, sf_dir), "frame_index").select("frame_index", "width", "height", (F.col("back") == F.col("payload")).alias("same"))


def dng_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.expr("cast(array() as array<struct<format:int,data:binary,text:string,filename:string>>)")
    return payloads(spark, sf_dir).repartition("frame_index").select(F.col("frame_index").cast("string").alias("output_name"), F.lit("").alias("original_filename"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.array(*map(F.lit, RGGB)).alias("cfa"), "payload", none.alias("meta"), F.expr("cast(array() as array<struct<code:string,severity:string,description:string,filename:string,data:binary>>)").alias("errors"))


@query("select vec_id as frame_index, 16 as bits, 1 as compression, 32803 as photometric, 4.0::double as exposure, '00010102' as cfa, vec_id || '.raw' as original from embeddings")
def dng_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tags of written files say, read back."""
    frames = dng_frames(spark, sf_dir).withColumn("original_filename", F.concat("output_name", F.lit(".raw")))

    def read(batches):
        for batch in batches:
            for name, b in zip(batch.output_name, batch.content):
                d = tiff.Tiff(bytes(b)).first
                yield pd.DataFrame([{"frame_index": int(name), "bits": d[tiff.BITS][0], "compression": d[tiff.COMPRESSION][0], "photometric": d[tiff.PHOTOMETRIC][0], "exposure": d[tiff.BASELINE_EXPOSURE][0], "cfa": bytes(d[tiff.CFA]).hex(), "original": d[tiff.ORIGINAL_NAME][0]}])

    return as_dng(frames, Output("dark16", encoding="strip")).mapInPandas(read, "frame_index long, bits int, compression int, photometric int, exposure double, cfa string, original string")


@query()
def output_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each frame in each output format: what a sweep over formats compares."""
    from ..sinks.files import FORMATS

    def run(batches):
        for batch in batches:
            for i, b in zip(batch.frame_index, batch.payload):
                v = np.frombuffer(b, "<u2").reshape(SIDE, SIDE)
                yield pd.DataFrame({"frame_index": i, "format": FORMATS, "bytes": [len(tiff.dng(image(v, RGGB, Output(f, tile=16)))) for f in FORMATS]})

    return payloads(spark, sf_dir).repartition("frame_index").mapInPandas(run, "frame_index long, format string, bytes long").groupBy("format").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("frames"))


@query()
def tile_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded bytes of all frames by tile size, and the size that takes least."""
    sizes = (2, 4, 6, 8, 16)

    def run(batches):
        for batch in batches:
            frames = [np.frombuffer(b, "<u2").reshape(SIDE, SIDE) for b in batch.payload]
            yield pd.DataFrame({"tile": sizes, "bytes": [sum(len(encode_frame(t)) for v in frames for _, _, t in tiled(v, s)) for s in sizes]})

    rows = payloads(spark, sf_dir).repartition("frame_index").mapInPandas(run, "tile int, bytes long").groupBy("tile").agg(F.sum("bytes").alias("bytes"))
    return rows.withColumn("best", rows.agg(F.min_by("tile", "bytes")).scalar())


@query(f"select name, cast(row_number() over (order by frame_index desc) - 1 as bigint) as place from {S}")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(sequence(spark, sf_dir), [F.desc("frame_index")], "place").select("name", "place")


from . import file_queries  # noqa: E402, F401  it adds its queries to those above
