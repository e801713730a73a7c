"""Relational tables as frames, so that operators can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding of 64 values in -1 to 1 as an 8 by 8 frame of 16-bit samples: frame_index, y, x, v."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_index"), F.posexplode("embedding").alias("pos", "e"))
    v = F.least(F.greatest(F.bround((F.col("e").cast("double") + 1) / 2 * 65535), F.lit(0.0)), F.lit(65535.0)).cast("int")
    return rows.select("frame_index", F.expr(f"cast(pos div {SIDE} as int)").alias("y"), (F.col("pos") % SIDE).alias("x"), v.alias("v"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sequence of frames: frame_index, name. Names have runs of digits with and without leading zeros."""
    i = F.col("event_id")
    name = F.concat(F.lit("s"), (i % 13).cast("string"), F.lit("f"), F.repeat(F.lit("0"), (i % 3).cast("int")), i.cast("string"))
    return table(spark, sf_dir, "events").select(i.alias("frame_index"), name.alias("name"))


def packed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes b0 to b4 of each order's keys."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    byte = lambda x: (x % 256).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", byte(o).alias("b0"), byte(F.expr("o_orderkey div 256")).alias("b1"), byte(c).alias("b2"), byte(F.expr("o_custkey div 256")).alias("b3"), byte(o + c).alias("b4"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of `pixels` as payloads: frame_index, payload."""
    v = F.transform("embedding", lambda e: F.least(F.greatest(F.bround((e.cast("double") + 1) / 2 * 65535), F.lit(0.0)), F.lit(65535.0)).cast("int"))
    text = F.array_join(F.transform(v, lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.shiftright(x, 8)), 2, "0"))), "")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_index"), F.unhex(text).alias("payload"))
