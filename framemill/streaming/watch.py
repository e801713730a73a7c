"""Folders that frames are still arriving in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import linear

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watched(spark: SparkSession, path: str, kind: str = "bright16", pattern: str = "*.raw", per_trigger: int = 64) -> DataFrame:
    """name, modified, payload (linear) of raw frames as they come."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.col("path").alias("name"), F.col("modificationTime").alias("modified"), linear("content", kind).alias("payload"))


def arrivals(frames: DataFrame, window: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Frames and bytes by time of arrival."""
    return frames.withWatermark("modified", late).groupBy(F.window("modified", window)).agg(F.count("*").alias("frames"), F.sum(F.octet_length("payload")).alias("bytes"))
