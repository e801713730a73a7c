"""Consecutive numbers in a global order, without one task that sees all rows."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only on one machine (a local master) may that be unset, for a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="framemill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/framemill-{uuid.uuid4().hex}"


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number from 0 in the given order: rows are range-partitioned and written with their place in their partition; the partitions' counts, as many as there are partitions, give each its first number."""
    spark = df.sparkSession
    path = shared_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("#", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("#part", F.shiftright("#", 33).cast("int"))
    counts = sorted((r[0], r[1]) for r in rows.groupBy("#part").count().collect())
    before = [0, *itertools.accumulate(k for _, k in counts)]
    offsets = spark.createDataFrame([(p, n) for (p, _), n in zip(counts, before)], "`#part` int, `#first` long")
    out = rows.join(F.broadcast(offsets), "#part").withColumn(name, F.col("#first") + F.col("#").bitwiseAND((1 << 33) - 1))
    return out.drop("#", "#part", "#first")
