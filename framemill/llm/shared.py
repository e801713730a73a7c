"""What the operators of this subpackage share: the shared folder, byte-bounded slabs of texts, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator holds as Python or numpy objects at a time (one longer text is a slab of its own).
SLAB_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only on one machine (a local master) may that be unset, for a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="framemill-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/framemill-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write df as Parquet below the shared folder and read it again. Lost executors cost nothing that is written."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, path: str) -> DataFrame:
    """df, written first if it comes out of a shuffle: rows then come in one order, whenever a lost task is run again."""
    return written(df, path) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def hot_joined(left: DataFrame, right: DataFrame, key: str, count: str, rows: int, spread: list[str], share: int = 2000) -> DataFrame:
    """left.join(right, key, "left") without a hot task. right: one row for each key, `count` being how many of left's `rows` have it (an upper bound will do).

    Keys with more than 1/share of all rows, fewer than `share` of them, are broadcast, and their rows dealt by the columns `spread` instead; the rest are joined by key.
    """
    more = [c for c in right.columns if c != key]
    limit = F.col(count) > max(1, rows // share)
    hot = right.where(limit).select(F.col(key), F.struct(*more).alias("#hot"))
    salt = F.when(F.col("#hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread).bitwiseOR(F.lit(1).cast("long")))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("#salt", salt)
    cold = right.where(~limit).select(F.col(key), F.lit(0).cast("long").alias("#salt"), F.struct(*more).alias("#cold"))
    both = dealt.join(cold, [key, "#salt"], "left")
    return both.select(*left.columns, *[F.coalesce(F.col("#hot"), F.col("#cold"))[c].alias(c) for c in more])


def slabs(column: pa.Array, most: int = SLAB_BYTES, rows: int = 65535) -> Iterator[tuple[int, int]]:
    """(from, to) row ranges of at most `most` bytes of text and `rows` rows, but of one row at least."""
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())))
    at, n = 0, len(ends)
    while at < n:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, "right"))))
        yield at, to
        at = to


def text_slabs(batches: Iterator[pa.RecordBatch], most: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """Slabs of batches whose column 1 is the text; null texts become empty ones."""
    for batch in batches:
        text = pc.fill_null(batch.column(1), "")
        for a, b in slabs(text, most):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), text.slice(a, b - a), *(c.slice(a, b - a) for c in batch.columns[2:])], names=batch.schema.names)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and len+1 offsets into them, without a copy."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that the text operators read, under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def per_slab(f: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = SLAB_BYTES) -> Callable:
    """A function for mapInArrow that applies f to slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in text_slabs(batches, most):
            yield f(slab)

    return run
