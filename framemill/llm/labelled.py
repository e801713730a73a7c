"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

#: Rows that a classifier is fitted on at most: those whose ids have the least hashes. Scores are given to all rows.
ROWS = 6000


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id as text, mod `mod`; of a null id as of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col, F.lit("")).cast("binary")), F.lit(mod))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = ROWS, parts: int = 12) -> DataFrame:
    """doc_id, order (a hash of it), text and y (0 or 1) of the `rows` labelled documents with the least hashes of ids for which `learn` holds, in `parts` partitions of a table in the shared folder. Texts are whole.

    Null labels and ids and labels without a document aren't learned from; null texts count as empty. Of several labels of an id the largest counts, of several texts that of the least hash. Ids alone are joined and ranked; the `rows` chosen ones are broadcast to the texts.
    """
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    there = docs.select("doc_id").distinct()
    some = some.join(there, "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(some), "doc_id")
    one = found.groupBy("doc_id", "order", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return written(one.repartition(parts, "order"), f"{shared_dir(docs.sparkSession)}/labelled")


def fetched(df: DataFrame) -> pa.Table:
    return df.toArrow()
