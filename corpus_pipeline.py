"""A training corpus from raw documents, in five stages: toxic documents go, near copies go, documents with benchmark passages go, secrets are blacked out, and what is left is encoded.

Every stage works on all rows that its predecessor kept. Stages one to four return the columns of documents; the last returns what a trainer reads. Nulls: a null text scores and passes as an empty one; rows with null ids are kept like others. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.llm.bpe import encoded
from framemill.llm.decontaminate import decontaminated
from framemill.llm.jaccard_join import one_of_each
from framemill.llm.secret_scan import redact
from framemill.llm.shared import shared_dir, written
from framemill.llm.toxicity import fit, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The network learns from the labelled rows of docs that aren't held out."""
    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-gram similarity of 0.8 or more, directly or through others, that of the least id stays."""
    return one_of_each(docs, similarity=0.8, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def black_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [secret], and n_chars follows the text; no document goes."""
    out = redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian uint32), ids_sha256 and decoded_sha256."""
    out = encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("secret scans", black_out_secrets), ("byte-level BPE", encode)]

#: SQL can't express a trained network or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"{top}/stage{i}")
    return docs
