"""Folders of frame files as DataFrames.

Files are listed and read by Spark's binaryFile source, so they may be in any store that Spark reads. Listing and numbering read no contents; payloads are decoded where they are read, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.brackets import indexed
from ..operators.sidechannel import CRI_CHUNK, ERROR, META
from . import cri, tiff

FRAMES = f"frame_index long, name string, width int, height int, cfa array<int>, format string, payload binary, meta array<{META}>, errors array<{ERROR}>"


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """frame_index, name, length of the files of a folder, in natural order of names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("name"), "length")
    return indexed(files)


def _contents(spark: SparkSession, path: str, pattern: str, only: DataFrame | None = None) -> DataFrame:
    """frame_index, name, content. Frames are numbered by name alone. With `only` (frame_index), names that aren't asked for are left out before contents are read: each task opens the files that its names say.

    Without it the contents are read by Spark, and the numbering is joined by name; it is broadcast only if Spark finds it small. Use `only`, or plans.convert.convert_folder, where contents mustn't be shuffled.
    """
    numbers = listing(spark, path, pattern).select("frame_index", "name")
    if only is not None:
        return opened(numbers.join(only.select("frame_index").distinct(), "frame_index", "left_semi"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("name"), "content")
    return files.join(numbers, "name").select("frame_index", "name", "content")


def file_of(name: str) -> tuple[fs.FileSystem, str]:
    """Where a name of Spark's file listing lies."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", name)))


def content_of(name: str) -> bytes:
    where, path = file_of(name)
    with where.open_input_stream(path) as f:
        return f.read()


def opened(names: DataFrame) -> DataFrame:
    """frame_index, name, content: the files of some names, opened where the names are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame([(r.frame_index, r.name, content_of(r.name))], columns=["frame_index", "name", "content"])

    return names.mapInPandas(run, "frame_index long, name string, content binary")


def _decoded(df: DataFrame, one) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield pd.DataFrame([{"frame_index": r.frame_index, "name": r.name} | one(bytes(r.content), r.name)])

    return df.mapInPandas(run, FRAMES)


def _broken(name: str, e: Exception, **known) -> dict:
    error = {"code": "ORIGINAL_FILE_CORRUPTED", "severity": "CRITICAL", "description": str(e), "filename": name, "data": b""}
    return {"width": 0, "height": 0, "cfa": [], "format": "invalid", "payload": None, "meta": [], "errors": [error]} | known


# what a file's bytes say: width, height, cfa, format, payload (high-aligned, linear), meta, errors; damage is an error, not a failure


def raw_frame(width: int, height: int, cfa: tuple[int, ...], kind: str = "bright16", linear: bool = True) -> Callable[[bytes, str], dict]:
    def one(b: bytes, name: str) -> dict:
        known = {"width": width, "height": height, "cfa": list(cfa), "format": "bright16" if linear else kind}
        try:
            payload = tiff.unpacked(b, kind, width, height).astype("<u2").tobytes() if linear else b
        except ValueError as e:
            return _broken(name, e, **known)
        return known | {"payload": payload, "meta": [], "errors": []}

    return one


def dng_frame(b: bytes, name: str) -> dict:
    try:
        t = tiff.Tiff(b)
        h = tiff.header(t)
        v = tiff.linear(t)
    except (ValueError, KeyError, IndexError) as e:
        return _broken(name, e)
    return {"width": h.width, "height": h.height, "cfa": list(h.cfa), "format": h.format if h.format == "invalid" else "bright16", "payload": v.astype("<u2").tobytes(), "meta": [], "errors": []}


def cri_frame(b: bytes, name: str) -> dict:
    try:
        v, errors, values = cri.frame(b, name)
        _, _, cfa, kind = cri.info(dict(values))
    except (ValueError, KeyError) as e:
        return _broken(name, e)
    chunk = {"format": CRI_CHUNK, "data": cri.serialised(values), "text": cri.text(values), "filename": name}
    return {"width": v.shape[1], "height": v.shape[0], "cfa": list(cfa), "format": "bright16" if kind != "invalid" else kind, "payload": v.astype("<u2").tobytes(), "meta": [chunk], "errors": errors}


def read_raw(spark: SparkSession, path: str, width: int, height: int, cfa: tuple[int, ...], kind: str = "bright16", pattern: str = "*.raw", linear: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Headerless frames: what they are is said by the caller. With linear, payloads become high-aligned samples. A payload that doesn't fit gives an error row, not a failure."""
    return _decoded(_contents(spark, path, pattern, only), raw_frame(width, height, cfa, kind, linear))


def read_dng(spark: SparkSession, path: str, pattern: str = "*.dng", only: DataFrame | None = None) -> DataFrame:
    """DNG files, stripped or tiled, uncompressed, deflated or lossless JPEG, as high-aligned linear samples."""
    return _decoded(_contents(spark, path, pattern, only), dng_frame)


def read_cri(spark: SparkSession, path: str, pattern: str = "*.cri", only: DataFrame | None = None) -> DataFrame:
    """Film-scan files as high-aligned samples, with their tags as a metadata chunk and damages as errors."""
    return _decoded(_contents(spark, path, pattern, only), cri_frame)


def read_cri_tags(spark: SparkSession, path: str, pattern: str = "*.cri") -> DataFrame:
    """frame_index, name, tags: a map from tag to bytes, without frame data and filler, which are stepped over unread. Files whose tags are damaged have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch.name:
                where, file = file_of(name)
                with where.open_input_file(file) as f:
                    try:
                        found.append(dict(cri.tags_of(f.read_at, f.size(), (cri.FRAME_DATA, cri.FILLER))))
                    except ValueError:
                        found.append({})
            yield pd.DataFrame({"frame_index": batch.frame_index, "name": batch.name, "tags": found})

    return listing(spark, path, pattern).mapInPandas(run, "frame_index long, name string, tags map<long,binary>")


def read_stabilisation(spark: SparkSession, path: str, pattern: str = "*.cri") -> DataFrame:
    """frame_index, h, v: the offsets of film-scan files. Only the tags' headers are read, so frame data stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for name in batch.name:
                where, file = file_of(name)
                with where.open_input_file(file) as f:
                    found.append(cri.offsets(f.read_at, f.size()))
            yield pd.DataFrame({"frame_index": batch.frame_index, "h": [x for x, _ in found], "v": [x for _, x in found]})

    return listing(spark, path, pattern).mapInPandas(run, "frame_index long, h float, v float")
