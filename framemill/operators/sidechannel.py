"""Errors and metadata that travel beside frames: array columns, tables, blobs and CSV rows."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numbers of codes and severities in blobs.
CODES = {"UNDEFINED": 0, "ORIGINAL_FILE_CORRUPTED": 1, "ORIGINAL_FILE_PARTIALLY_CORRUPTED_RESCUE": 2}
SEVERITIES = {"UNDEFINED": 0, "NOTE": 1, "WARNING": 2, "SEVERE": 3, "CRITICAL": 4}
#: Kinds of metadata chunks.
ERRORS_CHUNK, CRI_CHUNK = 1, 2
ERROR = "struct<code:string,severity:string,description:string,filename:string,data:binary>"
META = "struct<format:int,data:binary,text:string,filename:string>"
MAGIC = b"FRAMEMILL\0"
#: Fixed value: the first line of an error report.
CSV_HEADER = 'ErrorCode,Severity,"Error Description","Original Filename","Binary Data"'


def _field(b: bytes) -> bytes:
    return struct.pack("<I", len(b)) + b


def error_blob(errors: list[dict]) -> bytes:
    """Count, then for each error its code, severity and three fields with their lengths."""
    return struct.pack("<I", len(errors)) + b"".join(struct.pack("<II", CODES.get(e["code"], 0), SEVERITIES.get(e["severity"], 0)) + _field(bytes(e["data"] or b"")) + _field((e["description"] or "").encode()) + _field((e["filename"] or "").encode()) for e in errors)


def metadata_blob(chunks: list[dict], errors: list[dict] = ()) -> bytes:
    """MAGIC, count, then each chunk's format and three fields; errors are the last chunk."""
    chunks = [*chunks, {"format": ERRORS_CHUNK, "data": error_blob(list(errors)), "text": "", "filename": ""}]
    return MAGIC + struct.pack("<I", len(chunks)) + b"".join(struct.pack("<I", c["format"]) + _field(bytes(c["data"] or b"")) + _field((c["text"] or "").encode()) + _field((c["filename"] or "").encode()) for c in chunks)


def read_metadata_blob(b: bytes) -> list[dict]:
    if not b.startswith(MAGIC):
        raise ValueError("not a metadata blob")
    at = len(MAGIC)
    (n,) = struct.unpack_from("<I", b, at)
    at += 4
    out = []
    for _ in range(n):
        (kind,) = struct.unpack_from("<I", b, at)
        at += 4
        fields = []
        for _ in range(3):
            (size,) = struct.unpack_from("<I", b, at)
            fields.append(b[at + 4 : at + 4 + size])
            at += 4 + size
        out.append({"format": kind, "data": fields[0], "text": fields[1].decode(), "filename": fields[2].decode()})
    return out


def metadata_column(meta: Column | str, errors: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(m: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([metadata_blob(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(m, e)])

    return run(meta, errors)


def error_column(errors: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(e: pd.Series) -> pd.Series:
        return e.map(lambda a: error_blob(list(a) if a is not None else []))

    return run(errors)


def exploded_errors(frames: DataFrame, *keys: str) -> DataFrame:
    """A row for each error of an array column `errors`."""
    return frames.select(*keys, F.explode("errors").alias("e")).select(*keys, "e.*")


def quoted(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))


def error_csv_row(code: Column | str, severity: Column | str, description: Column | str, filename: Column | str, data: Column | str) -> Column:
    """One line; only the description and the file name are quoted, bytes are hex."""
    c = [F.col(x) if isinstance(x, str) else x for x in (code, severity, data)]
    return F.concat_ws(",", c[0].cast("string"), c[1].cast("string"), quoted(description), quoted(filename), F.lower(F.hex(c[2])))


def merged_lists(df: DataFrame, *keys: str) -> DataFrame:
    """The meta and errors arrays of several rows, end to end, for each key: those of a set's shots, which are few."""
    return df.groupBy(*keys).agg(F.flatten(F.collect_list("meta")).alias("meta"), F.flatten(F.collect_list("errors")).alias("errors"))
