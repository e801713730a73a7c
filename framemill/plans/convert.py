"""Batch conversion: a folder of frames to DNG files.

Jobs are planned from names alone. `convert_folder` then sends each job's names to one task, which opens, decodes, merges, crops, reduces, encodes and writes job by job: payloads are never shuffled, and a task holds one job. `convert` does the same with frames that are a DataFrame already, whose payloads meet by job in one shuffle if there are brackets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.brackets import Shot, jobs
from ..operators.hdr import Merge, merged_arrays, ratio_sums, refined
from ..operators.sidechannel import ERROR, META
from ..sinks.files import Folder, Output, as_dng, dng_files, write_files
from ..sources.folders import content_of, listing

MERGED = f"output_name string, original_filename string, width int, height int, cfa array<int>, payload binary, meta array<{META}>, errors array<{ERROR}>"
Decoder = Callable[[bytes, str], dict]


def _merged(output: str, original: str, shots: list[dict], multipliers: list[float], how: Merge) -> dict:
    """One frame of a job's shots, which come in the order of their multipliers' slots; without a payload if a shot has none."""
    first = shots[0]
    if len(shots) == 1:
        payload = first["payload"]
    elif all(s["payload"] is not None and len(s["payload"]) == len(first["payload"]) for s in shots):
        payload = merged_arrays([np.frombuffer(s["payload"], "<u2") for s in shots], multipliers, how).astype("<u2").tobytes()
    else:
        payload = None
    return {"output_name": output, "original_filename": original, "width": first["width"], "height": first["height"], "cfa": list(first["cfa"]), "payload": payload, "meta": [m for s in shots for m in s["meta"]], "errors": [e for s in shots for e in s["errors"]]}


def merged_sets(frames: DataFrame, planned: DataFrame, shots: list[Shot], how: Merge = Merge()) -> DataFrame:
    """A frame for each job: its only shot, or the merge of its bracket."""
    wanted = planned.select("output_name", "original_filename", F.posexplode("shot_indices").alias("k", "frame_index"))
    rows = frames.join(wanted, "frame_index").select("output_name", "original_filename", "k", "width", "height", "cfa", "payload", "meta", "errors")
    if len(shots) == 1:
        return rows.drop("k")
    order = _multipliers(shots)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("k").to_dict("records")
        return pd.DataFrame([_merged(rows[0]["output_name"], rows[0]["original_filename"], rows, [order[r["k"]] for r in rows], how)])

    return rows.groupBy("output_name").applyInPandas(merge, MERGED)


def _multipliers(shots: list[Shot]) -> list[float]:
    """By place in a set."""
    return [s.multiplier for s in sorted(shots, key=lambda s: s.order_index)]


def convert(frames: DataFrame, folder: str, shots: list[Shot], out: Output = Output(), how: Merge = Merge(), mode: str = "errorifexists", reports: bool = True, **plan) -> DataFrame:
    """Write a DNG file for each job of frames (frame_index, name, width, height, cfa, payload, meta, errors), and with reports <output>.errors.csv for each job with errors; returns what was written. Nothing is written before an action runs the result. plan: what brackets.jobs takes."""
    planned = jobs(frames.select("frame_index", "name"), len(shots), **plan)
    return write_files(as_dng(merged_sets(frames, planned, shots, how), out, reports), folder, mode)


def _opened(planned: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run over jobs, dealt evenly by their number: what is shuffled is names."""
    n = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return planned.repartition(n, "job_index").mapInPandas(run, schema)


def convert_folder(spark: SparkSession, path: str, pattern: str, decode: Decoder, folder: str, shots: list[Shot], out: Output = Output(), how: Merge = Merge(), mode: str = "errorifexists", reports: bool = True, **plan) -> DataFrame:
    """The same for the files of a folder. decode: raw_frame(...), dng_frame or cri_frame of sources.folders."""
    planned, order = jobs(listing(spark, path, pattern).select("frame_index", "name"), len(shots), **plan), _multipliers(shots)
    Folder(folder, mode)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = Folder(folder, mode)
        for batch in batches:
            done = []
            for r in batch.itertuples():
                frame = _merged(r.output_name, r.original_filename, [decode(content_of(n), n) for n in r.names], order, how)
                done += [to.write(*file) for file in dng_files(SimpleNamespace(**frame), out, reports)]
            yield pd.DataFrame(done, columns=["output_name", "bytes", "written"])

    return _opened(planned, run, "output_name string, bytes long, written boolean")


def refine_folder(spark: SparkSession, path: str, pattern: str, decode: Decoder, shots: list[Shot], clip: float = 0.7, bits: int = 5, compat: bool = True, **plan) -> list[Shot]:
    """The shots with multipliers measured over all complete sets of a folder: each shot's mean ratio to the next darker one, chained (see hdr.refined). A shot without a ratio gets NaN."""
    planned, order = jobs(listing(spark, path, pattern).select("frame_index", "name"), len(shots), **plan), [s.order_index for s in shots]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                frames = [decode(content_of(n), n)["payload"] for n in r.names]
                if all(f is not None and len(f) == len(frames[0]) for f in frames):
                    yield pd.DataFrame(ratio_sums([np.frombuffer(frames[i], "<u2") for i in order], clip, bits), columns=["shot", "total", "n"])

    sums = _opened(planned, run, "shot int, total double, n long").groupBy("shot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    found = refined({r.shot: r.total / r.n for r in sums if r.n}, [s.multiplier for s in shots], compat)
    return [Shot(s.order_index, m) for s, m in zip(shots, found)]
