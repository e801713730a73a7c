"""Sinks: DNG files, one for each row, and text reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..functions.scalars import float_text
from ..operators.dither import diffused
from ..operators.sidechannel import CSV_HEADER, error_csv_row, metadata_blob
from ..sources.tiff import Image, dng

#: Output formats: (bits before the curve, bits after it, curve).
LINLOG = {"linlog10": (16, 10), "linlog8": (16, 8), "linlog7": (16, 7), "dark_linlog8": (12, 8), "dark_linlog7": (12, 7), "dark_linlog6": (12, 6), "dark_linlog5": (12, 5)}
REPORT = ".errors.csv"
FORMATS = ("dark16", "bright16", "packed12", "gamma10", *LINLOG)


@dataclass(frozen=True)
class Output:
    """How frames are written. encoding: strip, deflate, ljpeg or ljpeg_tiles; packed12 is always a strip."""

    format: str = "dark16"
    encoding: str = "ljpeg_tiles"
    tile: int = 192
    gains: tuple[float, float, float] = (1.0, 1.0, 1.0)
    dither: bool = True
    make: str = ""
    model: str = ""
    camera: str = "framemill"
    software: str = ""
    crop: tuple[int, int, int, int] = (0, 0, 0, 0)  # left, top, right, bottom


def image(frame: np.ndarray, cfa: tuple[int, ...], out: Output, original: str = "", private: bytes = b"") -> Image:
    """Crop, reduce and tag a high-aligned linear frame."""
    left, top, right, bottom = (n - n % 2 for n in out.crop)
    frame = frame[top : frame.shape[0] - bottom, left : frame.shape[1] - right]
    exposure, table = (4.0 if out.format.startswith("dark") else None), None
    if out.format in LINLOG:
        bits_in, bits_out = LINLOG[out.format]
        a = curves.linlog_parameter(bits_in, bits_out)
        v = frame >> np.uint16(4) if bits_in == 12 else frame
        v = diffused(v, a, cfa) if out.dither else curves.linlog_reduce_array(v, a)
        table = curves.linlog_table_array(bits_in, bits_out)
    elif out.format == "gamma10":
        v, table = curves.gamma_reduce_array(frame), curves.gamma_table_array()
    elif out.format == "dark16":
        v = frame >> np.uint16(4)
    elif out.format in ("bright16", "packed12"):
        v = frame
    else:
        raise ValueError(f"unknown output format {out.format!r}; known: {', '.join(FORMATS)}")
    return Image(np.ascontiguousarray(v), cfa, out.encoding, out.format == "packed12", out.tile, out.gains, out.make, out.model, out.camera, out.software, original, exposure, table, private)


def dng_files(r, out: Output, reports: bool = False) -> list[tuple[str, bytes]]:
    """(name, content) of a frame's DNG file, if it has a payload, and with reports of its error report, if it has errors."""
    files, errors = [], list(r.errors) if r.errors is not None else []
    if r.payload is not None:
        v = np.frombuffer(r.payload, "<u2").reshape(r.height, r.width)
        private = metadata_blob(list(r.meta) if r.meta is not None else [], errors)
        files.append((r.output_name, dng(image(v, tuple(r.cfa), out, r.original_filename or "", private))))
    if reports and errors:
        files.append((r.output_name + REPORT, error_csv(errors)))
    return files


def as_dng(frames: DataFrame, out: Output = Output(), reports: bool = False) -> DataFrame:
    """output_name, content: a DNG file of each frame, and with reports <output_name>.errors.csv of each frame that has errors. frames: output_name, original_filename, width, height, cfa, payload (linear), meta, errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for name, content in dng_files(r, out, reports):
                    yield pd.DataFrame({"output_name": [name], "content": [content]})

    return frames.mapInPandas(run, "output_name string, content binary")


class Folder:
    """Writes whole files under their names; a lost task leaves none half written."""

    def __init__(self, folder: str, mode: str):
        if mode not in ("errorifexists", "ignore", "overwrite"):
            raise ValueError(f"unknown mode {mode!r}")
        self.where, self.top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.mode = mode

    def _holds(self, path: str, content: bytes) -> bool | None:
        """Whether a file is there and is this one; None if none is there."""
        there = self.where.get_file_info(path)
        if there.type == fs.FileType.NotFound:
            return None
        if there.size != len(content):
            return False
        with self.where.open_input_stream(path) as f:
            return f.read() == content

    def write(self, name: str, content: bytes) -> tuple[str, int, bool]:
        """output_name, bytes, written. An error report whose name is taken by another one gets the next free number."""
        if name.endswith(REPORT):
            stem, k = name.removesuffix(".csv"), 1
            while self._holds(f"{self.top}/{name}", content) is False:
                k += 1
                name = f"{stem}.{k}.csv"
        path = f"{self.top}/{name}"
        if self.mode != "overwrite":
            same = self._holds(path, content)
            if same is False and self.mode == "errorifexists" and not name.endswith(REPORT):
                raise FileExistsError(name)
            if same is not None:
                return name, len(content), same and self.mode == "errorifexists"
        self.where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with self.where.open_output_stream(part) as f:
            f.write(content)
        self.where.move(part, path)
        return name, len(content), True


def write_files(files: DataFrame, folder: str, mode: str = "errorifexists") -> DataFrame:
    """Write each row's content under its output_name; returns output_name, bytes, written. Files get their names only when they are whole, so a lost task leaves none half written.

    mode: errorifexists fails at a file that is there and doesn't come from this call, ignore leaves it, overwrite replaces it. Error reports never fail: they are numbered.
    """
    Folder(folder, mode)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = Folder(folder, mode)
        for batch in batches:
            yield pd.DataFrame([to.write(r.output_name, bytes(r.content)) for r in batch.itertuples()], columns=["output_name", "bytes", "written"])

    return files.mapInPandas(run, "output_name string, bytes long, written boolean")


def error_csv(errors: list[dict]) -> bytes:
    """A report of some errors: the lines of sidechannel.error_csv_row, sorted, under a header."""
    quote = lambda t: '"' + (t or "").replace('"', '""') + '"'
    lines = sorted(f"{e['code']},{e['severity']},{quote(e['description'])},{quote(e['filename'])},{bytes(e['data'] or b'').hex()}" for e in errors)
    return "".join(f"{x}\n" for x in (CSV_HEADER, *lines)).encode()


def error_reports(errors: DataFrame) -> DataFrame:
    """output_name, content: <output>.errors.csv of each output that has errors. errors: output_name, code, severity, description, filename, data."""
    line = error_csv_row("code", "severity", "description", "filename", "data")
    rows = errors.groupBy("output_name").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    return rows.select(F.concat("output_name", F.lit(".errors.csv")).alias("output_name"), F.concat(F.lit(CSV_HEADER + "\n"), "lines", F.lit("\n")).cast("binary").alias("content"))


def stabilisation_csv(offsets: DataFrame) -> DataFrame:
    """Lines of a CSV file: `order` and `value`."""
    rows = offsets.select(F.col("frame_index").alias("order"), F.concat_ws(",", F.col("frame_index").cast("string"), float_text("h"), float_text("v")).alias("value"))
    return offsets.sparkSession.createDataFrame([(-1, "frame,H,V")], "order long, value string").union(rows)


def keyframes(offsets: DataFrame, width: int, height: int, rate: int = 24) -> DataFrame:
    """Lines of a keyframe text: header, a tab row for each frame, footer; `order` and `value`."""
    # fixed values: the text format of keyframes
    head = ["Adobe After Effects 8.0 Keyframe Data", "", f"\tUnits Per Second\t{rate}", f"\tSource Width\t{width}", f"\tSource Height\t{height}", "\tSource Pixel Aspect Ratio\t1", "\tComp Pixel Aspect Ratio\t1", "", "Effects\tPoint Control\tPoint", "\tFrame\tX pixels\tY pixels\t"]
    foot = ["", "", "End of Keyframe Data"]
    fixed = [(k - len(head), s) for k, s in enumerate(head)] + [((1 << 62) + k, s) for k, s in enumerate(foot)]
    rows = offsets.select(F.col("frame_index").alias("order"), F.concat(F.lit("\t"), F.col("frame_index").cast("string"), F.lit("\t"), float_text("h"), F.lit("\t"), float_text("v"), F.lit("\t")).alias("value"))
    return offsets.sparkSession.createDataFrame(fixed, "order long, value string").union(rows)


def write_lines(lines: DataFrame, path: str) -> None:
    """A text report as part files, in order from file to file and within each: range-partitioned, so that no task sees all lines."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, "order").sortWithinPartitions("order").select("value").write.mode("errorifexists").text(path)
