"""The data source `bayer_dng` for writing: df.write.format("bayer_dng").options(...).mode("append").save(folder).

Rows need output_name, width, height, cfa and payload (linear); original_filename is used if it is there. Tasks write whole files under temporary names and rename them, so the driver has nothing to do per file. options: format, encoding, tile, ifExists (error, skip or replace): with error a file that is there and isn't the same fails the job; files that other tasks have written by then stay, and writing again accepts them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources.tiff import dng
from .files import Folder, Output, image


@dataclass
class Written(WriterCommitMessage):
    files: int = 0


class DngWriter(DataSourceWriter):
    def __init__(self, options: dict):
        path = options["path"]
        self.folder = path if "://" in path else f"file://{path}"
        self.out = Output(options.get("format", "dark16"), options.get("encoding", "ljpeg_tiles"), int(options.get("tile", 192)))
        self.mode = {"error": "errorifexists", "skip": "ignore", "replace": "overwrite"}[options.get("ifexists", options.get("ifExists", "error"))]

    def write(self, rows) -> Written:
        to, done = Folder(self.folder, self.mode), Written()
        for r in rows:
            v = np.frombuffer(bytes(r["payload"]), "<u2").reshape(r["height"], r["width"])
            original = r["original_filename"] if "original_filename" in r.__fields__ else ""
            done.files += to.write(r["output_name"], dng(image(v, tuple(r["cfa"]), self.out, original or "")))[2]
        return done


class DngSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bayer_dng"

    def schema(self) -> str:
        return "output_name string, width int, height int, cfa array<int>, payload binary"

    def writer(self, schema, overwrite: bool) -> DngWriter:
        return DngWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DngSink)
