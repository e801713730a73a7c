"""Single-file sequences: a header, then frames at equal distances. Registered as the data source `bayer_seq`: partitions are ranges of frames of one file, and each task reads only its own bytes. The path is a file or a folder of *.seq files."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.cfa import BGGR, GBRG, GRBG, RGGB

FIRST_FRAME = 8192
#: Image formats that can be read, and patterns by code.
BAYER, BAYER_MSB, BAYER_PACKED = 101, 113, 132
PATTERNS = {0: GBRG, 1: GRBG, 2: BGGR, 3: RGGB}
SCHEMA = "seq_id string, frame_index long, name string, width int, height int, cfa array<int>, format string, payload binary"


@dataclass
class SeqHeader:
    version: int
    description: str
    width: int
    height: int
    depth: int
    real_depth: int
    image_bytes: int
    image_format: int
    count: int
    stride: int
    cfa: tuple[int, ...]
    compression: int

    def sample_format(self, flip: bool = False) -> str:
        """bright16, dark16, 12p or invalid; flip takes bright for dark and the other way round."""
        if self.real_depth == self.depth == 16:
            kind = "bright16"
        elif (self.real_depth, self.depth) == (12, 16):
            kind = "bright16" if self.image_format == BAYER_MSB else "dark16"
        elif (self.real_depth, self.depth) == (12, 12) and self.image_format == BAYER_PACKED:
            return "12p"
        else:
            return "invalid"
        return {"bright16": "dark16", "dark16": "bright16"}[kind] if flip else kind


def parse_header(b: bytes) -> SeqHeader:
    u = lambda at: struct.unpack_from("<I", b, at)[0]
    return SeqHeader(u(28), b[36 : 36 + 104].decode("utf-16-le", "replace").split("\0")[0], u(548), u(552), u(556), u(560), u(564), u(568), u(572), u(580), PATTERNS.get(u(608), RGGB), u(620))


def checked(h: SeqHeader, flip: bool = False) -> str:
    """The sample format, or an error that says why a file can't be read."""
    if h.compression:
        raise ValueError(f"compression {h.compression} can't be read")
    if h.image_format not in (BAYER, BAYER_MSB, BAYER_PACKED):
        raise ValueError(f"image format {h.image_format} isn't a Bayer one")
    kind = h.sample_format(flip)
    if kind == "invalid":
        raise ValueError(f"{h.real_depth} bits in {h.depth} can't be read")
    return kind


@dataclass
class Frames(InputPartition):
    path: str
    first: int
    last: int


class SeqReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.path, self.flip = path if "://" in path else f"file://{path}", str(options.get("flip12in16", "false")).lower() == "true"
        self.per_task, self.with_payload = int(options.get("framesPerTask", 32)), str(options.get("payload", "true")).lower() == "true"

    def _open(self, path: str):
        where, path = fs.FileSystem.from_uri(path)
        return where.open_input_file(path)

    def partitions(self) -> list[Frames]:
        where, path = fs.FileSystem.from_uri(self.path)
        files = [self.path]
        if where.get_file_info(path).type == fs.FileType.Directory:
            found = where.get_file_info(fs.FileSelector(path))
            files = sorted(f"{self.path.rstrip('/')}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name.endswith(".seq"))
        out = []
        for file in files:
            with self._open(file) as f:
                n = parse_header(f.read_at(1024, 0)).count
            out += [Frames(file, i, min(n, i + self.per_task)) for i in range(0, n, self.per_task)]
        return out or [Frames("", 0, 0)]

    def read(self, part: Frames):
        if part.first == part.last:
            return
        stem = re.sub(r"\.[^.]*$", "", part.path.rsplit("/", 1)[-1]).replace(".", "_")
        with self._open(part.path) as f:
            h = parse_header(f.read_at(1024, 0))
            kind = checked(h, self.flip)
            for i in range(part.first, part.last):
                payload = f.read_at(h.image_bytes, FIRST_FRAME + i * h.stride) if self.with_payload else None
                yield (part.path, i, f"{stem}_{i}", h.width, h.height, list(h.cfa), kind, payload)


class SeqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bayer_seq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeqReader:
        return SeqReader(dict(self.options))


def read_seq(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(SeqSource)
    return spark.read.format("bayer_seq").options(**options).load(path)
