"""From an ordered sequence of frames to jobs: natural order, exposure brackets, missing shots, names, split outputs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ordering import numbered

SLOTS = 6
#: Fixed value: the language of a slot.
SHOT_TEXT = r"(E|X)(?:(\+|-|\*|/)([\d.,]+))?"
SHOT = re.compile(SHOT_TEXT, re.I)


@dataclass(frozen=True)
class Shot:
    order_index: int
    multiplier: float


def parse_shots(slots: list[str]) -> list[Shot]:
    """Shots of a bracket, darkest first. Blank slots and X take no place; E is one exposure, E+n is n stops over it, E*n n times it. E-n and E/n count as 1: declare the brighter shots instead."""
    if len(slots) > SLOTS:
        raise ValueError(f"a bracket has {SLOTS} slots at most")
    out: list[Shot] = []
    for text in slots:
        if not (m := SHOT.search(text or "")) or m[1].upper() == "X":
            continue
        try:
            n = float((m[3] or "").replace(",", "."))
        except ValueError:
            n = None
        factor = 1.0 if n is None else {"+": 2.0**n, "*": n}.get(m[2], 1.0)
        out.append(Shot(len(out), factor))
    return sorted(out, key=lambda s: s.multiplier)


def shot_multiplier(text: Column | str) -> Column:
    """The multiplier of a slot's text, null for blank slots and X: the same language as a Column."""
    t = F.col(text) if isinstance(text, str) else text
    part = lambda k: F.regexp_extract(t, f"(?i){SHOT_TEXT}", k)
    n = F.regexp_replace(part(3), ",", ".").try_cast("double")
    return F.when(F.upper(part(1)) == "E", F.when((part(2) == "+") & n.isNotNull(), F.pow(F.lit(2.0), n)).when((part(2) == "*") & n.isNotNull(), n).otherwise(F.lit(1.0)))


def natural_key(name: Column | str) -> list[Column]:
    """Sort keys under which runs of digits compare as numbers, other text by code points, and of names that differ in leading zeros alone the shorter comes first."""
    n = F.col(name) if isinstance(name, str) else name
    chunks = F.regexp_extract_all(n, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda c: c.rlike(r"^\d")
    # numbers come before text, as digits do before letters; their significant digits compare by length first
    key = F.transform(chunks, lambda c: F.struct(
        F.when(digits(c), F.lit("0")).otherwise(c).alias("text"),
        F.when(digits(c), F.length(F.regexp_replace(c, "^0+", ""))).otherwise(F.lit(0)).alias("size"),
        F.when(digits(c), F.regexp_replace(c, "^0+", "")).otherwise(F.lit("")).alias("number"),
    ))
    return [key, F.length(n), n]


def indexed(frames: DataFrame, name: str = "name", reverse: bool = False) -> DataFrame:
    """Add frame_index from 0 in natural order of names. Meant for listings: payloads are read after that."""
    return numbered(frames, [k.desc() if reverse else k.asc() for k in natural_key(name)], "frame_index")


def set_of(index: Column | str, shots: int, delay: int = 0) -> Column:
    """The set of a frame, null for frames before the delay."""
    i = F.col(index) if isinstance(index, str) else index
    return F.when(i >= delay, F.floor((i - delay) / shots))


def brackets(frames: DataFrame, shots: int, delay: int = 0, count: int | None = None) -> DataFrame:
    """set_index and shot_indices of each complete set; a set with a missing frame is left out. `frames` needs frame_index; with `count`, sets that would begin in the last, partial group don't count either."""
    at = set_of("frame_index", shots, delay)
    sets = frames.where(F.col("frame_index") >= delay).groupBy(at.cast("long").alias("set_index")).agg(F.sort_array(F.collect_set("frame_index")).alias("shot_indices"))
    out = sets.where(F.size("shot_indices") == shots)
    return out if count is None else out.where(F.col("set_index") < max(0, (count - delay) // shots))


def base_name(path: Column | str) -> Column:
    """A path's file name without its last extension."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(p, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/\\]*)$", 1)


def frame_name(name: Column | str, index: Column | str) -> Column:
    """The name, or what stands for one where the sequence has none."""
    n, i = (F.col(c) if isinstance(c, str) else c for c in (name, index))
    return F.coalesce(n, F.concat(F.lit("undefined file [index "), i.cast("string"), F.lit("]")))


def serial(index: Column | str, digits: int = 6) -> Column:
    i = (F.col(index) if isinstance(index, str) else index).cast("string")
    return F.when(F.length(i) >= digits, i).otherwise(F.lpad(i, digits, "0"))


def jobs(frames: DataFrame, shots: int, delay: int = 0, count: int | None = None, reverse: bool = False, new_name: str = "", split: int = 1, extension: str = ".dng") -> DataFrame:
    """job_index, set_index, shot_indices, names (of the shots), output_name, original_filename: what is to be written, in order of job_index. frames: frame_index and name, no payloads.

    Outputs are named after their first frame, or new_name with a serial number; with split they are dealt in turn over folders 1 to split, with serial numbers of their own.
    """
    sets = brackets(frames, shots, delay, count)
    rows = sets.select("set_index", "shot_indices", F.posexplode("shot_indices").alias("k", "frame_index")).join(frames.select("frame_index", "name"), "frame_index")
    named = rows.groupBy("set_index", "shot_indices").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("n"))
    order = F.desc("set_index") if reverse else F.asc("set_index")
    named = numbered(named, [order], "job_index")
    part = F.pmod(F.col("job_index"), F.lit(split))
    number = F.floor(F.col("job_index") / split) if split > 1 else F.col("job_index")
    stem = F.concat(F.lit(f"{new_name}_"), serial(number)) if new_name.strip() else base_name(F.col("n")[0]["name"])
    folder = F.concat((part + 1).cast("string"), F.lit("/")) if split > 1 else F.lit("")
    return named.select("job_index", "set_index", "shot_indices", F.transform("n", lambda x: x["name"]).alias("names"), F.concat(folder, stem, F.lit(extension)).alias("output_name"), F.array_join(F.transform("n", lambda x: file_name(x["name"])), ",").alias("original_filename"))


def without_existing(jobs: DataFrame, listing: DataFrame, name: str = "output_name") -> DataFrame:
    """Jobs whose outputs aren't in a listing."""
    return jobs.join(listing.select(F.col(name)), name, "left_anti")


def shots_table(spark: SparkSession, slots: list[str]) -> DataFrame:
    return spark.createDataFrame([(s.order_index, s.multiplier) for s in parse_shots(slots)], "order_index int, multiplier double")
