"""Operators over pixel rows (frame_index, y, x, v), one row for each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cfa import GRBG, channel_gain, colour, phase
from ..functions.curves import WHITE, srgb


def exploded(frames: DataFrame, samples: str, width: int) -> DataFrame:
    """Frames with an array of samples to pixel rows."""
    rest = [c for c in frames.columns if c != samples]
    rows = frames.select(*rest, F.posexplode(samples).alias("pos", "v"))
    return rows.select(*rest, F.expr(f"cast(pos div {width} as int)").alias("y"), F.expr(f"cast(pos % {width} as int)").alias("x"), "v")


def channel_stats(pixels: DataFrame) -> DataFrame:
    """Count, peak and mean of each place in the colour pattern."""
    return pixels.groupBy(phase("y", "x").alias("channel")).agg(F.count("*").alias("n"), F.max("v").alias("peak"), F.avg("v").alias("mean"))


def crop(pixels: DataFrame, width: int, height: int, left: int = 0, top: int = 0, right: int = 0, bottom: int = 0) -> DataFrame:
    """Cut amounts off each side, rounded down to even numbers so that the pattern stays, and count from the new corner."""
    left, top, right, bottom = (n - n % 2 for n in (left, top, right, bottom))
    kept = pixels.where((F.col("x") >= left) & (F.col("x") < width - right) & (F.col("y") >= top) & (F.col("y") < height - bottom))
    return kept.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    """Add each pixel's tile, and its place in it."""
    return pixels.withColumns({"tile_y": F.expr(f"cast(y div {size} as int)"), "tile_x": F.expr(f"cast(x div {size} as int)"), "in_y": F.col("y") % size, "in_x": F.col("x") % size})


def padded_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """frame_index, tile_y, tile_x, n (samples of the frame), padding (zeros up to a full tile)."""
    return tiles(pixels, size).groupBy("frame_index", "tile_y", "tile_x").agg(F.count("*").alias("n")).withColumn("padding", F.lit(size * size) - F.col("n"))


def grey_preview(pixels: DataFrame, subsample: int = 4, gamma: bool = True) -> DataFrame:
    """Every subsample-th sample of every subsample-th row as 0 to 255."""
    v = F.col("v") / float(WHITE)
    shown = (srgb(v) if gamma else v) * 255
    return pixels.where((F.col("x") % subsample == 0) & (F.col("y") % subsample == 0)).select("frame_index", F.expr(f"cast(y div {subsample} as int)").alias("y"), F.expr(f"cast(x div {subsample} as int)").alias("x"), F.floor(shown).cast("int").alias("g"))


def debayer_preview(pixels: DataFrame, pattern: tuple[int, ...] = GRBG, gains: tuple[float, float, float] = (1.0, 1.0, 1.0), subsample: int = 4, gamma: bool = True) -> DataFrame:
    """A colour for each block: the samples of its upper left 2 by 2 pattern, without interpolation; of two greens the later one."""
    v = channel_gain(F.col("v") / float(WHITE), pattern, gains, "y", "x")
    shown = F.floor(F.least(F.greatest((srgb(v) if gamma else v) * 255, F.lit(0.0)), F.lit(255.0))).cast("int")
    some = pixels.where((F.col("x") % subsample < 2) & (F.col("y") % subsample < 2))
    by = [F.col("frame_index"), F.expr(f"cast(y div {subsample} as int)").alias("py"), F.expr(f"cast(x div {subsample} as int)").alias("px")]
    rows = some.select(*by, shown.alias("s"), colour(pattern, "y", "x").alias("c"), phase("y", "x").alias("p"))
    pick = lambda k: F.max_by("s", F.when(F.col("c") == k, F.col("p")))
    return rows.groupBy("frame_index", "py", "px").agg(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def waveform_scope(pixels: DataFrame, width: int, columns: int = 64, rows: int = 128, pattern: tuple[int, ...] = GRBG, gains: tuple[float, float, float] = (1.0, 1.0, 1.0), gamma: bool = True) -> DataFrame:
    """For each place in the pattern a histogram of levels over columns of the frame, saturating at 255: channel, col, row (0 is the lowest level), n."""
    v = channel_gain(F.col("v") / float(WHITE), pattern, gains, "y", "x")
    v = F.least(F.greatest(srgb(v) if gamma else v, F.lit(0.0)), F.lit(1.0))
    even = F.col("x") - F.col("x") % 2
    keyed = pixels.select(phase("y", "x").alias("channel"), F.floor(even / float(width) * columns).cast("int").alias("col"), F.floor(v * (rows - 1)).cast("int").alias("row"))
    return keyed.groupBy("channel", "col", "row").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("n"))


def scope_peak(pixels: DataFrame, pattern: tuple[int, ...] = GRBG, gains: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """The largest level of each place in the pattern, before clamping."""
    return pixels.groupBy(phase("y", "x").alias("channel")).agg(F.max(channel_gain(F.col("v") / float(WHITE), pattern, gains, "y", "x")).alias("peak"))


def magnifier(pixels: DataFrame, x0: int, y0: int, size: int = 20, zoom: int = 10) -> DataFrame:
    """A size by size cut, each sample repeated zoom times in either direction."""
    cut = pixels.where((F.col("x") >= x0) & (F.col("x") < x0 + size) & (F.col("y") >= y0) & (F.col("y") < y0 + size))
    steps = F.sequence(F.lit(0), F.lit(zoom - 1))
    return cut.select("frame_index", F.explode(F.transform(steps, lambda d: (F.col("y") - y0) * zoom + d)).alias("y"), "x", "v").select("frame_index", "y", F.explode(F.transform(steps, lambda d: (F.col("x") - x0) * zoom + d)).alias("x"), "v")


def clipped(v: Column | str, point: float) -> Column:
    """Strictly above the clipping point."""
    return (F.col(v) if isinstance(v, str) else v) / float(WHITE) > point


def diff_categories(pixels: DataFrame, width_bits: int = 16) -> DataFrame:
    """Bit lengths of differences to the left neighbour two samples before (the same colour's), as a lossless coder sees them: category, n. The first two columns are predicted from the row above, the first samples from half the range. Rows are windows; only the first two columns are sorted once more. For whole frames see ljpeg.category_counts, which needs no shuffle of samples."""
    row = W.partitionBy("frame_index", "y").orderBy("x")
    above = W.partitionBy("frame_index", "x").orderBy("y")
    inner = pixels.withColumn("guess", F.lag("v", 2).over(row)).where("x >= 2")
    edge = pixels.where("x < 2").withColumn("guess", F.coalesce(F.lag("v").over(above), F.lit(1 << (width_bits - 1))))
    d = F.abs(F.col("v") - F.col("guess"))
    return inner.unionByName(edge).select(F.when(d == 0, F.lit(0)).otherwise(F.length(F.bin(d))).cast("int").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
