"""Planes to 8x8 blocks and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import to_rgb, to_ycbcr
from ..functions.scalars import padded


def ycbcr(rgb: DataFrame) -> DataFrame:
    """``(frame_idx, y, x, luma, cb, cr)`` of ``(frame_idx, y, x, r, g, b)``."""
    y, cb, cr = to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return rgb.select("frame_idx", "y", "x", y.alias("luma"), cb.alias("cb"), cr.alias("cr"))


def subsample(full: DataFrame) -> DataFrame:
    """The even/even pixel of each 2x2 square; nothing is averaged."""
    kept = full.where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    return kept.select("frame_idx", F.expr("y div 2").cast("int").alias("y"), F.expr("x div 2").cast("int").alias("x"), "cb", "cr")


def restore_rgb(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """``(frame_idx, y, x, r, g, b)``: each pixel takes its square's colour."""
    near = chroma.select("frame_idx", F.col("y").alias("hy"), F.col("x").alias("hx"), "cb", "cr")
    joined = luma.withColumn("hy", F.expr("y div 2").cast("int")).withColumn("hx", F.expr("x div 2").cast("int")).join(near, ["frame_idx", "hy", "hx"])
    r, g, b = to_rgb(F.col("luma"), F.col("cb"), F.col("cr"))
    return joined.select("frame_idx", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def planes(rgb: DataFrame, use_ycbcr: bool = True) -> DataFrame:
    """Pixels ``(frame_idx, channel, y, x, v)`` from one pass: an array of the planes a pixel belongs to is exploded."""
    entry = lambda c, y, x, v: F.struct(F.lit(c).alias("channel"), y.cast("int").alias("y"), x.cast("int").alias("x"), v.cast("double").alias("v"))
    y, x = F.col("y"), F.col("x")
    if use_ycbcr:
        luma, cb, cr = to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
        hy, hx = F.expr("y div 2"), F.expr("x div 2")
        even = (y % 2 == 0) & (x % 2 == 0)
        parts = F.when(even, F.array(entry(0, y, x, luma), entry(1, hy, hx, cb), entry(2, hy, hx, cr))).otherwise(F.array(entry(0, y, x, luma)))
    else:
        parts = F.array(*[entry(i, y, x, F.col(c)) for i, c in enumerate("rgb")])
    return rgb.select("frame_idx", F.inline(parts))


def plane_size(channel: Column, width: int, height: int, use_ycbcr: bool) -> tuple[Column, Column]:
    """Padded (width, height) of a channel."""
    if not use_ycbcr:
        return F.lit(padded(width)), F.lit(padded(height))
    half = lambda n: padded(-(-n // 2))
    luma = channel == 0
    return F.when(luma, padded(width)).otherwise(half(width)), F.when(luma, padded(height)).otherwise(half(height))


def tile(pixels: DataFrame, width: int, height: int, use_ycbcr: bool = True) -> DataFrame:
    """Blocks ``(frame_idx, channel, block_id, px)`` of 64 values in raster order; what a plane lacks is 0.

    One shuffle by block. A block that no pixel touches can't occur: padding is less than a block wide.
    """
    wide, _ = plane_size(F.col("channel"), width, height, use_ycbcr)
    block = (F.expr("y div 8") * (wide / 8).cast("int") + F.expr("x div 8")).cast("int")
    at = F.struct(((F.col("y") % 8) * 8 + F.col("x") % 8).cast("int").alias("pos"), F.col("v"))
    grouped = pixels.select("frame_idx", "channel", block.alias("block_id"), at.alias("p")).groupBy("frame_idx", "channel", "block_id").agg(F.map_from_entries(F.collect_list("p")).alias("m"))
    return grouped.select("frame_idx", "channel", "block_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("px"))


def untile(blocks: DataFrame, width: int, height: int, use_ycbcr: bool = True, values: str = "px") -> DataFrame:
    """Pixels of blocks, without the padding."""
    wide, _ = plane_size(F.col("channel"), width, height, use_ycbcr)
    p = blocks.select("frame_idx", "channel", "block_id", F.posexplode(values).alias("pos", "v"))
    across = (wide / 8).cast("int")
    p = p.select("frame_idx", "channel", (F.expr("cast(block_id as int)") / across).cast("int").alias("by"), (F.col("block_id") % across).alias("bx"), "pos", "v")
    p = p.select("frame_idx", "channel", (F.col("by") * 8 + F.expr("pos div 8")).cast("int").alias("y"), (F.col("bx") * 8 + F.col("pos") % 8).cast("int").alias("x"), "v")
    w = F.when(F.col("channel") == 0, width).otherwise(-(-width // 2)) if use_ycbcr else F.lit(width)
    h = F.when(F.col("channel") == 0, height).otherwise(-(-height // 2)) if use_ycbcr else F.lit(height)
    return p.where((F.col("x") < w) & (F.col("y") < h))


def level_shift(blocks: DataFrame, offset: float, values: str = "px") -> DataFrame:
    return blocks.withColumn(values, F.transform(values, lambda v: v + F.lit(offset)))
