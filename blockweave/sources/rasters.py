"""Frames made from tables: embeddings as one-block frames, order lines as small colour images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 45, 37


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame_idx, channel, block_id, px)``: 64 components as an 8x8 block of bytes."""
    px = F.transform("embedding", lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(e.cast("double") * 255) + 128)))
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("frame_idx"), F.lit(0).alias("channel"), F.lit(0).alias("block_id"), px.alias("px"))


def line_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame_idx, y, x, r, g, b)``: a frame for each line number; a pixel that no line falls on is black.

    Lines combine by pixel before they shuffle; only frames x 1,665 pixels go on.
    """
    byte = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c.cast("int")))
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") - 1).cast("int").alias("frame_idx"), (F.col("l_orderkey") % HEIGHT).cast("int").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x"),
        byte(F.col("l_quantity") * 5).alias("r"), byte(F.round(F.col("l_discount") * 2000)).alias("g"), byte(F.round(F.col("l_tax") * 2000)).alias("b"),
    )
    seen = lines.groupBy("frame_idx", "y", "x").agg(*[F.max(c).alias(c) for c in "rgb"])
    grid = seen.select("frame_idx").distinct().select("frame_idx", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1))).alias("y")).select("frame_idx", "y", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"))
    return grid.join(seen, ["frame_idx", "y", "x"], "left").select("frame_idx", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])


def interleaved(rgb: DataFrame) -> DataFrame:
    """``(frame_idx, data)``: row-major RGB bytes of each frame."""
    px = F.array_sort(F.collect_list(F.struct("y", "x", F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgb"]).alias("h"))))
    return rgb.groupBy("frame_idx").agg(F.unhex(F.array_join(F.transform(px, lambda p: p["h"]), "")).alias("data"))
