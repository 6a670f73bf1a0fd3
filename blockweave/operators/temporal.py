"""Residuals against the previous frame, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import basis, quant_table

def _by_block():
    return Window.partitionBy("channel", "block_id").orderBy("frame_idx")


def residual(blocks: DataFrame, values: str = "n") -> DataFrame:
    """Column ``d``: each block's indices less those of the previous frame.

    Reconstruction is never clamped and every residual is a whole multiple of its divisor, so the closed prediction
    loop is a difference of rounded values wherever no value is exactly halfway: one lag, by (channel, block).
    Blocks are the unit of the shuffle; time is only sorted within one block.
    """
    before = F.lag(values).over(_by_block())
    return blocks.withColumn("d", F.when(before.isNull(), F.col(values)).otherwise(F.zip_with(F.col(values), before, lambda a, b: a - b)))


def reconstruct(blocks: DataFrame, values: str = "d") -> DataFrame:
    """Column ``n``: running sums of residuals over time; 64 streaming window sums in one sort of each block."""
    running = _by_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.get(F.col(values), F.lit(i))).over(running).cast("int").alias(f"s{i}") for i in range(64)]
    keep = [c for c in blocks.columns if c != "n"]
    summed = blocks.select(*keep, *sums)
    return summed.select(*keep, F.array(*[f"s{i}" for i in range(64)]).alias("n"))


def exact_residual(blocks: DataFrame, quality: int = 50) -> DataFrame:
    """``(frame_idx, channel, block_id, d)`` by the sequential loop in single precision, ties included.

    Each block's frames are folded in order against the reconstruction so far; blocks run apart from each other.
    """
    b = basis().astype(np.float32)
    tables = [np.array(quant_table(quality, k), np.float32) for k in (True, False)]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        q = tables[0 if pdf["channel"].iloc[0] == 0 else 1]
        ahead, out = np.full((8, 8), 128, np.float32), []
        for px in pdf["px"]:
            c = (b @ (np.asarray(px, np.float32).reshape(8, 8) - ahead) @ b.T).ravel() / q
            d = np.trunc(c + np.copysign(np.float32(0.5), c)).astype(np.int32)
            ahead = ahead + b.T @ (d * q).astype(np.float32).reshape(8, 8) @ b
            out.append(d.tolist())
        return pdf[["frame_idx", "channel", "block_id"]].assign(d=out)

    return blocks.select("frame_idx", "channel", "block_id", "px").groupBy("channel", "block_id").applyInPandas(fold, "frame_idx int, channel int, block_id int, d array<int>")
