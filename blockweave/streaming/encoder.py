"""Residuals of a stream of blocks: the state of a block is its last rounded values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tables import basis, quant_table
from ..schemas import BLOCKS

OUT = "frame_idx int, channel int, block_id int, d array<int>"


class OutOfOrder(ValueError):
    """A frame that comes after a later one: order defines prediction, so it can't be mended."""


def indices(px: np.ndarray, channel: int, quality: int) -> np.ndarray:
    """Rounded coefficients of rows of 64 pixels, halves away from zero after six decimals, as the batch plan rounds."""
    c = np.round((px - 128) @ np.kron(basis(), basis()).T, 6) / np.array(quant_table(quality, channel == 0))
    c = np.round(c, 9)
    return np.trunc(c + np.copysign(0.5, c)).astype(np.int64)


def residuals(blocks: DataFrame, quality: int = 50) -> DataFrame:
    """``(frame_idx, channel, block_id, d)`` of a streaming ``(frame_idx, channel, block_id, px)``.

    Within a micro-batch a block's frames are sorted; across batches a frame must come after those before it.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values("frame_idx")
        last, before = state.get if state.exists else (-1, None)
        first = int(pdf["frame_idx"].iloc[0])
        if first <= last or pdf["frame_idx"].duplicated().any():
            raise OutOfOrder(f"frame {first} of block {key} after frame {last}")
        n = indices(np.stack(pdf["px"]), int(key[0]), quality)
        d = np.diff(n, axis=0, prepend=np.zeros((1, 64), np.int64) if before is None else np.array([before]))
        state.update((int(pdf["frame_idx"].iloc[-1]), n[-1].tolist()))
        yield pd.DataFrame({"frame_idx": pdf["frame_idx"].to_numpy(np.int32), "channel": np.int32(key[0]), "block_id": np.int32(key[1]), "d": d.astype(np.int32).tolist()})

    return blocks.groupBy("channel", "block_id").applyInPandasWithState(step, OUT, "frame_idx int, n array<int>", "append", GroupStateTimeout.NoTimeout)


def block_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Blocks from Parquet files as they arrive in a folder, the oldest first."""
    return spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
