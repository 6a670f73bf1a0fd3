"""Frames to chunks and back, as DataFrame plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import B_CB, CB, CR, G_CB, G_CR, R_CR, Y, uses_colour
from ..functions.scalars import padded
from ..functions.tables import permutation
from ..operators import entropy, temporal
from ..operators.rle import LONGEST
from ..operators.transform import dct, dequantise, idct, permute, quantise, unpermute
from ..schemas import BLOCKS, CHUNKS
from ..sources import container, images

__all__ = ["blocks_of", "compress", "decompress", "decode", "encode", "frames_of", "permutation"]


def check_options(quality: int, channels: int = 3) -> None:
    if isinstance(quality, bool) or not isinstance(quality, int) or not 1 <= quality <= 100:
        raise ValueError(f"quality must be a whole number from 1 to 100: {quality!r}")
    if channels not in (1, 2, 3):
        raise ValueError(f"{channels} channels: only 1, 2 and 3 can be stored; drop the alpha channel first")


def _sizes(width: int, height: int, channels: int, colour: bool) -> list[tuple[int, int]]:
    half = (-(-width // 2), -(-height // 2))
    return [(width, height)] + [half if colour else (width, height)] * (channels - 1)


def blocks_of(frames: DataFrame, width: int, height: int, channels: int, use_ycbcr: bool = True) -> DataFrame:
    """Blocks of decoded frames: colour, subsampling, zero padding and tiling in one Arrow pass, frame by frame."""
    colour = uses_colour(channels, use_ycbcr)
    weights = np.array([Y, CB, CR])

    def run(batches):
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
                if colour:
                    full = v @ weights[:, :3].T + weights[:, 3]
                    parts = [full[:, :, 0], full[::2, ::2, 1], full[::2, ::2, 2]]
                else:
                    parts = [v[:, :, c] for c in range(channels)]
                for c, plane in enumerate(parts):
                    tall, wide = padded(plane.shape[0]), padded(plane.shape[1])
                    whole = np.zeros((tall, wide))
                    whole[: plane.shape[0], : plane.shape[1]] = plane
                    px = whole.reshape(tall // 8, 8, wide // 8, 8).swapaxes(1, 2).reshape(-1, 64)
                    n = len(px)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * 64 + 1, 64, dtype=np.int32)), pa.array(px.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(np.arange(n, dtype=np.int32)), lists], ["frame_idx", "channel", "block_id", "px"])

    return frames.select("frame_idx", "data").mapInArrow(run, BLOCKS)


def frames_of(blocks: DataFrame, width: int, height: int, channels: int, use_ycbcr: bool = True) -> DataFrame:
    """``(frame_idx, width, height, channels, data)``: a frame's blocks meet in one group, a frame is the unit."""
    colour = uses_colour(channels, use_ycbcr)
    sizes = _sizes(width, height, channels, colour)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        planes = []
        for c, (w, h) in enumerate(sizes):
            own = pdf[pdf["channel"] == c].sort_values("block_id")
            tall, wide = padded(h) // 8, padded(w) // 8
            planes.append(np.stack(own["px"]).reshape(tall, wide, 8, 8).swapaxes(1, 2).reshape(tall * 8, wide * 8)[:h, :w])
        if colour:
            up = lambda p: p.repeat(2, axis=0).repeat(2, axis=1)[:height, :width] - 128
            y, cb, cr = planes[0], up(planes[1]), up(planes[2])
            planes = [y + R_CR * cr, y - G_CB * cb - G_CR * cr, y + B_CB * cb]
        data = np.clip(np.dstack(planes) + 0.5, 0, 255).astype(np.uint8).tobytes()
        return pd.DataFrame({"frame_idx": [pdf["frame_idx"].iloc[0]], "width": [width], "height": [height], "channels": [channels], "data": [data]})

    return blocks.select("frame_idx", "channel", "block_id", "px").groupBy("frame_idx").applyInPandas(build, "frame_idx int, width int, height int, channels int, data binary")


def run_lengths(v: np.ndarray) -> np.ndarray:
    """16-bit numbers with each run of zeros as 0 and its length, none above 32,767."""
    zero = np.concatenate([[False], v == 0, [False]])
    start, end = np.flatnonzero(zero[1:] & ~zero[:-1]), np.flatnonzero(~zero[1:] & zero[:-1])
    pieces = -(-(end - start) // LONGEST)
    run_at = np.repeat(start, pieces) + LONGEST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(LONGEST, np.repeat(end, pieces) - run_at)
    literal = np.flatnonzero(v)
    at = np.concatenate([literal, run_at, run_at + 0.5])
    value = np.concatenate([v[literal], np.zeros(len(run_at), v.dtype), size])
    return value[np.argsort(at, kind="stable")].astype("<i2")


def expand_runs(v: np.ndarray, size: int) -> np.ndarray:
    """``size`` numbers of a stream of runs and literals; what the stream doesn't reach is 0."""
    is_run = np.zeros(len(v), bool)
    for i in np.flatnonzero(v == 0):
        if not is_run[i] and i + 1 < len(v):
            is_run[i + 1] = True
    head = np.flatnonzero(~is_run)
    if len(head) and v[head[-1]] == 0 and head[-1] + 1 == len(v):
        head = head[:-1]
    run = v[np.minimum(head + 1, len(v) - 1)] if len(v) else v
    width = np.where(v[head] == 0, np.maximum(run, 0), 1)
    out = np.repeat(v[head], width)[:size]
    return np.concatenate([out, np.zeros(size - len(out), v.dtype)])


def encode(frames: DataFrame, width: int, height: int, channels: int = 3, quality: int = 50, use_ycbcr: bool = True, mode: str = "window", scan: str = "rank") -> DataFrame:
    """Chunks of frames. ``window`` predicts by a lag over each block's rounded values, ``exact`` folds each block's
    frames in order. Two shuffles: by block for time, by plane for coding."""
    check_options(quality, channels)
    blocks = blocks_of(frames, width, height, channels, use_ycbcr)
    if mode == "exact":
        rest = temporal.exact_residual(blocks, quality)
    elif mode == "window":
        shifted = blocks.withColumn("px", F.transform("px", lambda v: v - 128))
        rest = temporal.residual(quantise(shifted.withColumn("c", dct("px")).drop("px"), quality))
    else:
        raise ValueError(f"unknown mode: {mode}")
    coefs = rest.select("frame_idx", "channel", "block_id", permute("d", scan).alias("c"))

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.concatenate([np.asarray(c, np.int64) for c in pdf.sort_values("block_id")["c"]])
        if np.abs(v).max(initial=0) > LONGEST:
            raise entropy.CorruptChunk("a residual that 16 bits don't hold")
        data = run_lengths(v).tobytes()
        payload = entropy.encode(data)
        return pd.DataFrame({"frame_idx": [pdf["frame_idx"].iloc[0]], "channel": [pdf["channel"].iloc[0]], "rle_bytes": [len(data)], "enc_len": [len(payload)], "payload": [payload]})

    return coefs.groupBy("frame_idx", "channel").applyInPandas(code, CHUNKS)


def decode(chunks: DataFrame, head: container.Header, scan: str = "rank") -> DataFrame:
    """Frames of chunks: chunks open in parallel, running sums by block rebuild time, frames meet again at the end."""
    check_options(head.quality, head.channels)
    colour = uses_colour(head.channels, bool(head.use_ycbcr))
    count = [padded(w) * padded(h) // 64 for w, h in _sizes(head.width, head.height, head.channels, colour)]

    def open_chunks(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                n = count[r.channel]
                data = entropy.decode(r.payload, r.rle_bytes)
                v = expand_runs(np.frombuffer(data, "<i2").astype(np.int64), n * 64)
                yield pd.DataFrame({"frame_idx": r.frame_idx, "channel": r.channel, "block_id": np.arange(n), "c": list(v.reshape(n, 64).astype(np.int32))})

    coefs = chunks.select("frame_idx", "channel", "rle_bytes", "payload").mapInPandas(open_chunks, "frame_idx int, channel int, block_id int, c array<int>")
    rest = coefs.select("frame_idx", "channel", "block_id", unpermute("c", scan).alias("d"))
    whole = dequantise(temporal.reconstruct(rest).drop("d"), head.quality)
    px = whole.select("frame_idx", "channel", "block_id", idct("c").alias("px"))
    return frames_of(px.withColumn("px", F.transform("px", lambda v: v + 128)), head.width, head.height, head.channels, bool(head.use_ycbcr))


def compress(spark: SparkSession, folder: str, path: str, quality: int = 50, use_ycbcr: bool = True, mode: str = "window", order: str = "path") -> container.Header:
    """A folder of images as one container."""
    check_options(quality)
    frames = images.read_frames(spark, folder, order)
    first = frames.where("frame_idx = 0").select("width", "height", "channels").first()
    count = images.list_files(spark, folder).count()
    head = container.Header(first.width, first.height, first.channels, quality, count, int(use_ycbcr))
    container.write(encode(frames, head.width, head.height, head.channels, quality, use_ycbcr, mode), head, path)
    return head


def decompress(spark: SparkSession, path: str, folder: str) -> int:
    """A container's frames as PNG files; how many."""
    head, chunks = container.read(spark, path)
    return images.write_frames(decode(chunks, head), folder)
