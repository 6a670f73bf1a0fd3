"""The binary container: a 28-byte header, then for each frame and channel its two lengths and its chunk."""

from __future__ import annotations

import os
import struct
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import CHUNKS

# The container's magic and layout, little-endian.
MAGIC = b"FLI2"
_HEAD = struct.Struct("<4s6i")
_CHUNK = struct.Struct("<II")


class ContainerError(ValueError):
    """A file that isn't a whole container."""


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    channels: int
    quality: int
    frame_count: int
    use_ycbcr: int

    def pack(self) -> bytes:
        return _HEAD.pack(MAGIC, *astuple(self))


def read_header(data: bytes) -> Header:
    if len(data) < _HEAD.size:
        raise ContainerError("shorter than a header")
    magic, *rest = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ContainerError(f"magic is {magic!r}")
    return Header(*rest)


def index(path: str) -> tuple[Header, list[tuple[int, int, int, int, int]]]:
    """The header and (frame_idx, channel, rle_bytes, offset, enc_len) of every chunk; payloads are skipped, not read."""
    chunks, size = [], os.path.getsize(path)
    with open(path, "rb") as f:
        head = read_header(f.read(_HEAD.size))
        at = _HEAD.size
        for frame in range(head.frame_count):
            for channel in range(head.channels):
                f.seek(at)
                lengths = f.read(_CHUNK.size)
                if len(lengths) < _CHUNK.size:
                    raise ContainerError(f"ends before frame {frame}, channel {channel}")
                rle, enc = _CHUNK.unpack(lengths)
                if at + _CHUNK.size + enc > size:
                    raise ContainerError(f"frame {frame}, channel {channel} is cut off")
                if rle and not enc:
                    raise ContainerError(f"frame {frame}, channel {channel} has no data")
                chunks.append((frame, channel, rle, at + _CHUNK.size, enc))
                at += _CHUNK.size + enc
    return head, chunks


class _Range(InputPartition):
    def __init__(self, rows: list[tuple[int, int, int, int, int]]) -> None:
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.size = int(options.get("chunksPerPartition", "256"))

    def partitions(self):
        _, chunks = index(self.path)
        return [_Range(chunks[i : i + self.size]) for i in range(0, len(chunks), self.size)] or [_Range([])]

    def read(self, partition):
        with open(self.path, "rb") as f:
            for frame, channel, rle, at, n in partition.rows:
                f.seek(at)
                yield frame, channel, rle, n, f.read(n)


class ContainerSource(DataSource):
    """``spark.read.format("framecontainer").load(path)``: chunks, read in parallel by ranges from a walked index."""

    @classmethod
    def name(cls) -> str:
        return "framecontainer"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header and the chunks of a container in a shared folder."""
    with open(path, "rb") as f:
        head = read_header(f.read(_HEAD.size))
    spark.dataSource.register(ContainerSource)
    return head, spark.read.format("framecontainer").load(path)


def write(chunks: DataFrame, head: Header, path: str) -> int:
    """One file, frame by frame and channel by channel, streamed through the driver a partition at a time; its size."""
    n, at = 0, f"{path}.part"
    with open(at, "wb") as f:
        f.write(head.pack())
        for r in chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")]).orderBy("frame_idx", "channel").toLocalIterator():
            f.write(_CHUNK.pack(r.rle_bytes, r.enc_len) + bytes(r.payload or b""))
            n += 1
    if n != head.frame_count * head.channels:
        os.remove(at)
        raise ContainerError(f"{n} chunks for {head.frame_count} frames of {head.channels} channels")
    os.replace(at, path)
    return os.path.getsize(path)


def summary(chunks: DataFrame, head: Header) -> DataFrame:
    """``(frames, raw_bytes, coded_bytes, ratio, bits_per_pixel)``."""
    s = chunks.agg(F.count_distinct("frame_idx").alias("frames"), F.sum(F.col("enc_len") + _CHUNK.size).alias("coded_bytes"))
    pixels = F.col("frames") * head.width * head.height
    return s.select("frames", (pixels * head.channels).alias("raw_bytes"), "coded_bytes", (pixels * head.channels / F.col("coded_bytes")).alias("ratio"), (8 * F.col("coded_bytes") / pixels).alias("bits_per_pixel"))
