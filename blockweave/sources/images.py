"""Directories of images as frames, and frames as PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_number, is_image
from ..schemas import FRAMES

# The signature and the critical chunk names of PNG.
PNG = b"\x89PNG\r\n\x1a\n"
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class ImageError(ValueError):
    """A file that can't be read as an image, or frames that don't belong together."""


def _unfilter(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    """PNG's row filters undone: rows of ``row`` bytes, ``step`` bytes a pixel."""
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.int64)
    at = 0
    for y in range(height):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, row, at + 1).astype(np.int64)
        at += row + 1
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step])
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(row):
                left = line[x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    p = left + above[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        elif kind != 0:
            raise ImageError(f"PNG filter {kind}")
        above = line & 255
        out[y] = above
    return out


def _samples(raw: bytes, width: int, height: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) samples from filtered rows, and how many bytes they took."""
    if not width or not height:
        return np.zeros((height, width, channels), np.int64), 0
    row = -(-width * channels * depth // 8)
    lines = _unfilter(raw[: height * (row + 1)], height, row, max(1, channels * depth // 8))
    if depth == 16:
        v = lines.reshape(height, -1, 2).astype(np.int64)[:, :, 0]  # the high byte
    elif depth == 8:
        v = lines.astype(np.int64)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : (row * 8) // depth * depth].reshape(height, -1, depth)
        v = bits.astype(np.int64) @ (1 << np.arange(depth)[::-1])
    return v[:, : width * channels].reshape(height, width, channels), height * (row + 1)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) bytes: palettes and tRNS applied, 16 bits cut to their high byte, Adam7 woven."""
    at, idat, palette, clear, head = 8, b"", None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            idat += body
        elif kind == b"IEND":
            break
    if head is None or not idat:
        raise ImageError("PNG without header or data")
    width, height, depth, colour, _, _, interlace = head
    channels = _SAMPLES[colour]
    try:
        raw = zlib.decompress(idat)
    except zlib.error as e:
        raise ImageError(f"PNG data: {e}") from e
    if interlace:
        v = np.zeros((height, width, channels), np.int64)
        for x0, y0, dx, dy in _ADAM7:
            part, used = _samples(raw, -(-(width - x0) // dx) if width > x0 else 0, -(-(height - y0) // dy) if height > y0 else 0, channels, depth)
            v[y0::dy, x0::dx] = part
            raw = raw[used:]
    else:
        v, _ = _samples(raw, width, height, channels, depth)
    if colour == 3:
        if palette is None:
            raise ImageError("PNG without its palette")
        index = v[:, :, 0]
        v = palette[np.minimum(index, len(palette) - 1)].astype(np.int64)
        if clear is not None:
            alpha = np.append(np.frombuffer(clear, np.uint8), np.full(256, 255, np.uint8))
            v = np.dstack([v, alpha[index]])
    else:
        if clear is not None and colour in (0, 2):
            key = np.array(struct.unpack(f">{channels}H", clear[: 2 * channels]))
            key = key >> 8 if depth == 16 else key
            v = np.dstack([v, np.where((v == key).all(axis=2), 255 * 0, 255 if depth >= 8 else (1 << depth) - 1)])
        if depth < 8:
            v = v * (255 // ((1 << depth) - 1))
    return v.astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits."""
    if len(data) < 54:
        raise ImageError("BMP without header")
    start, size, width, height, _, depth, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed not in (0, 3) or depth not in (8, 24, 32) or width <= 0 or not height:
        raise ImageError("BMP of an unsupported kind")
    row = -(-width * depth // 32) * 4
    lines = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * depth // 8]
    if height > 0:
        lines = lines[::-1]
    if depth == 8:
        count = (start - 14 - size) // 4
        return np.frombuffer(data, np.uint8, count * 4, 14 + size).reshape(-1, 4)[:, 2::-1][lines]
    v = lines.reshape(abs(height), width, depth // 8)
    return np.dstack([v[:, :, 2::-1], v[:, :, 3:]]) if depth == 32 and v[:, :, 3].any() else v[:, :, 2::-1].copy()


def decode_pnm(data: bytes) -> np.ndarray:
    """Binary PGM and PPM."""
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    channels = 3 if data[:2] == b"P6" else 1
    wide = 2 if top > 255 else 1
    v = np.frombuffer(data, np.uint8, width * height * channels * wide, at + 1)
    return v.reshape(height, width, channels, wide)[:, :, :, 0].copy()


def decode(data: bytes) -> np.ndarray:
    """An image by its first bytes. Formats beyond these go through Spark's ``image`` source (``read_jvm``)."""
    try:
        if data[:8] == PNG:
            return decode_png(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
        if data[:2] in (b"P5", b"P6"):
            return decode_pnm(data)
    except (IndexError, ValueError, struct.error, KeyError) as e:
        raise e if isinstance(e, ImageError) else ImageError(str(e)) from e
    raise ImageError("not a PNG, BMP or PNM file")


# The weights, of 256, by which colours become gray.
GRAY = (77, 150, 29)


def with_channels(pixels: np.ndarray, channels: int) -> np.ndarray:
    """The image with 1 (gray), 2 (gray, alpha), 3 (RGB) or 4 (RGB, alpha) channels; alpha is 255 where there was none."""
    have = pixels.shape[2]
    if not 1 <= channels <= 4 or not 1 <= have <= 4:
        raise ImageError(f"{have} to {channels} channels")
    colour, alpha = (pixels[:, :, :-1], pixels[:, :, -1:]) if have in (2, 4) else (pixels, np.full_like(pixels[:, :, :1], 255))
    if channels < 3 and colour.shape[2] == 3:
        colour = (colour.astype(np.int64) @ np.array(GRAY) >> 8).astype(np.uint8)[:, :, None]
    elif channels > 2 and colour.shape[2] == 1:
        colour = colour.repeat(3, axis=2)
    return np.concatenate([colour, alpha], axis=2) if channels in (2, 4) else colour


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """8-bit PNG of 1 to 4 channels, rows unfiltered."""
    height, width, channels = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((height, width * channels + 1), np.uint8)
    rows[:, 1:] = pixels.reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP; one channel is spread over three, alpha is left out."""
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]
    height, width, _ = rgb.shape
    row = -(-width * 3 // 4) * 4
    lines = np.zeros((height, row), np.uint8)
    lines[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + lines.size, 0, 0, 54, 40, width, height, 1, 24, 0, lines.size, 0, 0, 0, 0) + lines.tobytes()


def encode_by_name(name: str, pixels: np.ndarray) -> bytes:
    """BMP for .bmp, else PNG."""
    return encode_bmp(pixels) if name.lower().endswith(".bmp") else encode_png(pixels)


def list_files(spark: SparkSession, folder: str, images_only: bool = False) -> DataFrame:
    """``(path, length)`` of a flat folder's files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    return files.where(is_image(F.col("path"))) if images_only else files


def numbered(files: DataFrame, order: str = "path") -> DataFrame:
    """Column ``frame_idx``: by whole path, or by the first number in the name, then path. One row for each file."""
    name = F.substring_index("path", "/", -1)
    keys = {"path": [F.col("path")], "numeric": [first_number(name), F.col("path")]}
    if order not in keys:
        raise ImageError(f"unknown order: {order}")
    return files.withColumn("frame_idx", (F.row_number().over(Window.orderBy(*keys[order])) - 1).cast("int"))


def manifest(files: DataFrame) -> DataFrame:
    """Images in numeric order, as a video writer takes them."""
    return numbered(files.where(is_image(F.col("path"))), "numeric").select("frame_idx", "path")


#: First bytes of the formats that only the JVM reads here: JPEG and GIF.
JVM_ONLY = (b"\xff\xd8\xff", b"GIF")


def read_frames(spark: SparkSession, folder: str, order: str = "path") -> DataFrame:
    """Frames of a folder. A file that is no image, or that differs in size from the first, fails the job.

    JPEG and GIF files are told by their first bytes and go through the JVM's reader, all others through ``decode``.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
        empty = files.select("path").isEmpty()
    except Exception as e:
        raise ImageError(f"can't list {folder}: {e}") from e
    if empty:
        raise ImageError(f"{folder} holds no files")
    index = numbered(files.select("path"), order)
    foreign = F.substring("content", 1, 3).isin([bytearray(m) for m in JVM_ONLY])
    if not files.where(foreign).isEmpty():
        return _read_mixed(spark, files, folder, index, foreign)
    first = decode(files.join(F.broadcast(index.where("frame_idx = 0")), "path").select("content").first()[0]).shape

    def run(batches):
        for pdf in batches:
            out = []
            for i, path, content in zip(pdf["frame_idx"], pdf["path"], pdf["content"]):
                v = decode(content)
                if v.shape != first:
                    raise ImageError(f"{path} is {v.shape}, the first frame {first}")
                out.append((i, path, v.shape[1], v.shape[0], v.shape[2], v.tobytes()))
            yield pd.DataFrame(out, columns=["frame_idx", "path", "width", "height", "channels", "data"])

    rows = files.select("path", "content").join(F.broadcast(index), "path")
    return rows.select("frame_idx", "path", "content").mapInPandas(run, FRAMES)


def _read_mixed(spark: SparkSession, files: DataFrame, folder: str, index: DataFrame, foreign: Column) -> DataFrame:
    """Frames of a folder that holds JPEG or GIF files; sizes are compared once all are decoded."""

    def run(batches):
        for pdf in batches:
            own = [decode(c) for c in pdf["content"]]
            yield pd.DataFrame([(p, v.shape[1], v.shape[0], v.shape[2], v.tobytes()) for p, v in zip(pdf["path"], own)], columns=["path", "width", "height", "channels", "data"])

    kind = "path string, width int, height int, channels int, data binary"
    plain = files.where(~foreign).select("path", "content").mapInPandas(run, kind)
    shape = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two sources write local paths differently
    jvm = read_jvm(spark, folder).withColumn("path", shape("path")).join(files.where(foreign).select(shape("path").alias("path")), "path", "left_semi")
    every = plain.withColumn("path", shape("path")).unionByName(jvm.select(plain.columns))
    rows = index.select("frame_idx", F.col("path").alias("name"), shape("path").alias("path")).join(every, "path", "left")
    first = rows.where("frame_idx = 0").select("width", "height", "channels").first()
    same = (F.col("width") == first.width) & (F.col("height") == first.height) & (F.col("channels") == first.channels)
    told = F.raise_error(F.concat(F.col("name"), F.lit(f" is no image of {first.width} x {first.height} x {first.channels}, the first frame's size"))).cast("binary")
    return rows.select("frame_idx", F.col("name").alias("path"), "width", "height", "channels", F.when(same, F.col("data")).otherwise(told).alias("data"))


def read_jvm(spark: SparkSession, folder: str, order: str = "path") -> DataFrame:
    """Frames through Spark's ``image`` source (JPEG, GIF and what else the JVM reads), bytes turned to RGB order."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(folder).select(F.col("image.origin").alias("path"), F.col("image.*"))
    index = numbered(rows.select("path"), order)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                v = v if r.nChannels < 3 else np.dstack([v[:, :, 2::-1], v[:, :, 3:]])
                out.append((r.frame_idx, r.path, r.width, r.height, r.nChannels, v.tobytes()))
            yield pd.DataFrame(out, columns=["frame_idx", "path", "width", "height", "channels", "data"])

    return rows.join(F.broadcast(index), "path").select("frame_idx", "path", "height", "width", "nChannels", "data").mapInPandas(run, FRAMES)


def write_frames(frames: DataFrame, folder: str, pattern: str = "frame_%04d.png") -> int:
    """Each frame as a file of a shared folder, written by the task that holds it; how many."""
    import os

    os.makedirs(folder, exist_ok=True)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                name = os.path.join(folder, pattern % r.frame_idx)
                with open(f"{name}.part", "wb") as f:
                    f.write(encode_by_name(name, v))
                os.replace(f"{name}.part", name)  # a task that runs twice leaves one whole file
            yield pd.DataFrame({"n": [len(pdf)]})

    return frames.select("frame_idx", "width", "height", "channels", "data").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
