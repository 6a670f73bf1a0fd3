"""Byte histograms and Huffman chunks: 256 16-bit counts, little-endian, then bits from the highest down."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = 512
FULL = 65535
#: The longest code that is decoded by a table over all bits.
WINDOW = 16


class CorruptChunk(ValueError):
    """A chunk that can't be what an encoder wrote."""


def byte_histogram(rows: DataFrame, data: str, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, byte, n)``: bytes of a binary column; counts combine before they shuffle."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1)
    one = rows.select(*(keys or []), F.explode(pairs).alias("h")).groupBy(*(keys or []), "h").agg(F.count("*").alias("n"))
    return one.select(*(keys or []), F.conv("h", 16, 10).cast("int").alias("byte"), "n")


def scaled(histogram: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Column ``freq``: counts as they are if all fit 16 bits; else scaled to 65,535, at least 1."""
    top = histogram.groupBy(*(keys or [])).agg(F.max("n").alias("top"))
    joined = histogram.join(top, keys) if keys else histogram.join(F.broadcast(top))
    f = F.when(F.col("top") <= FULL, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") * (F.lit(float(FULL)) / F.col("top")))))
    return joined.withColumn("freq", f.cast("int")).drop("top")


def header_counts(data: bytes) -> np.ndarray:
    """The 256 counts a chunk carries, scaled in single precision."""
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    if n.max(initial=0) <= FULL:
        return n.astype(np.uint16)
    step = np.float32(FULL) / np.float32(n.max())
    return np.where(n > 0, np.maximum((n.astype(np.float32) * step).astype(np.int64), 1), 0).astype(np.uint16)


def codes(counts: np.ndarray) -> dict[int, tuple[int, int]]:
    """symbol -> (length, bits). The lightest subtree, then the lightest of the others, are joined, left then right; the
    first in the list wins a tie. The pair's node takes the lightest one's place and the list's last the other's: both
    sides of a chunk rebuild the same tree, so this order is part of the format. A lone symbol takes one bit."""
    forest = [(int(counts[s]), int(s)) for s in np.flatnonzero(counts)]
    if not forest:
        return {}
    if len(forest) == 1:
        return {forest[0][1]: (1, 0)}
    weight = np.array([w for w, _ in forest], np.int64)
    trees: list = [s for _, s in forest]
    never = np.iinfo(np.int64).max
    while len(trees) > 1:
        a = int(weight.argmin())
        least, weight[a] = weight[a], never
        b = int(weight.argmin())
        trees[a], weight[a] = (trees[a], trees[b]), least + weight[b]
        trees[b], weight[b] = trees[-1], weight[-1]
        trees.pop()
        weight = weight[:-1]
    out, todo = {}, [(trees[0], 0, 0)]
    while todo:
        t, n, bits = todo.pop()
        if isinstance(t, tuple):
            todo += [(t[0], n + 1, bits << 1), (t[1], n + 1, bits << 1 | 1)]
        else:
            out[t] = (n, bits)
    return out


def encode(data: bytes) -> bytes:
    """A chunk of bytes; none at all has no tree and can't be coded."""
    if not data:
        raise CorruptChunk("nothing to encode")
    counts = header_counts(data)
    table = codes(counts)
    length, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (n, b) in table.items():
        length[s], bits[s] = n, b
    symbols = np.frombuffer(data, np.uint8)
    n = length[symbols]
    owner = np.repeat(np.arange(len(symbols)), n)
    left = n[owner] - 1 - (np.arange(len(owner)) - (np.cumsum(n) - n)[owner])
    return counts.astype("<u2").tobytes() + np.packbits((bits[symbols[owner]] >> left & 1).astype(np.uint8)).tobytes()


def decode(chunk: bytes, size: int) -> bytes:
    """``size`` bytes of a chunk; bits past its end read as zero."""
    if len(chunk) < HEADER:
        raise CorruptChunk("a chunk is shorter than its header")
    table = codes(np.frombuffer(chunk[:HEADER], "<u2"))
    if not table and size:
        raise CorruptChunk("a chunk without symbols")
    if len(table) == 1:
        return bytes([next(iter(table))]) * size
    bits = np.unpackbits(np.frombuffer(chunk[HEADER:], np.uint8))
    wide = max(n for n, _ in table.values()) if table else 1
    return _by_window(table, bits, wide, size) if wide <= WINDOW else _by_bit(table, bits, size)


def _by_window(table: dict[int, tuple[int, int]], bits: np.ndarray, wide: int, size: int) -> bytes:
    """Symbol and length at every bit, looked up for all bits at once; only the hops from code to code are a loop."""
    bits = np.concatenate([bits, np.zeros(wide, np.uint8)])
    ahead = np.zeros(len(bits) - wide + 1, np.int64)
    for k in range(wide):
        ahead = ahead << 1 | bits[k : k + len(ahead)]
    symbol, length = np.zeros(1 << wide, np.uint8), np.zeros(1 << wide, np.int64)
    for s, (n, b) in table.items():
        first = b << (wide - n)
        symbol[first : first + (1 << (wide - n))], length[first : first + (1 << (wide - n))] = s, n
    hop, end, at, places = length[ahead].tolist(), len(ahead) - 1, 0, []
    for _ in range(size):
        places.append(at)
        at += hop[at]
        if at > end:
            at = end
    return symbol[ahead[places]].tobytes()


def _by_bit(table: dict[int, tuple[int, int]], bits: np.ndarray, size: int) -> bytes:
    """For trees deeper than a table can be."""
    by = {(n, b): s for s, (n, b) in table.items()}
    text, out, at = bits.tobytes(), bytearray(), 0
    while len(out) < size:
        n = b = 0
        while (n, b) not in by:
            b, n, at = b << 1 | (text[at] if at < len(text) else 0), n + 1, at + 1
        out.append(by[n, b])
    return bytes(out)


def encode_block(block: np.ndarray) -> bytes:
    """A chunk of one block's 64 single-precision values as they lie in memory."""
    return encode(np.asarray(block, "<f4").reshape(64).tobytes())


def decode_block(chunk: bytes) -> np.ndarray:
    return np.frombuffer(decode(chunk, 256), "<f4").copy()


@F.arrow_udf(T.BinaryType())
def huffman_encode(data: pa.Array) -> pa.Array:
    return pa.array([None if d is None or not len(d) else encode(d) for d in data.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def huffman_decode(chunk: pa.Array, size: pa.Array) -> pa.Array:
    return pa.array([None if c is None else decode(c, n) for c, n in zip(chunk.to_pylist(), size.to_pylist())], pa.binary())


@F.arrow_udf(T.ArrayType(T.StructType().add("byte", "integer").add("length", "integer").add("bits", "long")))
def huffman_codes(freq: pa.Array) -> pa.Array:
    """The code table of 256 counts."""
    rows = [[{"byte": s, "length": n, "bits": b} for s, (n, b) in sorted(codes(np.array(f)).items())] for f in freq.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("byte", pa.int32()), ("length", pa.int32()), ("bits", pa.int64())])))


def entropy_bits(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log2(n / total))
