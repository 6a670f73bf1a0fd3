"""The 8x8 cosine transform, quantisation and scan order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import half_away
from ..functions.tables import basis, inverse, permutation, quant_table


def _by_matrix(rows: pa.Array, m: np.ndarray) -> pa.Array:
    """Every list of 64 as a vector times ``m``; a whole Arrow batch is one product."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 64) @ m
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32)), pa.array(x.ravel()))


def _separable() -> np.ndarray:
    """The matrix of rows-then-columns on raster vectors: the Kronecker square of the 1-D basis."""
    return np.kron(basis(), basis())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _forward(px: pa.Array) -> pa.Array:
    return _by_matrix(px, _separable().T)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _backward(c: pa.Array) -> pa.Array:
    return _by_matrix(c, _separable())


def dct(px: Column | str) -> Column:
    """Orthonormal 2-D DCT-II of 64 raster values; a shuffle-free map."""
    return _forward(F.col(px) if isinstance(px, str) else px)


def idct(c: Column | str) -> Column:
    return _backward(F.col(c) if isinstance(c, str) else c)


def naive_dct(px: np.ndarray) -> np.ndarray:
    """All 64 x 64 products one by one, as a test's yardstick."""
    b = basis()
    return np.array([sum(px[8 * y + x] * b[u, y] * b[v, x] for y in range(8) for x in range(8)) for u in range(8) for v in range(8)])


def naive_idct(c: np.ndarray) -> np.ndarray:
    b = basis()
    return np.array([sum(c[8 * u + v] * b[u, y] * b[v, x] for u in range(8) for v in range(8)) for y in range(8) for x in range(8)])


def _table(channel: Column, quality: int) -> Column:
    """The channel's 64 divisors as a literal, folded at planning time."""
    luma, chroma = (F.array(*map(F.lit, quant_table(quality, k))) for k in (True, False))
    return F.when(channel == 0, luma).otherwise(chroma)


def quantise(blocks: DataFrame, quality: int = 50, values: str = "c") -> DataFrame:
    """Column ``n``: whole multiples of the divisors, halves away from zero."""
    return blocks.withColumn("n", F.zip_with(F.col(values), _table(F.col("channel"), quality), lambda c, q: half_away(F.round(c, 6) / q, 9)))


def dequantise(blocks: DataFrame, quality: int = 50, values: str = "n") -> DataFrame:
    """Column ``c``: multiples times divisors."""
    return blocks.withColumn("c", F.zip_with(F.col(values), _table(F.col("channel"), quality), lambda n, q: (n * q).cast("double")))


def _gather(values: str, z: list[int]) -> Column:
    # one literal get for each place: referenced 64 times, the source array stays in a projection of its own
    return F.array(*[F.get(F.col(values), F.lit(i)) for i in z])


def permute(values: str, scan: str = "rank") -> Column:
    return _gather(values, permutation(scan))


def unpermute(values: str, scan: str = "rank") -> Column:
    return _gather(values, inverse(permutation(scan)))
