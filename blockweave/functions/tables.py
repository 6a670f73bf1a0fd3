"""Constant tables of the block transform."""

from __future__ import annotations

import numpy as np

# The example luminance and chrominance quantisation tables of ITU-T T.81, Annex K (K.1, K.2).
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)


def scale_of(quality: int) -> float:
    """What a quality from 1 to 100 multiplies the base tables by; out of range is clamped."""
    q = min(100, max(1, quality))
    return 50 / q if q < 50 else 2 - q / 50


def quant_table(quality: int, luma: bool = True) -> list[int]:
    s = scale_of(quality)
    return [int(min(255, max(1, np.floor(b * s + 0.5)))) for b in (LUMA if luma else CHROMA)]


def basis() -> np.ndarray:
    """Row k holds the k-th orthonormal DCT-II vector of length 8."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    b = np.cos(np.pi * (2 * n + 1) * k / 16) / 2
    b[0] /= np.sqrt(2)
    return b


def zigzag() -> list[int]:
    """Raster positions in the order of the diagonal scan."""
    diagonal = lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)
    return sorted(range(64), key=diagonal)


def permutation(scan: str = "rank") -> list[int]:
    """out[i] = block[Z[i]]. ``rank``, the container's order, gathers by each position's rank in the diagonal scan;
    ``standard`` gathers in the scan's own order."""
    order = zigzag()
    if scan == "standard":
        return order
    if scan != "rank":
        raise ValueError(f"unknown scan: {scan}")
    return [order.index(p) for p in range(64)]


def inverse(z: list[int]) -> list[int]:
    return [z.index(p) for p in range(64)]
