"""Colour columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# BT.601 full-range weights as the container's decoder expects them.
Y = (0.299, 0.587, 0.114, 0.0)
CB = (-0.168736, -0.331264, 0.5, 128.0)
CR = (0.5, -0.418688, -0.081312, 128.0)
R_CR, G_CB, G_CR, B_CB = 1.402, 0.344136, 0.714136, 1.772


def weighted(w: tuple[float, float, float, float], r: Column, g: Column, b: Column) -> Column:
    return F.lit(w[0]) * r + F.lit(w[1]) * g + F.lit(w[2]) * b + F.lit(w[3])


def to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return weighted(Y, r, g, b), weighted(CB, r, g, b), weighted(CR, r, g, b)


def to_byte(v: Column) -> Column:
    """Half up by truncation after the clamp, as the decoder rounds."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), v + 0.5)).cast("int")


def to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    b, r = cb - 128, cr - 128
    return to_byte(y + F.lit(R_CR) * r), to_byte(y - F.lit(G_CB) * b - F.lit(G_CR) * r), to_byte(y + F.lit(B_CB) * b)


def uses_colour(channels: int, use_ycbcr: bool) -> bool:
    return use_ycbcr and channels >= 3
