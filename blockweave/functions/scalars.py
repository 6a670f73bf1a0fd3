"""Scalar columns: tolerant numbers, names with numbers, padded sizes, quantiser rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_float(s: Column) -> Column:
    """Quotes go, a decimal comma becomes a point, blanks are trimmed; what is no number, or null, is 0."""
    t = F.trim(F.regexp_replace(F.replace(s, F.lit('"'), F.lit("")), ",", "."))
    return F.coalesce(F.when(t.rlike(NUMBER), t.try_cast("double")), F.lit(0.0))


def parse_int(s: Column) -> Column:
    """Truncated ``parse_float``."""
    return parse_float(s).cast("int")


def first_number(name: Column) -> Column:
    """The first run of digits as a number; -1 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"[0-9]+", 0), F.lit("")).try_cast("decimal(38,0)"), F.lit(-1))


def display_name(name: Column) -> Column:
    return F.rpad(F.substring(name, 1, 24), 25, " ")


def padded(n: int) -> int:
    return -(-n // 8) * 8


def half_away(v: Column, digits: int = 6) -> Column:
    """Nearest whole number, halves away from zero, after ``digits`` decimals: sums in any order agree."""
    return F.round(F.round(v, digits)).cast("int")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(png|jpg|jpeg)$")
