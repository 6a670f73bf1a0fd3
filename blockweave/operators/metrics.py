"""Distances between images, and summaries of measured runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_float, parse_int


def mse(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``(*by, mse)``: the mean square of v in ``a`` less v in ``b`` over equal ``keys``."""
    joined = a.select(*keys, F.col("v").alias("va")).join(b.select(*keys, F.col("v").alias("vb")), keys)
    return joined.groupBy(*by).agg(F.avg((F.col("va") - F.col("vb")) * (F.col("va") - F.col("vb"))).alias("mse"))


def psnr(m: Column, top: float = 255.0) -> Column:
    """Decibels; infinite below a mean square of 1e-10."""
    return F.when(m < 1e-10, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(top * top) / m))


def profile(rows: DataFrame) -> DataFrame:
    """Rows of a profiler as numbers: nameless rows and repeated headers go, a missing column counts as 0."""
    get = lambda c: F.col(c) if c in rows.columns else F.lit("0")
    named = rows.where(F.col("fn").isNotNull() & (F.col("fn") != "") & (F.col("fn") != "Function Name"))
    return named.select("fn", parse_float(get("duration_us")).alias("duration"), parse_float(get("compute_pct")).alias("compute"), parse_float(get("memory_pct")).alias("memory"), parse_int(get("registers")).alias("registers"))


def profile_summary(parsed: DataFrame) -> DataFrame:
    """Calls, means and the most registers of each kernel, the longest total first (ties by name)."""
    out = parsed.groupBy("fn").agg(
        F.count("*").alias("calls"), F.sum("duration").alias("total"), F.avg("duration").alias("avg_duration"),
        F.avg("compute").alias("avg_compute"), F.avg("memory").alias("avg_memory"), F.max("registers").alias("registers"),
    )
    return out.orderBy(F.desc("total"), "fn")


def timing_summary(timings: DataFrame) -> DataFrame:
    """Mean and least seconds of each backend's successful runs; a null is a failed run."""
    return timings.where("seconds is not null").groupBy("backend").agg(F.avg("seconds").alias("avg_s"), F.min("seconds").alias("min_s"), F.count("*").alias("runs"))


def speedup(summary: DataFrame, baseline: str) -> DataFrame:
    """The baseline's mean over each backend's; null without a baseline."""
    base = summary.where(F.col("backend") == baseline).agg(F.max("avg_s").alias("base"))
    return summary.join(F.broadcast(base)).select("backend", "avg_s", "min_s", "runs", (F.col("base") / F.col("avg_s")).alias("speedup"))


def in_order(rows: DataFrame, names: list[str], by: str = "backend") -> DataFrame:
    """A fixed order of presentation; other names follow by name."""
    place = F.coalesce(*[F.when(F.col(by) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(len(names)))
    return rows.orderBy(place, by)
