"""Profiler exports as strings under the engine's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A profiler export's headers.
HEADERS = {
    "Function Name": "fn",
    "Duration [us]": "duration_us",
    "Compute Throughput [%]": "compute_pct",
    "Memory Throughput [%]": "memory_pct",
    "# Registers [register/thread]": "registers",
}


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark goes, and a column that the file lacks reads as '0'."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    names = {c.lstrip("﻿").strip('"').strip(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{names[h]}`") if h in names else F.lit("0" if c != "fn" else None).cast("string")).alias(c) for h, c in HEADERS.items()])
