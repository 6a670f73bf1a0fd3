"""Zero run-length coding as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LONGEST = 32767
_CHUNK = ["frame_idx", "channel"]


def scan(blocks: DataFrame, values: str = "d") -> DataFrame:
    """``(frame_idx, channel, seq, coef)``: coefficients of all blocks of a plane in one sequence."""
    p = blocks.select(*_CHUNK, "block_id", F.posexplode(values).alias("i", "coef"))
    return p.select(*_CHUNK, (F.col("block_id").cast("long") * 64 + F.col("i")).alias("seq"), "coef")


def tokens(scanned: DataFrame) -> DataFrame:
    """``(frame_idx, channel, tok, value, run)``: literals with run null, and runs of zeros, none above 32,767.

    A plane is the unit: runs cross blocks. A run starts where the coefficient before isn't zero.
    """
    order = Window.partitionBy(*_CHUNK).orderBy("seq")
    z = F.col("coef") == 0
    starts = scanned.withColumn("new", F.when(z & F.coalesce(F.lag("coef").over(order) == 0, F.lit(False)), 0).otherwise(1))
    groups = starts.withColumn("island", F.sum("new").over(order))
    first = F.min("seq").over(Window.partitionBy(*_CHUNK, "island"))
    parts = groups.withColumn("part", F.when(z, F.floor((F.col("seq") - first) / LONGEST)).otherwise(0))
    runs = parts.groupBy(*_CHUNK, "island", "part").agg(F.min("seq").alias("seq"), F.first("coef").alias("value"), F.count("*").alias("n"))
    tok = F.row_number().over(Window.partitionBy(*_CHUNK).orderBy("seq")) - 1
    return runs.select(*_CHUNK, tok.cast("long").alias("tok"), "value", F.when(F.col("value") == 0, F.col("n").cast("int")).alias("run"))


def untokens(toks: DataFrame) -> DataFrame:
    """``(frame_idx, channel, seq, coef)``: widths summed up to each token give its place; runs of 0 or less give nothing."""
    width = F.when(F.col("value") == 0, F.greatest(F.coalesce("run", F.lit(0)), F.lit(0))).otherwise(1)
    order = Window.partitionBy(*_CHUNK).orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    placed = toks.withColumn("w", width).withColumn("at", F.coalesce(F.sum("w").over(order), F.lit(0)))
    seq = F.explode(F.sequence(F.col("at").cast("long"), (F.col("at") + F.col("w") - 1).cast("long")))
    return placed.where("w > 0").select(*_CHUNK, seq.alias("seq"), F.col("value").alias("coef"))


def stream(toks: DataFrame) -> DataFrame:
    """``(frame_idx, channel, pos, v)``: the 16-bit numbers a coder sees, a run as 0 and its length."""
    size = F.when(F.col("run").isNull(), 1).otherwise(2)
    order = Window.partitionBy(*_CHUNK).orderBy("tok").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(order), F.lit(0))
    parts = F.when(F.col("run").isNull(), F.array("value")).otherwise(F.array(F.lit(0), F.col("run")))
    p = toks.select(*_CHUNK, at.alias("at"), parts.alias("parts")).select(*_CHUNK, "at", F.posexplode("parts").alias("k", "v"))
    return p.select(*_CHUNK, (F.col("at") + F.col("k")).cast("long").alias("pos"), "v")


def bytes_of(numbers: DataFrame) -> DataFrame:
    """``(frame_idx, channel, pos, byte)``: little-endian bytes of 16-bit numbers."""
    u = F.pmod(F.col("v"), F.lit(65536))
    p = numbers.select(*_CHUNK, "pos", F.posexplode(F.array((u % 256).cast("int"), F.floor(u / 256).cast("int"))).alias("k", "byte"))
    return p.select(*_CHUNK, (F.col("pos") * 2 + F.col("k")).alias("pos"), "byte")
