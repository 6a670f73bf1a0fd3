import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.functions import tables
from blockweave.operators import temporal, transform
from blockweave.streaming import encoder


def blocks(spark, rows):
    return spark.createDataFrame(rows, "frame_idx int, channel int, block_id int, px array<double>")


def test_dct_is_the_double_sum_and_comes_back(spark):
    rng = np.random.default_rng(1)
    px = rng.uniform(-128, 127, (5, 64))
    df = blocks(spark, [(i, 0, 0, p.tolist()) for i, p in enumerate(px)]).withColumn("c", transform.dct("px"))
    got = df.withColumn("back", transform.idct("c")).orderBy("frame_idx").collect()
    for r, p in zip(got, px):
        assert np.allclose(r.c, transform.naive_dct(p), atol=1e-9)
        assert np.allclose(r.back, p, atol=1e-9)
        assert np.allclose(transform.naive_idct(np.array(r.c)), p, atol=1e-9)


@pytest.mark.parametrize("q,first", [(1, 255), (10, 80), (49, 16), (50, 16), (51, 16), (75, 8), (99, 1), (100, 1), (0, 255), (500, 1)])
def test_quant_tables(q, first):
    t = tables.quant_table(q)
    assert t[0] == first and min(t) >= 1 and max(t) <= 255
    assert tables.quant_table(100) == [1] * 64


def test_scan_orders_are_inverse():
    assert tables.zigzag()[:6] == [0, 1, 8, 16, 9, 2]
    assert tables.permutation("rank") == tables.inverse(tables.permutation("standard"))
    assert tables.permutation("rank")[:4] == [0, 1, 5, 6]
    with pytest.raises(ValueError):
        tables.permutation("other")


def test_permutation_comes_back(spark):
    df = spark.createDataFrame([(list(range(64)),)], "d array<int>")
    for scan in ("rank", "standard"):
        z = df.select(transform.permute("d", scan).alias("z"))
        assert list(z.first().z) == tables.permutation(scan)
        assert list(z.select(transform.unpermute("z", scan).alias("d")).first().d) == list(range(64))


def flat(v):
    return [128.0 + v / 8] * 64  # a first coefficient of v, at a divisor of 1


def test_exact_and_window_modes_differ_at_ties_only(spark):
    for xs, exact, window in (([1.5, 2.5, 0.5, 2.5], [2, 1, -3, 3], [2, 1, -2, 2]), ([2.5] * 3, [3, -1, 1], [3, 0, 0])):
        df = blocks(spark, [(i, 0, 0, flat(x)) for i, x in enumerate(xs)])
        got = temporal.exact_residual(df, 100).orderBy("frame_idx").collect()
        assert [r.d[0] for r in got] == exact
        c = df.withColumn("px", F.transform("px", lambda v: v - 128)).withColumn("c", transform.dct("px"))
        d = temporal.residual(transform.quantise(c, 100))
        assert [r.d[0] for r in d.orderBy("frame_idx").collect()] == window
        n = temporal.reconstruct(d.drop("n")).orderBy("frame_idx").collect()
        assert [r.n[0] for r in n] == list(np.cumsum(window))


def test_a_stream_gives_the_batch_residuals(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = blocks(spark, [(i, c, b, rng.integers(0, 256, 64).astype(float).tolist()) for i in range(4) for c in range(2) for b in range(2)])
    for i in range(4):
        df.where(F.col("frame_idx") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    c = df.withColumn("px", F.transform("px", lambda v: v - 128)).withColumn("c", transform.dct("px"))
    want = {(r.frame_idx, r.channel, r.block_id): r.d for r in temporal.residual(transform.quantise(c)).collect()}
    out = encoder.residuals(encoder.block_stream(spark, str(tmp_path / "in"), 4))
    q = out.writeStream.format("memory").queryName("residuals").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.frame_idx, r.channel, r.block_id): r.d for r in spark.table("residuals").collect()} == want
