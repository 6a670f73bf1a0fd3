import pytest
from pyspark.sql import functions as F

from blockweave.functions import scalars
from blockweave.operators import metrics
from blockweave.sources import profiles


def test_tolerant_numbers(spark):
    cases = {"12,5": 12.5, '"7"': 7.0, " 3.25 ": 3.25, "1,234.5": 0.0, "": 0.0, "n/a": 0.0, "1d": 0.0, "1_0": 0.0, "-2e3": -2000.0, None: 0.0}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want double")
    assert df.where(scalars.parse_float(F.col("s")) != F.col("want")).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("frame10.png",), ("f2_30",), ("none",)], "s string")
    assert [int(r[0]) for r in df.select(scalars.first_number(F.col("s"))).collect()] == [10, 2, -1]
    assert df.select(scalars.display_name(F.col("s"))).first()[0] == "frame10.png".ljust(25)


def test_profile_file(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text('﻿"Function Name","Duration [us]","# Registers [register/thread]"\nk1,"12,5",32\nFunction Name,x,y\n,1,1\nk1,7.5,40.9\nk2,100,8\n', encoding="utf-8")
    got = metrics.profile_summary(metrics.profile(profiles.read_profile(spark, str(f)))).collect()
    assert [(r.fn, r.calls, r.avg_duration, r.avg_compute, r.registers) for r in got] == [("k2", 1, 100.0, 0.0, 8), ("k1", 2, 10.0, 0.0, 40)]


def test_timings(spark):
    df = spark.createDataFrame([("Serial", 1, 4.0), ("CUDA", 1, 1.0), ("CUDA", 2, None), ("OpenMP", 1, 2.0)], "backend string, run int, seconds double")
    s = metrics.timing_summary(df)
    assert {r.backend: r.speedup for r in metrics.speedup(s, "Serial").collect()} == {"Serial": 1.0, "CUDA": 4.0, "OpenMP": 2.0}
    assert {r.speedup for r in metrics.speedup(s, "none").collect()} == {None}
    assert [r.backend for r in metrics.in_order(s, ["Serial", "OpenMP", "CUDA"]).collect()] == ["Serial", "OpenMP", "CUDA"]


def test_psnr(spark):
    df = spark.createDataFrame([(0.0,), (65025.0,)], "m double")
    assert [r[0] for r in df.select(metrics.psnr(F.col("m"))).collect()] == [float("inf"), pytest.approx(0.0)]
