import numpy as np
import pytest

from blockweave.llm import topk


def brute(rows, k, scale=64):
    vs = [(i, topk.whole_numbers(v, scale)) for i, v in rows]
    vs = [(i, v) for i, v in vs if v is not None and i is not None]
    out = []
    for q, v in sorted({i: v for i, v in vs if i % 20 == 0}.items()):
        s = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in vs if i != q)[:k]
        out += [(q, n + 1, i, -m) for n, (m, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("block,query_block,strips", [(7, 3, 2), (4096, 512, 8)])
def test_against_all_pairs(spark, block, query_block, strips):
    rng = np.random.default_rng(4)
    lengths = rng.uniform(0.01, 30, 150)
    rows = [(i, (rng.normal(size=8) * lengths[i]).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(300, None), (320, [1.0, None]), (340, [float("nan")] * 8), (360, [float("inf")] + [0.0] * 7), (380, []), (400, [0.5, 0.25]), (None, [1.0] * 8), (420, [0.0] * 8), (440, [1e9] * 8), (460, [1e5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as norm", "2 as block")
    got = topk.search(df, "vec_id % 20 = 0", k=5, block=block, query_block=query_block, strips=strips, head=3, sample=50).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_long_vectors_take_part(spark):
    rows = [(0, [1e8, 0.0]), (20, [1.0, 1.0]), (21, [2.0, 1.0]), (40, [0.0, -1e15]), (41, [1e15, 2.0]), (42, [-1e30, 0.0]), (60, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, "vec_id % 20 = 0 and vec_id <> 0", k=3, block=2, strips=2).collect()
    want = [r for r in brute(rows, 3) if r[0]]
    assert sorted(map(tuple, got)) == want and (20, 1, 41, 64 * 64 * (10**15 + 2)) in want
    # 64e8 * 64e15 is beyond 64 bits: never a wrong score
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, "vec_id = 0", k=3, block=2, strips=2).collect()


def test_scores_at_the_edge_of_64_bits(spark):
    rows = [(0, [float(2**19), 1 / 64]), (1, [float(2**31 - 1), 63.0]), (2, [float(2**31 - 1), 62.0]), (3, [-(2.0**32), 0.0]), (4, [float(2**31 - 2), 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, "vec_id = 0", k=3).collect()]
    assert got == brute(rows, 3) and got[0][3] > 2**61


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, "vec_id % 20 = 0").collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.search(df.where("vec_id > 5"), "vec_id % 20 = 0").count() == 0
