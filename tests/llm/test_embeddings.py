import itertools
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from blockweave.llm import embeddings


def brute(rows):
    xs = [embeddings.unit(v) for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = [0] * len(rows)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if xs[i] is not None and xs[j] is not None and len(xs[i]) == len(xs[j]) and float(xs[i] @ xs[j]) >= 0.95:
            n[i] += 1
            n[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    low = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    return sorted(((v, n[i], low.get(find(i)), v is not None and v == low.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)


def clouds(n=300, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 16))
    rows = [(i, b.tolist()) for i, b in enumerate(base)]
    for i in range(n // 3, n):
        b = base[rng.integers(0, 20)] if i % 3 else base[rng.integers(0, len(base))]
        rows.append((i, ((b + rng.normal(size=16) * 0.08) * rng.uniform(0.1, 9)).tolist()))
    return rows


@pytest.mark.parametrize("shard", [1200, 60])
def test_against_all_pairs(spark, shard):
    rows = clouds()
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, []), (1005, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (1006, [1e300] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as node", "3 as label")
    got = sorted(map(tuple, embeddings.near_duplicates(df, shard=shard).collect()), key=repr)
    want = brute(rows)
    found, real = sum(r[1] for r in got), sum(r[1] for r in want)
    assert real >= found >= 0.97 * real
    if shard == 1200:
        assert got == want


def test_search_finds_what_a_matrix_finds():
    x = np.array([embeddings.unit(v) for _, v in clouds(900, 5)])
    i, j = map(np.concatenate, zip(*embeddings.range_search(x, embeddings.build(x), 0.95)))
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.95)) if a != b}
    got = set(zip(i.tolist(), j.tolist()))
    assert got <= want and len(got) >= 0.98 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(one).collect())) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_a_crowd_hides_no_lost_links(spark):
    rng = np.random.default_rng(3)
    pairs = np.repeat(rng.normal(size=(60, 32)), 2, axis=0)
    x = np.concatenate([rng.normal(size=32) + 1e-3 * rng.normal(size=(120, 32)), pairs + 1e-3 * rng.normal(size=(120, 32))])
    rows = [(i, embeddings.unit(v).astype("<f8").tobytes(), 1, 119 if i < 120 else i % 4 // 2) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "node long, x binary, times long, n long")
    assert embeddings.recall(df.drop("n"), df.select("node", "n"), 0.95, 256) == 0.5


def test_all_pairs_when_no_overlap_is_enough(spark, monkeypatch):
    rows = clouds()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embeddings, "recall", lambda *_: 0.5)
    exact = embeddings.exact_links
    monkeypatch.setattr(embeddings, "exact_links", lambda n, s, least: exact(n, s, least, 70))
    got = sorted(map(tuple, embeddings.near_duplicates(df, shard=20, overlaps=(1,)).collect()), key=repr)
    assert got == brute(rows)


def test_crowds_against_all_pairs(spark):
    """Tight crowds, two that touch, guests at every angle, many small groups, repeated vectors."""
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v)
    base = [unit(rng.normal(size=24)) for _ in range(3)]
    base.append(unit(base[0] + 0.3 * unit(rng.normal(size=24))))
    rows = [unit(b + 0.018 * rng.normal(size=24)) for b in base for _ in range(130)]
    rows += [unit(b + t * unit(rng.normal(size=24))) for b in base for t in np.linspace(0.02, 0.6, 60)]
    for _ in range(60):
        b = rng.normal(size=24)
        rows += [b + 0.03 * rng.normal(size=24) for _ in range(3)]
    rows = [(i, (v * rng.uniform(0.5, 3)).tolist()) for i, v in enumerate(rows)]
    rows += [(5000 + i, rows[i][1]) for i in (0, 1, 200, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    got = sorted(map(tuple, embeddings.near_duplicates(df, shard=150).collect()), key=repr)
    assert sum(r[1] for r in want) >= sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want)
    crowded = {i for i, *_ in rows if i < 520 or i >= 5000}
    assert [r for r in got if r[0] in crowded] == [r for r in want if r[0] in crowded]
    duckdb.sql("create or replace temp table embeddings (vec_id bigint, embedding double[])")
    duckdb.executemany("insert into embeddings values (?, ?)", rows[:60] + rows[-40:] + [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24)])
    part = rows[:60] + rows[-40:] + [(9000, None), (9001, [0.0] * 24), (9002, [float("nan")] * 24)]
    assert sorted(duckdb.sql(embeddings.sql()).fetchall(), key=repr) == brute(part)


def test_a_crowd_of_many_is_counted_in_little_time(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16) * 10
    x = base + 0.2 * rng.normal(size=(20000, 16))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20000), "embedding": x.tolist()}))
    began = time.perf_counter()
    out = embeddings.near_duplicates(df).agg({"n_links": "min", "component_id": "max"}).first()
    assert tuple(out) in ((0, 19999), (19999, 0)) and time.perf_counter() - began < 90
