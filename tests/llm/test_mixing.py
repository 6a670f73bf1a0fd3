import random

import duckdb
import pytest

from blockweave.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(seed, n=400, sources=("b", "a", None, "é", "z", "empty")):
    r = random.Random(seed)
    return [(i, "" if s == "empty" else " ".join(["w"] * r.choice([0, 1, 3, 40, 400])) if i % 7 else None, "en", s, 0) for i, s in ((i, r.choice(sources)) for i in range(n))]


def water(sizes):
    """Targets by repeated resharing."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken_words(spark, seed):
    rows = rows_of(seed) + [(5, "same words", "en", "a", 0), (5, "same words", "en", "a", 0), (None, "x y", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    taken, by_size = {}, {}
    for r in out:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size <= 3 * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r)
    assert {k[1] for k in by_size} == {round(v, 6) for v in want.values()}
    for (size, target), own in by_size.items():
        taken = sum(r.taken for r in own)
        assert abs(taken - target) <= 3 * 400 + 0.02 * target
    duckdb.sql("create or replace temp table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    duckdb.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    key = lambda r: repr((r[0] is None, r))
    assert sorted(duckdb.sql(mixing.sql()).fetchall(), key=key) == sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out), key=key)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, None, "en", None, 0)], SCHEMA)).first()
    assert (one.size, one.target, one.taken) == (0, 0.0, 0)
