import math
from pathlib import Path

import duckdb
import pytest

from blockweave.plans import catalogue, oracle

SF = Path("/root/testdata/sf0.001")


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([value(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def db():
    if not SF.is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_gives_its_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    want = db.execute(oracle.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_huffman_needs_fewer_bits_than_bytes(spark, db):
    r = catalogue.huffman_ratio(spark, str(SF)).collect()
    assert all(x.coded > 512 for x in r)
    got = {x.doc_id: x.bits for x in catalogue.code_bit_offsets(spark, str(SF)).collect()}
    size = {x[0]: x[1] for x in db.execute("select doc_id, octet_length(encode(text)) from documents where length(text) > 0").fetchall()}
    assert set(got) == set(size) and sum(got.values()) < 8 * sum(size.values())


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
