"""What the trained operators share: which rows may teach, and bounded samples of them brought to the driver."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def first_by_hash(rows: DataFrame, key: str, most: int, n: int, seed: int = 11) -> DataFrame:
    """The ``most`` rows of ``n`` with the smallest hashes of ``key``; each row is as likely, and reruns agree.

    Of many rows only those whose hash is in the share that holds four times as many are sorted at all, so
    neither one task nor the driver sees more than a few times ``most`` rows, however many there are.
    """
    h, space = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)), 1 << 30
    if n > 4 * most:
        rows = rows.where(h < max(1, space * 4 * most // n))
    return rows.orderBy(h, key).limit(most)


def by_hash(ids: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """At most ``most`` distinct doc_ids."""
    ids = ids.select("doc_id").where("doc_id is not null").distinct()
    return first_by_hash(ids, "doc_id", most, ids.count(), seed)


def sample_features(docs: DataFrame, ids: DataFrame, features: Callable[[str | None], list[int]], scratch: Scratch, number: pa.DataType = pa.int64()) -> pa.Table:
    """``(doc_id, kind, x)`` of the documents named by the bounded table ``ids(doc_id, kind)``, one row for each id.

    The ids, whose number a parameter bounds, are broadcast; features are made where the text is; only their
    numbers, of the type ``number``, reach the driver. A doc_id on several rows gives the smallest list of features.
    """

    def run(batches):
        for b in batches:
            x = pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(number))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["doc_id", "kind", "x"])

    ids = scratch.write(ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.select("doc_id", "kind", "text").mapInArrow(run, f"doc_id long, kind int, x array<{'int' if number == pa.int32() else 'bigint'}>")
    return rows.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).orderBy("doc_id", "kind").toArrow()


def arrays(column: pa.ChunkedArray) -> list:
    """A column of lists as numpy arrays that share one buffer; no number becomes an object."""
    out = []
    for chunk in column.chunks:
        flat, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    return out
