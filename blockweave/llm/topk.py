"""Exact top-k inner products over norm-sorted blocks with partial sums and residual bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .learning import first_by_hash

#: Scores of sums below this are exact in double precision.
EXACT = float(1 << 52)
#: Stands for scores below those of 64 bits while better ones may still come.
TOO_LOW = -(1 << 63)


def whole_numbers(v: list | None, scale: int = 64) -> np.ndarray | None:
    """floor(scale * x) of each component, whole numbers in double precision; None if the vector takes no part."""
    if v is None or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(scale * x)
    if not np.isfinite(x).all():
        raise OverflowError(f"a component times {scale} is beyond double precision")
    return x


def _length(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, also where squares leave double precision."""
    most = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    return most[:, 0] * np.sqrt(((x / np.where(most > 0, most, 1)) ** 2).sum(axis=1))


def _products(q: np.ndarray, c: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact inner products, where ``wanted``, of whole numbers: through doubles, or where those aren't exact through wider integers.

    A product above 64 bits is an error, one below becomes ``TOO_LOW``.
    """
    s = q @ c.T
    high_q, high_c = np.abs(q).max(axis=1, initial=0.0), np.abs(c).max(axis=1, initial=0.0)
    wide = ~(np.outer(high_q, high_c) * max(1, q.shape[1]) < EXACT)
    s[wide] = 0
    wide = np.argwhere(wide & wanted)
    s = np.rint(s).astype(np.int64)
    if len(wide):
        a, b = ({i: [int(x) for x in m[i]] for i in set(at.tolist())} for m, at in ((q, wide[:, 0]), (c, wide[:, 1])))
        for i, j in wide.tolist():
            own = sum(x * y for x, y in zip(a[i], b[j]))
            if own >= 1 << 63:
                raise OverflowError("a score is beyond 64 bits")
            s[i, j] = max(own, TOO_LOW)
    return s


class Best:
    """The k highest scores of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int, head: int) -> None:
        self.ids, self.q, self.k, self.head = ids, vectors, k, head
        r = vectors @ rotation
        self.first, self.rest = r[:, :head], _length(r[:, head:])
        self.norm = _length(vectors)
        self.least = np.full(len(ids), -np.inf)
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, c: np.ndarray, rotation: np.ndarray) -> None:
        r = c @ rotation
        norm = _length(c).max(initial=0.0)
        slack = 1e-9 * (1 + self.norm * norm)
        # what isn't known to be too low stays: comparisons are negated, so that numbers that aren't finite prune nothing
        live = np.flatnonzero(~(self.norm * norm + slack < self.least))
        if not len(live) or not len(ids):
            return
        # partial sums over the leading directions; Cauchy-Schwarz bounds what the others can add
        bound = self.first[live] @ r[:, : self.head].T + np.outer(self.rest[live], _length(r[:, self.head :]))
        may = ~(bound + slack[live, None] < self.least[live, None])
        cols = np.flatnonzero(may.any(axis=0))
        if not len(cols):
            return
        may = may[:, cols] & (self.ids[live, None] != ids[cols][None, :])
        s = _products(self.q[live], c[cols], may)
        f = np.where(may, s.astype(np.float64), -np.inf)
        if f.shape[1] > self.k:
            f_k = -np.partition(-f, self.k - 1, axis=1)[:, self.k - 1]
        else:
            f_k = np.full(len(live), -np.inf)
        row, col = np.nonzero(may & (f >= np.maximum(f_k, self.least[live])[:, None]))
        self.row, self.id, self.score = (np.concatenate(x) for x in ((self.row, live[row]), (self.id, ids[cols[col]]), (self.score, s[row, col])))
        order = np.lexsort((self.id, ~self.score, self.row))
        row = self.row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        order = order[nth < self.k]
        self.row, self.id, self.score = self.row[order], self.id[order], self.score[order]
        row, n = np.unique(self.row, return_counts=True)
        full = row[n == self.k]
        self.least[full] = self.score[np.cumsum(n)[n == self.k] - 1]

    def table(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], ["query_id", "vec_id", "score"])


def _blocks(rows: DataFrame, size: int, n: int, width: int) -> DataFrame:
    """Rows by descending length in blocks of at most ``size``: (block, top, ids, v), v a matrix ``width`` wide."""

    def run(batches):
        part, ids, vs, top, k = TaskContext.get().partitionId(), [], [], 0.0, 0

        def block():
            m = np.zeros((len(vs), width))
            for i, v in enumerate(vs):
                m[i, : len(v) // 8] = np.frombuffer(v, "<f8")
            return pa.RecordBatch.from_arrays([pa.array([part << 20 | k]), pa.array([top]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["block", "top", "ids", "v"])

        for b in batches:
            for i, norm, v in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                vs.append(v)
                top = max(top, norm)
                if len(ids) == size:
                    yield block()
                    ids, vs, top, k = [], [], 0.0, k + 1
        if ids:
            yield block()

    spread = rows.select("vec_id", "norm", "v").repartitionByRange(max(1, -(-n // size)), F.desc("norm"), "vec_id")
    return spread.sortWithinPartitions(F.desc("norm"), "vec_id").mapInArrow(run, "block long, top double, ids binary, v binary")


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, query_block: int = 4096, block: int = 4096, part: int = 512, strips: int = 8, head: int = 16, sample: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest integer inner products of each query with all other rows.

    Vectors are cut by descending length into blocks. A task holds one block of queries and streams the blocks
    of one strip (every ``strips``-th block) from the longest to the shortest: a block whose greatest length can't
    reach any query's k-th score is passed over; inside a block, ``part`` rows at a time, the leading directions of an SVD (fitted on
    ``sample`` vectors, the first by a hash; it steers pruning, not results) give partial sums, and lengths of the
    remainders bound the rest; survivors get exact integer products. Ties at the bound are kept. Strips' results,
    ``k`` for each query, are ranked together. Memory is two blocks for each task and one part's products.

    Vectors that are null or hold null or non-finite components take no part; all others do, however long. Products
    beyond the exact range of doubles are computed in wider integers; a score among the k highest that doesn't fit 64
    bits is an error, and so is a component that leaves double precision when scaled. Vectors of different lengths meet on
    their common components. Rows that share a query's vec_id are its own; a repeated query id searches with its
    smallest vector; repeated rows are candidates each. Null ids take no part; other columns are not read; no rows give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")

    def prepare(batches):
        for b in batches:
            vs = [whole_numbers(v, scale) for v in b.column(1).to_pylist()]
            keep = [i for i, v in enumerate(vs) if v is not None]
            norms = [float(_length(vs[i][None, :])[0]) for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(norms, pa.float64()), pa.array([vs[i].astype("<f8").tobytes() for i in keep], pa.binary())], ["vec_id", "norm", "v"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).where("vec_id is not null")
    rows = scratch.write(rows.mapInArrow(prepare, "vec_id long, norm double, v binary"))
    queries = scratch.write(rows.where(is_query).groupBy("vec_id").agg(F.min("norm").alias("norm"), F.min("v").alias("v")).select("vec_id", F.col("norm"), "v"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
    m, width = queries.count(), width // 8
    some = [np.frombuffer(r.v, "<f8") for r in first_by_hash(rows.select("v", "vec_id"), "vec_id", sample, n).collect()]
    x = np.zeros((max(1, len(some)), width))
    for i, v in enumerate(some):
        x[i, : len(v)] = v
    x /= np.abs(x).max(initial=0.0) or 1.0
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy() if width else np.zeros((0, 0))
    c = scratch.write(_blocks(rows, block, n, width))
    q = scratch.write(_blocks(queries, query_block, m, width))
    ids = q.select(F.col("block").alias("q"))
    each = F.explode(F.array(*map(F.lit, range(strips))))
    ids = scratch.write(ids.agg(F.sort_array(F.collect_list("q")).alias("qs")).select(each.alias("strip"), "qs"))
    strip = F.pmod(F.xxhash64("block"), F.lit(strips)).cast("int")
    # every block of candidates goes to every block of queries: the stated query set against all rows, in blocks
    cells = c.withColumn("strip", strip).join(F.broadcast(ids), "strip").select(F.explode("qs").alias("q"), "strip", "top", "ids", "v")
    heads = q.select(F.col("block").alias("q"), each.alias("strip"), F.lit(None).cast("double").alias("top"), "ids", "v")
    cells = cells.unionByName(heads).repartition(max(1, -(-m // query_block)) * strips, "q", "strip").sortWithinPartitions("q", "strip", F.desc_nulls_first("top"))

    def run(batches):
        best = None
        for b in batches:
            for top, i, v in zip(*(col.to_pylist() for col in b.columns[2:])):
                at = np.frombuffer(i, "<i8")
                if top is None:
                    if best:
                        yield best.table()
                    best = Best(at, np.frombuffer(v, "<f8").reshape(len(at), width), rotation, k, head)
                elif not (best.norm * top * (1 + 1e-9) + 1e-9 < best.least).all():
                    c = np.frombuffer(v, "<f8").reshape(len(at), width)
                    for s in range(0, len(at), part):
                        best.add(at[s : s + part], c[s : s + part], rotation)
        if best:
            yield best.table()

    found = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    fits = F.when(F.col("score") > F.lit(TOO_LOW), F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond 64 bits")).cast("long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", fits.alias("score"))


def sql(k: int = 20, scale: int = 64, every: int = 20, table: str = "embeddings") -> str:
    return f"""
with v as (
  select vec_id, [floor({scale} * x::double) for x in embedding] as c from {table}
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.c, v.c)::bigint as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % {every} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= {k}"""
