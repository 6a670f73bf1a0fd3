"""Embedding near-duplicates over a robust-pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components
from .learning import first_by_hash


def unit(v: list | None) -> np.ndarray | None:
    """The vector at length one in double precision; None if it is null, zero or holds null or non-finite numbers."""
    if not v or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    if not np.isfinite(x).all():
        return None
    x = x / (np.abs(x).max() or 1.0)
    n = float(np.sqrt((x * x).sum()))
    return x / n if n else None


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on a bounded sample; a centre that loses its members takes a random vector."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        lost = n[:, 0] < 1e-9
        s[lost], n[lost] = x[rng.choice(len(x), int(lost.sum()))], 1.0
        c = s / np.maximum(n, 1e-12)
    return c


def apart(c: np.ndarray, most: float) -> np.ndarray:
    """Centres without those whose cosine with an earlier one is above ``most``: a crowd of near copies draws many
    centres, and cut up between them it would lose links."""
    keep: list[int] = []
    for i in range(len(c)):
        if not keep or float((c[keep] @ c[i]).max()) <= most:
            keep.append(i)
    return c[keep]


def robust_prune(x: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-links of each node from its candidate pool, nearest first: a candidate goes when a chosen one is
    ``alpha`` times nearer to it than the node is. Rows are padded with -1."""
    own = x[node]
    d = 1 - np.einsum("nd,npd->np", own, x[pool])
    d[pool == node[:, None]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
    d[:, 1:][(pool[:, 1:] == pool[:, :-1])] = np.inf
    out = np.full((len(node), degree), -1, np.int64)
    rows = np.arange(len(node))
    for r in range(degree):
        i = np.argmin(d, axis=1)
        live = np.isfinite(d[rows, i])
        if not live.any():
            break
        picked = pool[rows, i]
        out[live, r] = picked[live]
        to = 1 - np.einsum("nd,npd->np", x[picked], x[pool])
        drop = alpha * to <= d
        drop[rows, i] = True
        d[drop & live[:, None]] = np.inf
    return out


def build(x: np.ndarray, near: int = 48, far: int = 16, degree: int = 24, alpha: float = 1.2, block: int = 512, seed: int = 1) -> np.ndarray:
    """The out-links of one shard: each node's pool is its nearest in the shard and a few random nodes for long links."""
    n = len(x)
    rng = np.random.default_rng(seed)
    near = min(near, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    for s in range(0, n, block):
        node = np.arange(s, min(n, s + block))
        cos = x[node] @ x.T
        cos[np.arange(len(node)), node] = -np.inf
        pool = np.argpartition(-cos, near - 1, axis=1)[:, :near]
        pool = np.concatenate([pool, rng.integers(0, n, (len(node), far))], axis=1)
        pruned = robust_prune(x, node, pool, degree - 4, alpha)
        out[node] = np.concatenate([pruned, pool[:, -4:]], axis=1)
    return out


def range_search(x: np.ndarray, links: np.ndarray, least: float, beam: int = 24, hops: int = 48, block: int = 256, queries: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i <> j, with cosine >= ``least`` that the graph finds for each of the first ``queries`` nodes (all)
    as a query, a block of queries at a time.

    Greedy search from the medoid keeps a beam of the nearest nodes and expands the best one that isn't expanded,
    until the beam stands still. The query's own node is an entry as well. Then the range is expanded: every node
    within range has its links followed, and theirs, until no new node lies in range. Cosines decide, nothing else.
    """
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    back = np.argsort(links.ravel(), kind="stable")
    tail, head = back // links.shape[1], links.ravel()[back]
    tail, head = tail[head >= 0], head[head >= 0]
    start = np.searchsorted(head, np.arange(n + 1))
    most = n if queries is None else queries
    for s in range(0, most, block):
        q = np.arange(s, min(most, s + block))
        m = len(q)
        seen = np.zeros((m, n), bool)
        beam_at = np.full((m, beam), -1, np.int64)
        beam_cos, done = np.full((m, beam), -np.inf), np.ones((m, beam), bool)
        beam_at[:, 0], beam_cos[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        beam_at[:, 1], beam_cos[:, 1], done[:, 1] = q, 1.0, False
        seen[np.arange(m), medoid] = True
        seen[np.arange(m), q] = True
        rows = np.arange(m)
        for _ in range(hops):
            open_cos = np.where(done, -np.inf, beam_cos)
            pick = np.argmax(open_cos, axis=1)
            live = np.isfinite(open_cos[rows, pick])
            if not live.any():
                break
            done[rows[live], pick[live]] = True
            r = rows[live]
            step = links[beam_at[r, pick[live]]]
            fresh = (step >= 0) & ~seen[r[:, None], np.maximum(step, 0)]
            a, b = np.nonzero(fresh)
            seen[r[a], step[a, b]] = True
            cos = np.full(step.shape, -np.inf)
            cos[a, b] = np.einsum("nd,nd->n", x[q[r[a]]], x[step[a, b]])
            all_at = np.concatenate([beam_at[r], step], axis=1)
            all_cos = np.concatenate([beam_cos[r], cos], axis=1)
            all_done = np.concatenate([done[r], ~fresh], axis=1)
            top = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            beam_at[r], beam_cos[r], done[r] = (np.take_along_axis(v, top, 1) for v in (all_at, all_cos, all_done))
        inside = np.zeros((m, n), bool)
        a, b = np.nonzero((beam_cos >= least - 1e-6) & (beam_at >= 0))
        a, b = a, beam_at[a, b]
        inside[a, b] = True
        tried = np.zeros((m, n), bool)
        while len(a):
            # links out of and into the newly found nodes, each (query, node) once
            size = start[b + 1] - start[b]
            into = tail[np.repeat(start[b] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            out = links[b].ravel()
            qa, to = np.concatenate([np.repeat(a, links.shape[1]), np.repeat(a, size)]), np.concatenate([out, into])
            ok = to >= 0
            reach = np.zeros((m, n), bool)
            reach[qa[ok], to[ok]] = True
            qa, to = np.nonzero(reach & ~inside & ~tried)
            tried[qa, to] = True
            near = np.einsum("nd,nd->n", x[q[qa]], x[to]) >= least - 1e-6
            a, b = qa[near], to[near]
            inside[a, b] = True
        i, j = np.nonzero(inside)
        exact = np.einsum("nd,nd->n", x[q[i]], x[j]) >= least
        keep = exact & (q[i] != j)
        yield q[i[keep]], j[keep]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs join it to."""
    label = np.arange(n)
    while len(i):
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == old).all():
            break
    return label


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = [np.frombuffer(v, "<f8") for v in column.to_pylist()]
    x = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        x[i, : len(v)] = v
    return x


def _search_shard(least: float, beam: int):
    def search(t):  # pa.Table to pa.Table
        t = t.sort_by([("core", "descending"), ("node", "ascending")])
        node, x, times = t.column("node").to_numpy(), _matrix(t.column("x")), t.column("times").to_numpy()
        shards, here = np.array(t.column("shards").to_pylist()).reshape(len(node), -1), t.column("shard")[0].as_py()
        core, lists = int(t.column("core").to_numpy(zero_copy_only=False).sum()), t.column("links").to_pylist()
        links = np.full((len(node), max(map(len, lists), default=0) or 1), -1, np.int64)
        place = {int(v): k for k, v in enumerate(node)}
        for k, own in enumerate(lists):
            at = [place[v] for v in own if v in place]
            links[k, : len(at)] = at
        # links found from either end, a bit for each: crowds are gone, so a shard is small
        met, label, cross = np.zeros((core, -(-core // 8)), np.uint8), np.arange(core), []
        for i, j in range_search(x, links, least, beam, queries=core):
            first, inner = np.full(len(i), -1), j < core
            for a in range(shards.shape[1]):
                for b in range(shards.shape[1]):
                    same = shards[i, a] == shards[j, b]
                    first[same] = np.where(first[same] < 0, shards[i, a][same], np.minimum(first[same], shards[i, a][same]))
            far = ~inner & (first < 0)  # met over the border only: told one by one, as other shards find them too
            cross.append(np.stack([node[i[far]], node[j[far]]], 1))
            i, j = i[inner & (first == here)], j[inner & (first == here)]  # a pair that meets in several shards counts in the first
            for a, b in ((i, j), (j, i)):
                np.bitwise_or.at(met, (a, b >> 3), np.uint8(128) >> (b & 7).astype(np.uint8))
            label = label[spanning(core, *(np.concatenate(y) for y in ((i, np.arange(core)), (j, label))))]
        n = np.zeros(core, np.int64)
        for s in range(0, core, 256):
            n[s : s + 256] = np.unpackbits(met[s : s + 256], axis=1, count=core) @ times[:core]
        cross = np.concatenate(cross) if cross else np.zeros((0, 2), np.int64)
        return pa.table({"node": np.concatenate([node[:core], cross[:, 0]]), "n": pa.array([*n.tolist(), *[None] * len(cross)], pa.int64()), "root": np.concatenate([node[:core][label], cross[:, 1]])})

    return search


def centres(nodes: DataFrame, least: float, overlap: int, shard: int, sample: int) -> np.ndarray:
    """Centres of clusters of about ``shard`` nodes, from a bounded sample. Centres nearer to each other than the two ends of a
    link can be are one; it moves to the middle of the crowd around it."""
    count = nodes.count()
    some = _matrix(pa.chunked_array([pa.array([r.x for r in first_by_hash(nodes.select("x", "node"), "node", sample, count).collect()], pa.binary())]))
    if not len(some):
        return np.zeros((1, some.shape[1]))
    c = apart(centroids(some, max(1, min(len(some) // 4, -(-count * overlap // shard)))), 2 * least * least - 1)
    half = np.sqrt((1 + least) / 2)
    for _ in range(4):
        near = np.argmax(some @ c.T, axis=1)
        inner = np.einsum("nd,nd->n", some, c[near]) >= half
        total = np.zeros_like(c)
        np.add.at(total, near[inner], some[inner])
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.maximum(n, 1e-12), c)
    return c


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _dealt(rows: DataFrame, size: str, chunk: int, seed: int) -> DataFrame:
    return rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col(size) / chunk)).cast("int"))


def crowds(nodes: DataFrame, c: np.ndarray, scratch: Scratch, least: float, crowd: int = 64, chunk: int = 2048) -> tuple[DataFrame, DataFrame]:
    """``(node, n, root)`` of all links that have an end in a crowd, exact, and the nodes outside crowds.

    A crowd is ``crowd`` nodes or more within half the angle of a link around a centre: each is linked with each other, which
    takes no comparison. Another node is linked with all of a crowd, or none, if its angle with the centre and the crowd's
    radius say so; else it is compared with the members, in cells of two chunks. Crowds so cost rows, never pairs.
    """
    angle = lambda cos: np.arccos(np.clip(cos, -1, 1))
    width, theta, spare = c.shape[1], float(np.arccos(least)), 1e-6

    def place(batches):
        for b in batches:
            x = _matrix(b.column(1))
            cos = np.where(np.any(x[:, width:] != 0, axis=1)[:, None], -1.0, _fit(x, width) @ c.T)
            at = np.argmax(cos, axis=1) if b.num_rows else np.zeros(0, np.int64)
            a = angle(cos[np.arange(len(at)), at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.where(a <= theta / 2 - spare, at, -1)), pa.array(a)], ["node", "x", "times", "g", "a"])

    placed = scratch.write(nodes.select("node", "x", "times").mapInArrow(place, "node long, x binary, times long, g long, a double"))
    # a row for each centre at most, whose number the sample bounds
    found = placed.where("g >= 0").groupBy("g").agg(F.count("*").alias("n"), F.sum("times").alias("w"), F.max("a").alias("r"), F.min("node").alias("lead")).where(F.col("n") >= crowd).orderBy("g").collect()
    if not found:
        return None, nodes
    ids, weight, radius, lead = (np.array([r[k] for r in found]) for k in ("g", "w", "r", "lead"))
    number = np.full(len(c), -1)
    number[ids] = np.arange(len(ids))
    own_c = c[ids]

    def mark(batches):
        for b in batches:
            x, g, times = _matrix(b.column(1)), b.column(3).to_numpy(), b.column(2).to_numpy()
            g = np.where(g >= 0, number[g], -1)
            phi = angle(_fit(x, width) @ own_c.T) if b.num_rows else np.zeros((0, len(ids)))
            other = np.arange(len(ids))[None, :] > g[:, None]  # two crowds meet from the side of the first one's members
            maybe = other & (phi - radius <= theta + spare)
            sure = maybe & (phi + radius <= theta - spare)
            maybe &= ~sure
            n = sure @ weight + np.where(g >= 0, weight[g] - times, 0)
            list_of = lambda m: pa.array([np.flatnonzero(r).astype(np.int32) for r in m], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(g.astype(np.int32)), pa.array(n.astype(np.int64)), list_of(sure), list_of(maybe)], ["node", "x", "times", "g", "n", "sure", "maybe"])

    marked = scratch.write(placed.mapInArrow(mark, "node long, x binary, times long, g int, n long, sure array<int>, maybe array<int>"))
    leads = F.array(*map(F.lit, lead.tolist()))
    of_lead = lambda g: F.element_at(leads, g + 1)
    credit = {r.s: r.t for r in marked.select(F.explode("sure").alias("s"), "times").groupBy("s").agg(F.sum("times").alias("t")).collect()}
    credits = F.element_at(F.array(*[F.lit(int(credit.get(i, 0))).cast("long") for i in range(len(ids))]), F.col("g") + 1)
    inner = F.col("g") >= 0
    links = marked.where(inner | (F.size("sure") > 0)).select("node", F.when(inner, F.col("n") + credits).otherwise(F.col("n")).alias("n"), F.when(inner, of_lead(F.col("g"))).otherwise(F.col("node")).alias("root"))
    links = links.unionByName(marked.select("node", F.explode("sure").alias("s")).select("node", F.lit(0).cast("long").alias("n"), of_lead(F.col("s")).alias("root")))
    guests = scratch.write(marked.where(F.size("maybe") > 0).select("node", "x", "times", F.explode("maybe").alias("c")))
    sizes = guests.groupBy("c").agg(F.count("*").alias("ng")).join(marked.where(inner).groupBy(F.col("g").alias("c")).agg(F.count("*").alias("nm")), "c")
    sizes = F.broadcast(scratch.write(sizes))  # a row for each crowd
    one = _dealt(guests.join(sizes, "c"), "ng", chunk, 3).select("c", "node", "x", "times", F.lit(True).alias("guest"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("nm") / chunk).cast("int") - 1)).alias("j"))
    two = _dealt(marked.where(inner).withColumnRenamed("g", "c").join(sizes, "c"), "nm", chunk, 4).select("c", "node", "x", "times", F.lit(False).alias("guest"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("ng") / chunk).cast("int") - 1)).alias("i"), F.col("own").alias("j"))

    def compare(t):  # pa.Table to pa.Table
        t = t.sort_by([("guest", "ascending"), ("node", "ascending")])
        node, x, times, guest = t.column("node").to_numpy(), _matrix(t.column("x")), t.column("times").to_numpy(), t.column("guest").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(~guest), np.flatnonzero(guest)
        near = x[a] @ x[b].T >= least
        n = np.concatenate([near @ times[b], times[a] @ near]).astype(np.int64)
        i, j = np.nonzero(near)
        return pa.table({"node": node, "n": n, "root": node[spanning(len(node), a[i], b[j])]})

    links = links.unionByName(one.unionByName(two).groupBy("c", "i", "j").applyInArrow(compare, "node long, n long, root long"))
    return scratch.write(links), marked.where(~inner).select("node", "x", "times")


def links(nodes: DataFrame, c: np.ndarray, scratch: Scratch, least: float, overlap: int, beam: int) -> DataFrame:
    """``(node, n, root)``, a row for each node and shard: links owned by the shard, and the shard's smallest joined node."""
    o, width, reach = min(overlap, len(c)), c.shape[1], 2 * least * least - 1

    def assign(batches):
        for b in batches:
            near = np.sort(np.argpartition(-(_fit(_matrix(b.column(1)), width) @ c.T), o - 1, axis=1)[:, :o], axis=1) if b.num_rows else np.zeros((0, o), np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["node", "x", "times", "shards"])

    def build_shard(t):  # pa.Table to pa.Table
        t = t.sort_by("node")
        node, x = t.column("node").to_numpy(), _matrix(t.column("x"))
        links = build(x)
        near = (np.einsum("nd,nkd->nk", x, x[np.maximum(links, 0)]) >= reach) & (links >= 0) if len(node) else links >= 0
        own = lambda m: pa.array([node[r[k]] for r, k in zip(links, m)], pa.list_(pa.int64()))
        return pa.table({"node": node, "shard": t.column("shard"), "links": own(links >= 0), "near": own(near)})

    placed = scratch.write(nodes.select("node", "x", "times").mapInArrow(assign, "node long, x binary, times long, shards array<int>"))
    rows = placed.select("*", F.explode("shards").alias("shard"))
    built = scratch.write(rows.groupBy("shard").applyInArrow(build_shard, "node long, shard int, links array<bigint>, near array<bigint>"))
    union = scratch.write(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    whole = placed.join(union, "node").select("node", "x", "times", "shards", "links", "near")
    # the united graph crosses the borders of shards: where a list leads out to a vector that may lie within range of a link of the node's, a
    # copy of that vector and its list comes along
    out = whole.select(F.explode("shards").alias("shard"), F.explode("near").alias("node")).distinct()
    border = out.join(whole.drop("near"), "node").where(~F.array_contains("shards", F.col("shard"))).withColumn("core", F.lit(False))
    both = whole.drop("near").withColumn("shard", F.explode("shards")).withColumn("core", F.lit(True)).unionByName(border)
    found = scratch.write(both.groupBy("shard").applyInArrow(_search_shard(least, beam), "node long, n long, root long"))
    pairs = scratch.write(found.where("n is null").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).distinct())
    times = placed.select(F.col("node").alias("b"), "times")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(times, "b")
    return found.where("n is not null").unionByName(ends.select(F.col("a").alias("node"), F.col("times").alias("n"), F.col("b").alias("root")))


def exact_links(nodes: DataFrame, scratch: Scratch, least: float, block: int = 2048) -> DataFrame:
    """``(node, n, root)`` as ``links`` gives it, from all pairs: a cell for each two blocks of nodes."""
    b = max(1, -(-nodes.count() // block))
    rows = nodes.select("node", "x", "times", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(b)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("h"))
    rows = rows.select("node", "x", "times", "g", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("z"))

    def compare(t):  # pa.Table to pa.Table
        t = t.sort_by("node")
        node, x, times, g = t.column("node").to_numpy(), _matrix(t.column("x")), t.column("times").to_numpy(), t.column("g").to_numpy()
        one, two = np.flatnonzero(g == t.column("a")[0].as_py()), np.flatnonzero(g == t.column("z")[0].as_py())
        near = (x[one] @ x[two].T >= least) & (one[:, None] != two[None, :])
        n = np.zeros(len(node), np.int64)
        n[one] = near @ times[two]
        n[two] = near.T @ times[one]
        i, j = np.nonzero(near)
        return pa.table({"node": node, "n": n, "root": node[spanning(len(node), one[i], two[j])]})

    return scratch.write(rows.groupBy("a", "z").applyInArrow(compare, "node long, n long, root long"))


def recall(nodes: DataFrame, counted: DataFrame, least: float, audit: int, crowd: int = 32) -> float:
    """Mean share of a node's links, counted by brute force, that were found: the lower one of nodes in crowds (more
    than ``crowd`` links) and of the others. Of nodes found with no, few and many links ``audit`` each are judged (the
    first by a hash), weighted by how many there are, so neither crowds nor nodes without links hide the others."""
    judged, some, weight = nodes.join(counted, "node").select("node", "x", "n"), [], {}
    for part in (judged.where("n = 0"), judged.where(f"n between 1 and {crowd}"), judged.where(f"n > {crowd}")):
        size = part.count()
        own = first_by_hash(part, "node", audit, size, 9).collect() if size else []
        weight |= {r.node: size / len(own) for r in own}
        some += own
    if not some:
        return 1.0
    q, ids = _matrix(pa.chunked_array([pa.array([r.x for r in some], pa.binary())])), np.array([r.node for r in some])

    def count(batches):
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            x = _matrix(b.column(1))
            w = max(x.shape[1], q.shape[1])
            x, y = (np.pad(v, ((0, 0), (0, w - v.shape[1]))) for v in (x, q))
            near = (y @ x.T >= least) & (ids[:, None] != b.column(0).to_numpy(zero_copy_only=False)[None, :])
            total += near @ b.column(2).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "n"])

    exact = {r.node: r.n for r in nodes.select("node", "x", "times").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    shares = []
    for own in ([r for r in some if 0 < exact[r.node] <= crowd], [r for r in some if exact[r.node] > crowd]):
        if own:
            shares.append(sum(weight[r.node] * min(r.n, exact[r.node]) / exact[r.node] for r in own) / sum(weight[r.node] for r in own))
    return min(shares, default=1.0)


def near_duplicates(
    vectors: DataFrame, least: float = 0.95, shard: int = 1200, sample: int = 20000, beam: int = 24, audit: int = 256, overlaps: tuple[int, ...] = (2, 4, 8)
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors(vec_id, embedding)``.

    Rows with equal unit vectors are one node that remembers how many they are. Crowds, whose members all link with each
    other, are counted as wholes (``crowds``). The other nodes go to their ``overlaps[0]``
    nearest of k centres (spherical k-means on ``sample`` nodes, the first by a hash; about ``shard`` nodes a shard).
    Each shard builds a robust-pruned graph; a node's lists from all its shards are united; each shard then runs a
    range-expanding greedy search for all its nodes, from its medoid and the node itself, over the united graph as far as it can
    lead to a link, also past the shard's border. Only exact cosines make a link. A
    shard returns counts and spanning links, never the pairs inside it. A sample
    of nodes is compared with all nodes; below a recall of 0.9 the next overlap is tried, after the last one all
    pairs are compared. The recall that was measured is logged.

    Vectors that are null, zero or hold null or non-finite components link with nothing: n_links 0, their own
    component, kept. Shorter vectors count as padded with zeros. Repeated rows link with each other, and a null
    vec_id stays (its component is the smallest id it reaches, if any). No rows give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")

    def prepare(batches):
        for b in batches:
            xs = [unit(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else np.trim_zeros(x, "b").astype("<f8").tobytes() for x in xs], pa.binary())], ["vec_id", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")).mapInArrow(prepare, "vec_id long, x binary")
    rows = scratch.write(rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x"))))
    nodes = scratch.write(rows.where("node is not null").groupBy("node").agg(F.min("x").alias("x"), F.count("*").alias("times"), F.min("vec_id").alias("low")))
    dense, plain = crowds(nodes, centres(nodes, least, 1, shard, sample), scratch, least)
    for overlap in overlaps:
        found = links(plain, centres(plain, least, overlap, shard, sample), scratch, least, overlap, beam)
        found = scratch.write(found.unionByName(dense) if dense else found)
        counted = scratch.write(found.groupBy("node").agg(F.sum("n").alias("n")))
        share = recall(nodes, counted, least, audit)
        logging.getLogger(__name__).info("overlap %d: recall %.4f", overlap, share)
        if share >= 0.9:
            break
    else:
        found = exact_links(nodes, scratch, least)
        counted = scratch.write(found.groupBy("node").agg(F.sum("n").alias("n")))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    named = nodes.select("node", "times", "low").join(counted, "node", "left").join(roots, "node", "left")
    named = scratch.write(named.select("node", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "low", F.coalesce("root", "node").alias("root")))
    lowest = scratch.write(named.groupBy("root").agg(F.min("low").alias("component")))
    named = scratch.write(named.join(lowest, "root").select("node", "n_links", "component"))
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def sql(least: float = 0.95, table: str = "embeddings") -> str:
    """All pairs by brute force, in SQL."""
    return f"""
with recursive v as (
  select row_number() over () as i, vec_id, case when len([x for x in embedding if x is null or not isfinite(x)]) = 0 and list_aggregate([abs(x::double) for x in embedding], 'max') > 0 then embedding::double[] end as e from {table}),
l as (select a.i as a, b.i as b from v a join v b on a.i <> b.i and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {least}),
r(a, b) as (select i, i from v union select r.a, l.b from r join l on r.b = l.a),
low as (select r.a as i, min(v.vec_id) as component_id from r join v on v.i = r.b group by r.a),
n as (select a as i, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id::bigint as component_id, coalesce(vec_id = component_id, false) as kept
from v join low using (i) left join n using (i)"""
