"""SimHash near-duplicate detection with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch, bounded
from .components import connected_components

BITS = 64
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """Majority of the bits of all k-word shingles' XXH64, repeats counted; no word: 0; fewer than k: one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < k:
        hashes = [h(b" ".join(words), seed)]
    elif k == 3:
        hashes = [h(b"%b %b %b" % x, seed) for x in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(words[i : i + k]), seed) for i in range(len(words) - k + 1)]
    octets = np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, positions: list[int] | None = None) -> list[int]:
    """Masks such that any two words that differ in at most ``radius`` of ``positions`` agree under some mask.

    Position i gets a non-zero vector m(i) of radius+1 bits; the mask of v holds the positions with <m(i), v> = 1.
    For any set of at most ``radius`` positions some non-zero v is orthogonal to all their m(i).
    """
    n = (1 << (radius + 1)) - 1
    at = range(BITS) if positions is None else positions
    return [sum(1 << p for i, p in enumerate(at) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fps: np.ndarray, radius: int, block: int = 1024) -> np.ndarray:
    """Spanning links of the components among distinct fingerprints, by exact comparison in blocks."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for s in range(0, len(fps), block):
        for t in range(s, len(fps), block):
            near = np.bitwise_count(fps[s : s + block, None] ^ fps[None, t : t + block]) <= radius
            for i, j in zip(*np.nonzero(near)):
                a, b = find(s + i), find(t + j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((s + i, t + j))
    return np.array(out, np.int64).reshape(-1, 2)


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs(doc_id, text)``; fp as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k, seed) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def candidate_links(distinct: DataFrame, scratch: Scratch, radius: int = 2, direct: int = 4096) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints that join all pairs within ``radius`` into components.

    Table v holds each fingerprint under its bits in mask v. A bucket of up to ``direct`` fingerprints is
    compared in blocks. A larger one is dealt out again by a covering of the bits that its mask leaves open:
    a second-level bucket has at most 12 open bits (radius 2), so 4,096 distinct fingerprints at most.
    Buckets with one fingerprint never leave the count.
    """
    masks = covering_masks(radius)
    spread = F.explode(F.array(*[F.struct(F.lit(v).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)]))
    rows = distinct.select("fp", spread.alias("x")).select("fp", "x.tab", "x.key", F.lit(-1).alias("sub"))
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = scratch.write(sizes)
    rows = scratch.write(rows.join(sizes, ["tab", "key"]))
    small, large = rows.where(F.col("n") <= direct), rows.where(F.col("n") > direct)
    finer = [covering_masks(radius, [p for p in range(BITS) if not m >> p & 1]) for m in masks]
    sub_masks = F.array(*[F.array(*[F.lit(_signed(m | f)) for f in fs]) for m, fs in zip(masks, finer)])
    again = large.select("fp", "tab", "n", F.posexplode(sub_masks[F.col("tab")]).alias("sub", "sub_mask"))
    again = again.select("fp", "tab", F.col("fp").bitwiseAND(F.col("sub_mask")).alias("key"), "sub", "n")
    buckets = small.select("fp", "tab", "key", "sub", "n").unionByName(again)

    def compare(t):  # pa.Table to pa.Table; the kind of function is told from its arguments
        fps = np.unique(t.column("fp").to_numpy())
        ends = _links(fps.view(np.uint64), radius)
        return pa.table({"a": pa.array(fps[ends[:, 0]], pa.int64()), "b": pa.array(fps[ends[:, 1]], pa.int64())})

    return buckets.select("fp", "tab", "key", "sub").groupBy("tab", "key", "sub").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs(doc_id, text)``.

    Rows with the same fingerprint are one vertex, so a group of copies of any size costs one vertex and no pair.
    Null and empty texts have fingerprint zero and link like any other; repeated rows stay rows; a null doc_id is
    kept and never is a component's id unless the component has no other; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(docs, k, seed))
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = scratch.write(candidate_links(distinct, scratch, radius).distinct())
    roots = connected_components(edges, scratch)
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    member = scratch.write(member)
    lowest = scratch.write(member.groupBy("root").agg(F.min("low").alias("component_id")))
    vertex = scratch.write(member.join(lowest, "root").select("fp", "component_id"))
    out = rows.join(vertex, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, k: int = 5, seed: int = 42) -> np.ndarray:
    """The XXH64 of each distinct k-word shingle, ascending; fewer than k words are one shingle, no word none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[i : i + k]), seed) for i in range(max(1, len(words) - k + 1))], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def wide_fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits, as two signed numbers: the majority of the bits of a shingle set's hashes, and of the hashes mixed once more."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        m = s * np.uint64(0x9E3779B97F4A7C15)
        m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
    ones = np.unpackbits(np.stack([s, m], 1).astype("<u8").view(np.uint8).reshape(len(s), 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    a, b = np.packbits(2 * ones > len(s), bitorder="little").view("<i8")
    return int(a), int(b)


def block_tables(blocks: int = 6, radius: int = 3) -> list[tuple[int, int]]:
    """The masks, over 128 bits in two words, of a covering of each of ``blocks`` equal blocks of bits.

    Two fingerprints that differ in fewer than blocks * (radius + 1) bits differ in at most ``radius`` bits of some
    block, and agree under some mask of its covering.
    """
    cuts = [round(128 * i / blocks) for i in range(blocks + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        n = (1 << (radius + 1)) - 1
        for v in range(1, n + 1):
            m = sum(1 << p for i, p in enumerate(range(a, b)) if bin((1 + i % n) & v).count("1") % 2)
            out.append((m & (1 << 64) - 1, m >> 64))
    return out


#: What a table holds of a text: fingerprint, name, component, number of shingles.
ENTRY = np.dtype([("f", "<u8"), ("g", "<u8"), ("v", "<i8"), ("root", "<i8"), ("size", "<i4")])
#: The same and its chunk.
PLACED = np.dtype([*ENTRY.descr, ("part", "<i8")])


def _keys(f: np.ndarray, g: np.ndarray, mask: tuple[int, int]) -> np.ndarray:
    """The masked bits, mixed to one number; a block is short enough for it to be one to one in all but rare cases."""
    with np.errstate(over="ignore"):
        x = (f & np.uint64(mask[0])) * np.uint64(0x9E3779B97F4A7C15) + (g & np.uint64(mask[1])) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def close_pairs(e: np.ndarray, key: np.ndarray, most_bits: int, least: float, chunk: int = 256):
    """(i, j, distance) of entries with equal keys, different components and a distance of at most ``most_bits``.

    Sets whose sizes alone rule out a similarity of ``least`` aren't compared, nor are members of the component that is
    the most frequent one under a key with each other; so a crowd that is joined already costs rows, never pairs.
    """
    order = np.lexsort((e["size"], key))
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for s, t in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order)]])):
        if t - s < 2:
            continue
        own = order[s:t]
        own_root = e["root"][own]
        name, at = np.unique(own_root, return_inverse=True)
        if len(name) < 2:
            continue
        outside = np.flatnonzero(at != np.argmax(np.bincount(at)))
        f, g, size = e["f"][own], e["g"][own], e["size"][own]
        for k in range(0, len(outside), chunk):
            i = outside[k : k + chunk]
            # sizes ascend: partners lie between the least and the greatest size that may be similar enough
            lo, hi = np.searchsorted(size, np.floor(least * size[i[0]])), np.searchsorted(size, np.ceil(size[i[-1]] / least), "right")
            far = np.bitwise_count(f[i, None] ^ f[None, lo:hi]) + np.bitwise_count(g[i, None] ^ g[None, lo:hi])
            a, b = np.nonzero((far <= most_bits) & (own_root[i, None] != own_root[None, lo:hi]))
            if len(a):
                yield own[i[a]], own[b + lo], far[a, b]


def merged(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label``, the smallest member of each node's group, after the links x-y: groups hook to the smallest they meet."""
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        label = label.copy()
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def _cells(vertices: DataFrame, tables: list[tuple[int, int]], kind: np.dtype, cell: int = 32768) -> DataFrame:
    """``(cell, e)``: the ``kind`` of entry of all vertices, once in each table, as packed bytes.

    A cell holds a share of a table's keys, about ``cell`` entries.
    """
    shares = max(1, -(-vertices.count() // cell))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = np.zeros(b.num_rows, kind)
            for i, name in enumerate(kind.names):
                e[name] = b.column(i).to_numpy().view("<u8") if i < 2 else b.column(i).to_numpy()
            for n, mask in enumerate(tables):
                part = (_keys(e["f"], e["g"], mask) >> np.uint64(33)) % np.uint64(shares)
                order = np.argsort(part, kind="stable")
                at, first = np.unique(part[order], return_index=True)
                packed = [x.tobytes() for x in np.split(e[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64) * len(tables) + n), pa.array(packed, pa.binary())], ["cell", "e"])

    return vertices.select(*kind.names).mapInArrow(deal, "cell long, e binary")


def _first_met(e: np.ndarray, n: int, tables: list[tuple[int, int]], most_bits: int, least: float, most: int = 1 << 18):
    """(i, j) of the close pairs of a cell of table ``n``, some ``most`` at a time, but for those that an earlier table brings together."""

    def new(found: list) -> tuple[np.ndarray, np.ndarray]:
        i, j = map(np.concatenate, zip(*found))
        for m, h in tables[:n]:
            if not len(i):
                break
            apart = ((e["f"][i] ^ e["f"][j]) & np.uint64(m) | (e["g"][i] ^ e["g"][j]) & np.uint64(h)) != 0
            i, j = i[apart], j[apart]
        return i, j

    found, total = [], 0
    for i, j, _ in close_pairs(e, _keys(e["f"], e["g"], tables[n]), most_bits, least):
        found.append((i, j))
        total += len(i)
        if total >= most:
            yield new(found)
            found, total = [], 0
    if found:
        yield new(found)


def _opened(t: pa.Table, tables: list[tuple[int, int]], kind: np.dtype) -> tuple[np.ndarray, int]:
    """The entries of a cell and its table's number."""
    return np.concatenate([np.frombuffer(x, kind) for x in t.column("e").to_pylist()]), t.column("cell")[0].as_py() % len(tables)


def _meetings(vertices: DataFrame, tables: list[tuple[int, int]], most_bits: int, least: float) -> DataFrame:
    """``(a, b)``: links that join all components of ``vertices(v, f, g, root, size)`` with candidate pairs in a cell.

    A cell hands out one row at most for each component in it, however many pairs meet, and none for pairs that met in an earlier table.
    """

    def meet(t):  # pa.Table to pa.Table; the kind of function is told from its arguments
        e, n = _opened(t, tables, ENTRY)
        name, at = np.unique(e["root"], return_inverse=True)
        label = np.arange(len(name))
        for i, j in _first_met(e, n, tables, most_bits, least):
            label = merged(label, at[i], at[j])
        linked = np.flatnonzero(label != np.arange(len(name)))
        return pa.table({"a": name[label[linked]], "b": name[linked]})

    return _cells(vertices, tables, ENTRY).groupBy("cell").applyInArrow(meet, "a long, b long")


def _thinned(links: DataFrame, scratch: Scratch, each: int = 1 << 18) -> DataFrame:
    """``(a, b)``: of each ``each`` or so of ``links(a, b)`` as many as join the same nodes; cells repeat what other cells found."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if found:
            a, b = map(np.concatenate, zip(*found))
            name, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = merged(np.arange(len(name)), at[: len(a)], at[len(a) :])
            linked = np.flatnonzero(label != np.arange(len(name)))
            yield pa.RecordBatch.from_arrays([pa.array(name[label[linked]], pa.int64()), pa.array(name[linked], pa.int64())], ["a", "b"])

    links = scratch.write(links.select("a", "b"))
    return links.coalesce(max(1, -(-links.count() // each))).mapInArrow(thin, "a long, b long")


def _places(members: DataFrame, tables: list[tuple[int, int]], most_bits: int, least: float) -> DataFrame:
    """``(v, x, y)``: the pairs of chunks, x <= y, in which each of ``members(v, f, g, root, size, part)`` has a candidate.

    So a text goes to as many tasks as chunks that hold candidates for it, whether its cluster is dense or a loose chain.
    """

    def meet(t):  # pa.Table to pa.Table; the kind of function is told from its arguments
        e, n = _opened(t, tables, PLACED)
        name, at = np.unique(e["part"], return_inverse=True)
        seen = [np.zeros(0, np.int64)]
        for i, j in _first_met(e, n, tables, most_bits, least):
            pair = np.minimum(at[i], at[j]) * len(name) + np.maximum(at[i], at[j])
            seen.append(np.unique(np.concatenate([pair * len(e) + i, pair * len(e) + j])))
            if sum(map(len, seen)) > 1 << 22:
                seen = [np.unique(np.concatenate(seen))]
        code = np.unique(np.concatenate(seen))
        pair, first = np.unique(code // max(len(e), 1), return_index=True)
        packed = [e["v"][x % len(e)].tobytes() for x in np.split(code, first[1:])] if len(code) else []
        return pa.table({"x": name[pair // max(len(name), 1)], "y": name[pair % max(len(name), 1)], "vs": pa.array(packed, pa.binary())})

    def unite(t):  # pa.Table to pa.Table; the kind of function is told from its arguments
        v = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in t.column("vs").to_pylist()]))
        return pa.table({"v": v, "x": np.full(len(v), t.column("x")[0].as_py()), "y": np.full(len(v), t.column("y")[0].as_py())})

    met = _cells(members, tables, PLACED).groupBy("cell").applyInArrow(meet, "x long, y long, vs binary")
    return met.groupBy("x", "y").applyInArrow(unite, "v long, x long, y long")


def _chunks(state: DataFrame, clusters: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """``(v, f, g, root, size, part, whole)`` of the texts whose component is in ``clusters(node, root)``.

    Clusters of up to ``chunk`` texts share a part, undivided (``whole``). A larger one is dealt out in parts of that size, its
    largest component apart from the others: members of that one are never compared with each other.
    """
    of = clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    rows = scratch.write(state.select("v", "f", "g", "root", "size").join(of, "root"))
    per = rows.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    per = per.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    per = scratch.write(per)
    shares = max(1, -(-rows.count() // chunk))
    inner = F.col("root") == F.col("main")
    parts = F.greatest(F.lit(1), F.ceil(F.when(inner, F.col("inside")).otherwise(F.col("n") - F.col("inside")) / chunk))
    own = F.xxhash64("cluster", inner, F.pmod(F.xxhash64("v", F.lit(3)), parts))
    whole = F.col("n") <= chunk
    part = F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(shares))).otherwise(own)
    return scratch.write(rows.join(per, "cluster").select("v", "f", "g", "root", "size", part.alias("part"), whole.alias("whole")))


def _exact(places: DataFrame, members: DataFrame, sets: DataFrame, most_bits: int, least: float) -> DataFrame:
    """``(a, b)``: links that join all pairs of at least ``least`` of different components that meet in one of
    ``places(v, x, y)``, compared by their ``sets(v, s)``. A task holds two chunks; only spanning links leave it.
    """

    def compare(t):  # pa.Table to pa.Table; the kind of function is told from its arguments
        t = t.sort_by("v")
        v, root, size, part = (t.column(c).to_numpy() for c in ("v", "root", "size", "part"))
        f, g = (t.column(c).to_numpy().view(np.uint64) for c in ("f", "g"))
        x, y = (t.column(c)[0].as_py() for c in ("x", "y"))
        sets = [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()]
        known = np.unique(np.concatenate(sets))
        ids = [np.searchsorted(known, s).astype(np.int32) for s in sets]
        group = np.unique(root, return_inverse=True)[1]
        one, mark, ends = np.flatnonzero(part == x), np.zeros(len(known), bool), []
        for i in np.flatnonzero(part == y):
            j = np.arange(i) if x == y else one
            far = np.bitwise_count(f[j] ^ f[i]) + np.bitwise_count(g[j] ^ g[i])
            alike = np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i])
            j = j[(far <= most_bits) & alike & (group[j] != group[i])]
            if not len(j):
                continue
            mark[ids[i]] = True
            both = np.bincount(np.repeat(np.arange(len(j)), size[j]), mark[np.concatenate([ids[k] for k in j])], len(j))
            mark[ids[i]] = False
            either = size[j] + size[i] - both
            for k in j[np.where(either > 0, both / np.maximum(either, 1), 1.0) >= least]:
                if group[i] != group[k]:
                    group[group == group[k]] = group[i]
                    ends.append((v[i], v[k]))
        ends = np.array(ends, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    rows = places.join(members.drop("whole"), "v").join(sets, "v")
    return rows.groupBy("x", "y").applyInArrow(compare, "a long, b long")


def near_components(texts: DataFrame, scratch: Scratch, k: int, least: float, blocks: int, radius: int, most_bits: int, chunk: int) -> DataFrame:
    """``(v, low, root)``, a row for each distinct text of ``texts(doc_id, text, v)``: its smallest doc_id, its component."""
    tables = block_tables(blocks, radius)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.as_py(), k) for t in b.column(1)]
            prints = np.array([wide_fingerprint(s) for s in own], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([len(s) for s in own], pa.int32())], ["doc_id", "v", "f", "g", "size"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], ["v", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    def sets_of(named: DataFrame) -> DataFrame:
        """``(v, s)`` of the texts named by ``named(v)``."""
        sets = texts.select("v", "text").join(bounded(scratch.write(named)), "v", "left_semi").mapInArrow(describe, "v long, s binary")
        return scratch.write(sets.groupBy("v").agg(F.first("s").alias("s")))

    def verified(pairs: DataFrame) -> DataFrame:
        """``(a, b, near)`` by the exact similarity of the two shingle sets."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct())
        ends = pairs.select("a", "b").join(sets.select(F.col("v").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "y")
        ends = ends.join(sets.select(F.col("v").alias("a"), F.col("s").alias("x")), "a").select("a", "b", "x", "y")
        return scratch.write_small(ends, pairs.count(), 20_000, lambda x: x.mapInArrow(compare, "a long, b long, near boolean"))

    def joined(links: DataFrame) -> DataFrame:
        roots = connected_components(links, scratch).withColumnRenamed("node", "v")
        return scratch.write_small(vertex.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")), n)

    signed = scratch.write(texts.select("doc_id", "text", "v").mapInArrow(sign, "doc_id long, v long, f long, g long, size int"))
    vertex = signed.groupBy("v").agg(F.min("doc_id").alias("low"), F.first("f").alias("f"), F.first("g").alias("g"), F.first("size").alias("size"))
    vertex = scratch.write_small(vertex, signed.count())
    n = vertex.count()
    # stars first: of the texts with one value of a block the smallest leads, and each text goes to its nearest leader
    cuts = [round(128 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << p for p in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    values = F.array(*[F.xxhash64(F.lit(i), F.col("f").bitwiseAND(F.lit(_signed(m & (1 << 64) - 1))), F.col("g").bitwiseAND(F.lit(_signed(m >> 64)))) for i, m in enumerate(masks)])
    spread = vertex.select("v", "f", "g", F.explode(values).alias("key"))
    lead = spread.groupBy("key").agg(F.min(F.struct("v", "f", "g")).alias("l"), F.count("*").alias("n")).where("n > 1").select("key", "l.*")
    lead = scratch.write_small(lead, blocks * n)
    lead = lead.select("key", F.col("v").alias("a"), F.col("f").alias("lf"), F.col("g").alias("lg"))
    far = F.bit_count(F.col("f").bitwiseXOR(F.col("lf"))) + F.bit_count(F.col("g").bitwiseXOR(F.col("lg")))
    stars = spread.join(lead, "key").where("v <> a").select("a", F.col("v").alias("b"), far.alias("far")).where(F.col("far") <= most_bits)
    stars = scratch.write_small(stars.groupBy("b").agg(F.min(F.struct("far", "a")).alias("at")).select("at.a", "b"), n)
    links = verified(stars).where("near").select("a", "b")
    state = joined(links)
    # then all tables: components with candidate pairs are one cluster; its texts meet in chunks, with their sets
    clusters = connected_components(_thinned(_meetings(state, tables, most_bits, least), scratch), scratch)
    if not clusters.isEmpty():
        members = _chunks(state, clusters, scratch, chunk)
        large = members.where("not whole")
        places = members.where("whole").select("v", F.col("part").alias("x"), F.col("part").alias("y"))
        if not large.isEmpty():
            places = places.unionByName(_places(large, tables, most_bits, least))
        places = scratch.write(places)
        more = scratch.write(_exact(places, members, sets_of(places.select("v").distinct()), most_bits, least))
        if not more.isEmpty():
            state = joined(links.unionByName(more))
    return state.select("v", "low", "root")


def drop_near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, blocks: int = 6, radius: int = 3, most_bits: int = 32, chunk: int = 512) -> DataFrame:
    """``docs`` with one row of each component of texts whose k-word shingle sets have a Jaccard similarity >= ``least``.

    The fingerprint here has 128 bits, so that its distance tells similarities apart: at a similarity of 0.8 some
    15 % of the bits differ. Each of ``blocks`` blocks of bits has a covering of ``radius``, so all pairs that differ in fewer than
    blocks * (radius + 1) bits meet (24 of 128), and of those at exactly 0.8, whose distance scatters, at least 985 in 1,000
    (at 0.85 at least 998; a test holds it to that). Candidates up to ``most_bits`` apart are verified: only the exact similarity links.
    They are compared in tasks of two chunks of ``chunk`` texts; no table holds a row for each pair.

    The row with the smallest doc_id stays (ties: the smallest hash of the text). All columns stay, whatever their
    names. Equal texts are one vertex, however many; texts without a word, null ones among them, are equal. Rows without
    a doc_id can't be named by a component and stay; of a repeated row one stays; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "near")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = {c: F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text")}
    rows = plain.select(*names, own["doc_id"].cast("long").alias("doc_id"), own["text"].cast("string").alias("text"))
    rows = rows.withColumn("v", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = near_components(rows.select("doc_id", "text", "v"), scratch, k, least, blocks, radius, most_bits, chunk)
    keep = found.where("low is not null").groupBy("root").agg(F.min(F.struct("low", "v")).alias("at"))
    keep = scratch.write(keep.select(F.col("at.low").alias("doc_id"), F.col("at.v").alias("v")))
    kept = rows.join(bounded(keep), ["doc_id", "v"], "left_semi")
    first = Window.partitionBy("doc_id", "v").orderBy(F.xxhash64(*[n for n, kind in plain.dtypes if "map" not in kind and kind != "variant"]))
    kept = kept.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return kept.select(*names).unionByName(rows.where("doc_id is null").select(*names)).toDF(*docs.columns)
