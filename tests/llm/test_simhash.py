import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockweave.llm import simhash
from blockweave.llm.common import Scratch
from blockweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_small_difference(radius):
    masks = simhash.covering_masks(radius)
    for bits in itertools.combinations(range(64), radius):
        assert any(not m & sum(1 << b for b in bits) for m in masks)


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c d a b c".split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 5)
    assert simhash.fingerprint("A b\tC\nd a  B c") == want
    assert simhash.fingerprint("x y") == xxhash.xxh64_intdigest("x y", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_against_all_pairs(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.5:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 5, 200, 2000])))))
    rows += [(None, "null id"), (500, None), (501, ""), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in simhash.near_duplicates(df.withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_crowded_buckets_are_dealt_out_again(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63)
    fps = sorted({int(base) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(400)})
    fps = [simhash._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {}
    for direct in (3, 4096):
        scratch = Scratch(spark, "t")
        roots = connected_components(simhash.candidate_links(df, scratch, 2, direct), scratch)
        found[direct] = sorted(tuple(r) for r in roots.collect())
    brute_links = [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = connected_components(spark.createDataFrame(brute_links, "a long, b long"), Scratch(spark, "t"))
    assert found[3] == found[4096] == sorted(tuple(r) for r in want.collect())


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
