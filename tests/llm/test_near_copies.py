import itertools
import random

import numpy as np

import corpus_pipeline
from blockweave.llm import simhash
from blockweave.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def brute(rows):
    """(smallest doc_id, text) of each component of all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if jaccard(rows[i][1], rows[j][1]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(best.values())


def planted():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(vocab, k=r.choice([3, 100, 200, 600])))) for i in range(60)]
    for i in range(60, 200):  # near copies: some words changed, on both sides of 0.8; chains of copies of copies
        w = r.choice(rows)[1].split()
        for _ in range(1 + r.randrange(1 + len(w) // 40)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    base = r.choices(vocab, k=300)
    for i in range(200, 240):  # a crowd
        w = list(base)
        for _ in range(5):
            w[r.randrange(300)] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, rows[5][1].upper()), (7, rows[7][1]), (303, " \n")]


def test_stage_drops_planted_near_copies(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    want = brute(rows)
    assert sorted(r.doc_id for r in out.collect()) == want and len(want) < len(rows) - 60


def test_ids_that_repeat_with_other_texts_and_null_ids(spark):
    long = [" ".join(f"{c}{i}" for i in range(50)) for c in "abc"]
    rows = [(1, long[0]), (1, long[1]), (2, long[1] + " x"), (3, long[2]), (None, long[2]), (None, long[2]), (1, long[0])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, long[0]), (1, long[1]), (3, long[2]), (None, long[2]), (None, long[2])], key=repr)
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A B c d e f g"), (None, None), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).selectExpr("*", "1 as v", "2 as root", "3 as _nth", "4 as nth", "5 as c0", "6 as low")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:2] for r in out.collect()), key=repr) == sorted([(1, rows[0][1]), (None, None), (3, None)], key=repr)


def test_every_pair_within_the_radius_meets():
    tables, r = simhash.block_tables(), random.Random(2)
    assert len(tables) == 90
    for _ in range(3000):
        x = r.getrandbits(128)
        y = x ^ sum(1 << p for p in r.sample(range(128), r.randint(0, 23)))
        d = x ^ y
        assert any(not d & (m | g << 64) for m, g in tables)


def test_share_of_pairs_that_meet_by_similarity():
    """Sets of 300 shingles with a similarity of 0.8 and 0.85: at least 0.985 and 0.998 of the pairs are candidates."""
    rng, tables = np.random.default_rng(3), simhash.block_tables()
    for least, share, n in ((0.8, 0.985, 1500), (0.85, 0.998, 1500)):
        both = round(300 * 2 * least / (1 + least))
        met = 0
        for _ in range(n):
            own = rng.integers(0, 1 << 63, 600 - both, np.uint64)
            x, y = (simhash.wide_fingerprint(s) for s in (own[:300], own[300 - both :]))
            d = [(a ^ b) & (1 << 64) - 1 for a, b in zip(x, y)]
            met += sum(v.bit_count() for v in d) <= 32 and any(not d[0] & m and not d[1] & g for m, g in tables)
        assert met >= share * n


def test_close_pairs_are_all_pairs_of_two_components():
    rng = np.random.default_rng(4)
    e = np.zeros(400, simhash.ENTRY)
    base = rng.integers(0, 1 << 62, (8, 2), np.uint64)
    for i in range(400):
        f = base[rng.integers(8)].copy()
        for b in rng.choice(128, int(rng.integers(0, 25)), replace=False):
            f[b // 64] ^= np.uint64(1 << int(b % 64))
        e[i] = (f[0], f[1], i, [7, 7, 7, i][rng.integers(4)], rng.integers(50, 90))
    key = rng.integers(0, 3, 400, np.uint64)
    got = {tuple(sorted((int(i), int(j)))) for a, b, _ in simhash.close_pairs(e, key, 32, 0.8, 16) for i, j in zip(a, b)}
    far = lambda i, j: int(np.bitwise_count(e["f"][i] ^ e["f"][j])) + int(np.bitwise_count(e["g"][i] ^ e["g"][j]))
    alike = lambda i, j: min(e["size"][i], e["size"][j]) >= 0.8 * max(e["size"][i], e["size"][j])
    want = {(i, j) for i, j in itertools.combinations(range(400), 2) if key[i] == key[j] and e["root"][i] != e["root"][j] and far(i, j) <= 32}
    assert {p for p in want if alike(*p)} <= got <= want and len(want) > 100


def test_nearest_pairs_that_fail_leave_no_link_out(spark):
    """Two crowds whose nearest ends aren't similar enough, while others are."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    base = r.choices(vocab, k=400)
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(0, (i % 12) * 40, 40):
            w[j + 1 : j + 4] = r.choices(vocab, k=3)
        rows.append((i, " ".join(w[: 400 - i % 7 * 6])))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert sorted(x.doc_id for x in simhash.drop_near_duplicates(df).collect()) == brute(rows)


def test_meetings_are_no_rows_for_pairs(spark):
    """Fingerprints that all meet, each a component of its own: far fewer rows than pairs (four times as many at twice
    the number), at most one for each text and table; thinned, one for each text."""
    rng, made = np.random.default_rng(6), {}
    for n in (250, 500):
        rows = []
        for i in range(n):
            f = [0, 0]
            for b in rng.choice(128, 6, replace=False):
                f[b // 64] |= 1 << int(b % 64)
            rows.append((i, *map(simhash._signed, f), i, 100))
        df = spark.createDataFrame(rows, "v long, f long, g long, root long, size int")
        links = simhash._meetings(df, simhash.block_tables(), 32, 0.8).collect()
        made[n] = len(links)
        assert len({x for r in links for x in r}) == n
        few = simhash._thinned(spark.createDataFrame(links), Scratch(spark, "t")).collect()
        assert len(few) == n - 1 and {r.a for r in few} == {0}
    assert made[500] <= 3 * made[250] and made[500] <= 0.1 * 500 * 499 / 2


def test_clusters_larger_than_a_chunk(spark):
    """Chains, and groups of which hardly any two are similar enough, dealt out in small chunks."""
    rows = planted()
    r = random.Random(11)
    base = [f"x{i}" for i in range(300)]
    for i in range(400, 480):
        w = list(base)
        for j in r.sample(range(0, 300, 10), 4 + i % 5):
            w[j] = f"{j}-{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    want = brute(rows)
    assert sum(i >= 400 for i in want) > 10
    for chunk in (7, 512):
        assert sorted(x.doc_id for x in simhash.drop_near_duplicates(df, chunk=chunk).collect()) == want
