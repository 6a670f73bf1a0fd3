import random
import zlib

import numpy as np

from blockweave.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=700, seed=6):
    r = random.Random(seed)
    vocab = ["".join(r.choices(["an", "re", "tion", "the", "ing", "es"], k=r.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words, toxic, junk = r.choices(vocab, k=r.randint(20, 120)), r.random() < 0.15, r.random() < 0.2
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum", "Loser,"]))
        text = " ".join(w + r.choice(["###", "$$$", "&&&"]) for w in words) if junk else " ".join(words).capitalize() + "."
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    extra = [(None, "x", "en", None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "word " * 50000, "en", "s", 0), (5, docs[5][1], "en", "s", 0)]
    d = spark.createDataFrame(docs + extra, SCHEMA).selectExpr("*", "1 as score", "2 as kind")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    for out, at, cut, least in ((toxicity.score(d, toxicity.fit(d, lab)), 1, 0.5, 0.97), (quality.score(d, quality.fit(d, lab)), 0, 0.7, 0.95)):
        rows = out.collect()
        assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
        mod, rest = (5, 0) if at else (4, 2)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id][at] for r in held]) >= least
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and {9001, 9002, 9003} <= {r.doc_id for r in kept.select("doc_id").collect()}


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 3)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, toxicity.fit(d, none)).first().predicted == 0
    assert quality.score(d, quality.fit(d, none)).first().score == 0.5
    assert toxicity.score(d.where("false"), toxicity.fit(d, none)).count() == 0


def test_the_corrected_risk_needs_no_negatives():
    rng = np.random.default_rng(1)
    clean = lambda: rng.choice(200, 30, replace=False).tolist()
    pos = [[*clean(), 500 + int(rng.integers(4))] for _ in range(200)]
    unl = [[*clean(), 500 + int(rng.integers(4))] if rng.random() < 0.1 else clean() for _ in range(2000)]
    m = toxicity.train_nnpu(pos, unl, 0.1)
    assert np.mean([m.score([*clean(), 501]) > 0.5 for _ in range(50)]) > 0.9
    assert np.mean([m.score(clean()) > 0.5 for _ in range(200)]) < 0.05


def test_neighbours_vote_by_exact_cosine():
    rows = [quality.term_counts(t) for t in ("a b c d", "a b c e", "x### y### z###", "p### q### r###")]
    m = quality.train(rows, [1, 1, 0, 0], neighbours=2)
    s = m.score(rows)
    assert s[:2].min() > 0.9 and s[2:].max() < 0.1


def risk(model, pos, unl, prior, decay):
    """The non-negative risk, a document at a time."""
    loss = lambda z: float(np.log1p(np.exp(-z)))
    z = lambda r: model.bias + sum(model.weights.get(i, 0.0) for i in r)
    p, p_as_n, u_as_n = (sum(loss(s * z(r)) for r in rows) / len(rows) for s, rows in ((1, pos), (-1, pos), (-1, unl)))
    return prior * p + max(0.0, u_as_n - prior * p_as_n) + decay / 2 * sum(w * w for w in model.weights.values())


def test_training_comes_near_the_least_risk():
    rng = np.random.default_rng(2)
    clean = lambda: rng.choice(3000, 40, replace=False).tolist()
    pos = [[*clean(), 500 + i % 3] for i in range(120)]
    unl = [[*clean(), 500 + int(rng.integers(3))] if rng.random() < 0.2 else clean() for _ in range(900)]
    m = toxicity.train_nnpu(pos, unl, 0.2, epochs=600)
    assert {500, 501, 502} <= set(m.weights)
    own = toxicity._distinct(pos, toxicity._tally(unl) > 0.02 * len(unl))
    least = risk(m, own, unl, 0.2, 3e-4)
    assert least < risk(toxicity.Model(float(np.log(0.25)), {}), own, unl, 0.2, 3e-4)
    for k in [None, *m.weights]:
        for step in (-0.4, 0.4):
            moved = toxicity.Model(m.bias + step * (k is None), {i: w + step * (i == k) for i, w in m.weights.items()})
            assert risk(moved, own, unl, 0.2, 3e-4) > 0.9 * least  # the estimator swings about the point where the corrected part is zero


def test_ten_positives_teach_and_chance_does_not():
    rng = np.random.default_rng(5)
    clean = lambda: rng.choice(4000, 200, replace=False).tolist()
    bad = lambda: [9000 + int(i) for i in rng.choice(8, 3, replace=False)]
    pos = [clean() + bad() for _ in range(10)]
    unl = pos + [clean() + (bad() if rng.random() < 0.1 else []) for _ in range(150)]
    m = toxicity.train_nnpu(pos, unl, 0.15)
    assert np.mean([m.score(clean() + bad()) >= 0.5 for _ in range(50)]) > 0.8
    assert np.mean([m.score(clean()) >= 0.5 for _ in range(200)]) < 0.03
    # positives that are like all others: nothing stands out, the score is constant
    m = toxicity.train_nnpu([clean() for _ in range(10)], [clean() for _ in range(150)], 0.15)
    assert len(m.weights) <= 2
