"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .learning import arrays, by_hash, fold, sample_features

#: A-Z to a-z, ASCII that is no letter or digit to a space; bytes of other characters stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
BUCKETS = 1 << 20


def word_ids(text: str | None) -> list[int]:
    """Hashes, sorted, of the distinct words of a whole text and of the four and five bytes that longer words begin
    with: a stem tells of its inflections and compounds, seen or not."""
    crc = zlib.crc32
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split())
    ids = {crc(w) % BUCKETS for w in words}
    ids |= {crc(b"4:" + w) % BUCKETS for w in {w[:4] for w in words if len(w) > 4}}
    ids |= {crc(b"5:" + w) % BUCKETS for w in {w[:5] for w in words if len(w) > 5}}
    return sorted(ids)


@dataclass
class Model:
    """A linear score over the presence of words and stems: log-odds = bias + the sum of the present words' weights."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, ids: list[int]) -> float:
        get = self.weights.get
        z = self.bias + sum([get(i, 0.0) for i in ids])
        return float(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))


def _distinct(rows: list[list[int]], common: np.ndarray, bands: int = 5, width: int = 3) -> list[list[int]]:
    """Rows without those that share a band of min-hashes of their uncommon words with an earlier row: copies of
    one document would teach its words, as many times as there are copies."""
    a = np.random.default_rng(5).integers(1, 2**31, (bands * width, 2))
    seen: set[tuple] = set()
    out = []
    for r in rows:
        x = np.array(r, np.int64)
        x = x[~common[x]] if len(x) else x
        if not len(x):
            x = np.append(np.array(r, np.int64), 0)
        low = ((a[:, :1] * x + a[:, 1:]) % 2147483647).min(axis=1).reshape(bands, width)
        keys = {(i, *map(int, h)) for i, h in enumerate(low)}
        if not keys & seen:
            out.append(r)
        seen |= keys
    return out


def _tally(rows: list) -> np.ndarray:
    """In how many rows each word is."""
    n = np.zeros(BUCKETS, np.int32)
    for s in range(0, len(rows), 256):  # a row holds a word once, but several rows may
        np.add.at(n, np.concatenate([np.asarray(r, np.int32) for r in rows[s : s + 256]]), 1)
    return n


def likelihood_ratio(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Twice the log likelihood ratio of two shares against one common share; 0 where positives hold no larger share."""
    both = in_p + in_u
    e = both * (n_p / (n_p + n_u))
    ratio = 2 * (in_p * np.log(np.maximum(in_p, 1) / np.maximum(e, 1e-9)) + in_u * np.log(np.maximum(in_u, 1) / np.maximum(both - e, 1e-9)))
    ratio[in_p <= e] = 0
    return ratio


def choose(positive: list, unlabelled: list, columns: int, chance: float, draws: int = 20, seed: int = 3) -> np.ndarray:
    """The words that stand out among positives, at most ``columns``, the clearest first.

    Shares are compared with those of a pool: the unlabelled rows and the positives that aren't among them. What
    chance alone yields is measured, not assumed: ``draws`` times as many rows of the pool as there are positives play
    their part. The cut is the lowest at which at most the share ``chance`` of the words above it is expected there by
    chance; so it follows the size of the sample, from ten positives up.
    """
    key = lambda r: hash(np.asarray(r, np.int32).tobytes())
    known = {key(r) for r in unlabelled}
    pool = [*unlabelled, *(r for r in positive if key(r) not in known)]
    n_p, n, in_pool = len(positive), len(pool), _tally(pool)
    words = np.flatnonzero(in_pool > 1)  # a word of one row stands out for nothing
    in_pool, rng, null = in_pool[words], np.random.default_rng(seed), []
    real = likelihood_ratio(_tally(positive)[words], in_pool, n_p, n)
    for _ in range(draws):
        own = likelihood_ratio(_tally([pool[i] for i in rng.permutation(n)[:n_p]])[words], in_pool, n_p, n)
        null.append(own[own > 1].astype(np.float32))
    real = real.astype(np.float32)
    null, high = np.sort(np.concatenate(null)), np.sort(real[real > 1])
    cuts = np.unique(high)
    by_chance = (len(null) - np.searchsorted(null, cuts)) / draws
    fine = cuts[by_chance <= chance * (len(high) - np.searchsorted(high, cuts))]
    if not len(fine):
        return np.zeros(0, np.int64)
    best = np.argsort(-real, kind="stable")[:columns]
    return words[best[real[best] >= fine[0]]]


def train_nnpu(positive: list, unlabelled: list, prior: float, columns: int = 400, epochs: int = 200, rate: float = 0.1, decay: float = 3e-4, chance: float = 0.1) -> Model:
    """Minimise  prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)])  + decay / 2 * |w|^2,  l the logistic loss.

    Columns are the words that ``choose`` finds. Adam over the full bounded sample. Where the corrected negative risk
    falls below zero the step goes against its gradient, as the non-negative estimator asks. No positives, or no word that stands
    out among them: a constant score.
    """
    prior = min(max(prior, 1e-4), 0.9)
    if not positive or not unlabelled:
        return Model(float(np.log(prior / (1 - prior))) if positive or unlabelled else -35.0)
    positive = _distinct(positive, _tally(unlabelled) > 0.02 * len(unlabelled))
    n_p, n_u = len(positive), len(unlabelled)
    chosen = choose(positive, unlabelled, columns, chance)
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def dense(rows: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen) + 1), np.float32)
        x[:, -1] = 1
        for i, r in enumerate(rows):
            at = place[np.asarray(r, np.int64)]
            x[i, at[at >= 0]] = 1
        return x

    p, u = dense(positive), dense(unlabelled)
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    soft = lambda t: np.logaddexp(0, t)
    sig = lambda t: (1 / (1 + np.exp(-np.clip(t, -35, 35)))).astype(np.float32)
    for t in range(1, epochs + 1):
        w32 = w.astype(np.float32)
        zp, zu = p @ w32, u @ w32
        negative = soft(zu).mean() - prior * soft(zp).mean()
        g_neg = sig(zu) @ u / n_u - prior * (sig(zp) @ p) / n_p
        g_pos = -prior * (sig(-zp) @ p) / n_p
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(w[-1]), {int(c): float(x) for c, x in zip(chosen, w[:-1])})


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, most_positive: int = 4000, most_unlabelled: int = 10000, prior: float | None = None) -> Model:
    """A model of ``labels(doc_id, toxic)`` and the texts of ``docs``, from rows outside fold 0 only.

    At most ``most_positive`` confirmed toxic documents and ``most_unlabelled`` documents without regard to labels
    are taken, the first by a hash of doc_id. The class prior is the share of toxic among the labels that may
    teach, unless it is given. Rows of ``labels`` with nulls teach nothing.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    may = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    may = may.where(fold(F.col("doc_id"), folds) != 0)
    if prior is None:
        prior = may.agg(F.avg("toxic")).first()[0] or 0.0
    p = by_hash(may.where("toxic = 1"), most_positive).withColumn("kind", F.lit(1))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    u = by_hash(ids.where(fold(F.col("doc_id"), folds) != 0), most_unlabelled).withColumn("kind", F.lit(0))
    t = sample_features(docs, p.unionByName(u), word_ids, scratch, pa.int32())
    kind, x = t.column("kind").to_pylist(), arrays(t.column("x"))
    model = train_nnpu([r for k, r in zip(kind, x) if k == 1], [r for k, r in zip(kind, x) if k == 0], prior)
    del t, x
    pa.default_memory_pool().release_unused()  # the driver goes on with other stages
    return model


def score(docs: DataFrame, model: Model, folds: int = 5, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` and the columns in ``carry`` for each row of ``docs``; no shuffle.

    Null and empty texts get the score of no words. Repeated rows stay; a null doc_id isn't held out; no rows give
    no rows. ``carry`` names columns of ``docs``; other columns are not read.
    """

    def run(batches):
        for b in batches:
            s = [model.score(word_ids(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), *b.columns[2:]], ["doc_id", "score", *[f"_{c}" for c in carry]])

    inner = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    extra = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = inner.mapInArrow(run, f"doc_id long, score double{extra}")
    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[f"_{c}" for c in carry])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; the columns stay, whatever their names.

    Rows that stay are as they were: null and empty texts get the score of no words (below 0.5 unless half of the
    labelled rows are toxic), repeated rows go or stay together, a null doc_id is judged like any other. Without labels, or
    without rows, nothing goes.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own = [F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text")]
    rows = score(plain.select(*own, *names), fit(docs, labels), carry=tuple(names)).where("predicted = 0")
    return rows.select(*[F.col(f"_{n}").alias(c) for n, c in zip(names, docs.columns)])
