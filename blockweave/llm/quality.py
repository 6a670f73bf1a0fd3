"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Scratch
from .learning import by_hash, fold, sample_features

BUCKETS = 1 << 20
#: The form of a word: capital, small letter, digit; other ASCII as it is; other characters as small letters.
_FORM = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_forms: dict[bytes, int] = {}


def _form_id(form: bytes) -> int:
    """A hash of a word's form with runs shortened to one, kept for forms seen before."""
    if form not in _forms:
        if len(_forms) > 200_000:
            _forms.clear()
        _forms[form] = zlib.crc32(b"f:" + _RUN.sub(rb"\1", form)) % BUCKETS
    return _forms[form]


def term_counts(text: str | None) -> list[int]:
    """Terms of a whole text, each as term << 20 | count, sorted by term.

    Terms are the forms of words, the words themselves, steps of how often words and lines
    repeat, and steps of the length and of the mean word length.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    crc, out = zlib.crc32, Counter()
    for form, n in Counter(raw.translate(_FORM).split()).items():
        out[_form_id(form)] += n
    words = raw.translate(ASCII_LOWER).split()
    counted = Counter(words)
    for w, n in counted.items():
        out[crc(b"w:" + w) % BUCKETS] += n
    lines = [x for x in raw.split(b"\n") if x]
    n, weight = len(words), max(4, len(words) // 8)
    for name, step in (
        (b"words", int(10 * len(counted) / n) if n else -1), (b"lines", int(10 * len(set(lines)) / len(lines)) if lines else -1), (b"size", int(np.log2(n + 1))),
        (b"top", int(20 * max(counted.values()) / n) if n else -1), (b"mean", min(20, len(raw) // n) if n else -1),
    ):
        out[crc(b"s:%b:%d" % (name, step)) % BUCKETS] += weight
    return [t << 20 | min(c, (1 << 20) - 1) for t, c in sorted(out.items())]


@dataclass
class Model:
    """Terms with their weights and latent directions, and the labelled vectors that vote."""

    columns: dict[int, int]
    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    default: float

    def embed(self, rows: list[list[int]]) -> np.ndarray:
        """Unit vectors; a text without a known term gets zeros."""
        x = np.zeros((len(rows), len(self.columns)), np.float32)
        for i, r in enumerate(rows):
            at = [(c, v & 0xFFFFF) for v in r if (c := self.columns.get(v >> 20)) is not None]
            if at:
                cols, counts = zip(*at)
                x[i, cols] = np.log1p(counts)
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        """Labels of the nearest by exact cosine, weighted by similarity; without any likeness, the labels' mean.

        All that tie with the last of the nearest vote as well, so the order of the labelled rows decides nothing.
        """
        if not len(self.vectors):
            return np.full(len(rows), self.default)
        z = self.embed(rows)
        cos = z @ self.vectors.T
        k = min(self.neighbours, cos.shape[1])
        last = -np.partition(-cos, k - 1, axis=1)[:, k - 1]
        row, near = np.nonzero(cos >= last[:, None])
        w = np.maximum(cos[row, near], 0).astype(np.float64) ** 8
        total = np.bincount(row, w, len(rows))
        votes = np.bincount(row, w * self.labels[near], len(rows))
        return np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.default)


def train(rows: list[list[int]], labels: list[int], terms: int = 1500, rank: int = 48, neighbours: int = 15) -> Model:
    """Latent directions by singular values of the labelled rows' weighted term matrix: the most common terms of two rows and more."""
    y = np.array(labels, np.float64)
    seen = Counter(v >> 20 for r in rows for v in r)
    top = sorted((t for t, n in seen.items() if n > 1), key=lambda t: (-seen[t], t))[:terms]
    m = Model({t: i for i, t in enumerate(top)}, np.array([np.log((1 + len(rows)) / (1 + seen[t])) + 0.3 for t in top], np.float32), np.eye(len(top), dtype=np.float32), np.zeros((0, 0), np.float32), y, neighbours, float(y.mean()) if len(y) else 0.5)
    if not top:
        return m
    x = m.embed(rows)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    m.directions = vectors[:, ::-1][:, :rank].astype(np.float32)
    m.vectors = m.embed(rows)
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, out: int = 2, most: int = 6000) -> Model:
    """A model of ``labels(doc_id, quality)`` and the texts of ``docs`` from rows outside fold ``out``.

    At most ``most`` labelled rows, the first by a hash of doc_id; so the model that is broadcast is bounded
    too. Rows of ``labels`` with nulls, and labels other than 0 and 1, teach nothing.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    may = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("kind")).where("doc_id is not null and kind in (0, 1)")
    may = may.where(fold(F.col("doc_id"), folds) != out).groupBy("doc_id").agg(F.max("kind").alias("kind"))
    ids = by_hash(may, most).join(may, "doc_id")
    t = sample_features(docs, ids, term_counts, scratch)
    return train(t.column("x").to_pylist(), t.column("kind").to_pylist())


def score(docs: DataFrame, model: Model, folds: int = 4, out: int = 2, threshold: float = 0.7, block: int = 512) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``; one pass, no shuffle.

    Products run in blocks of documents against all labelled vectors. Null and empty texts are scored by their
    few terms; repeated rows stay; a null doc_id isn't held out; no rows give no rows, no labels the score 0.5; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            parts = []
            for s in range(0, b.num_rows, block):
                parts.append(own.score([term_counts(t.as_py()) for t in b.column(1).slice(s, block)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else [], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(fold(F.col("doc_id"), folds) == out, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
