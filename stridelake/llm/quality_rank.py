"""Quality scores learned from preference pairs (Bradley-Terry).

A document's strength is a linear function of features of its text. Of a pair (better, worse) the
better is preferred with probability sigmoid(strength difference); weights minimise the logistic loss
of the feature differences plus a small L2 term. The threshold is a quantile of the strengths of the
training documents, at the share of documents marked as bad; scores are a logistic curve through it,
so that ``CUT`` of the score lies exactly at the threshold.

Weights are fitted on the driver on at most ``max_labelled`` labelled documents (those with the
smallest hashes of their ids); scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import as_bytes, held_out

CUT = 0.3
_CLASS = np.full(256, 7)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[33, 63]] = 4
_CLASS[[ord(c) for c in "#$%&*<>=+^~@_\\{}[]"]] = 5
_CLASS[[ord("|")]] = 6
_CLASS[[ord(c) for c in ".,;:'\"()-/`"]] = 8
SHARES = ("upper", "digit", "shout", "symbol", "bar", "stop", "word", "adjacent", "repeat", "lines")
FEATURES = ("length", *(f"root_{s}" for s in SHARES), *SHARES)


def features(text: bytes) -> list[float]:
    """Its length and shares of it, on a root scale, where small shares already count, and as they are; all 0 for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    n, letters = len(words), max(1.0, kinds[1] + kinds[2] + kinds[7])
    solid = max(1.0, len(text) - kinds[0])
    lines = [x for x in text.split(b"\n") if x.strip()]
    shares = (
        kinds[1] / letters,
        kinds[3] / solid,
        kinds[4] / solid,
        kinds[5] / solid,
        kinds[6] / n,
        kinds[8] / solid,
        min(solid / n, 40.0) / 40.0,
        sum(map(eq, words, words[1:])) / n,
        1.0 - len(set(words)) / n,
        1.0 - len(set(lines)) / max(1, len(lines)),
    )
    return [np.log1p(n) / 10, *(np.sqrt(x) for x in shares), *map(float, shares)]


def matrix(column: pa.Array) -> np.ndarray:
    out = np.array([features(x.as_buffer().to_pybytes()) for x in column], np.float64)
    return out.reshape(len(column), len(FEATURES))


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    threshold: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.weights - self.threshold) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 100_000, l2: float = 1e-3, seed: int = 7) -> Ranker:
    """Weights from ``pairs`` pairs of a good and a bad row; without both kinds every score is even."""
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Ranker(np.zeros(x.shape[1]), -1.0 if len(better) or not len(worse) else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    size = max(pairs, len(better), len(worse))
    # every row takes part; partners are drawn
    a = better[np.concatenate([rng.permutation(len(better)) for _ in range(-(-size // len(better)))])[:size]]
    b = worse[np.concatenate([rng.permutation(len(worse)) for _ in range(-(-size // len(worse)))])[:size]]
    spread = np.maximum(x.std(0), 1e-3)
    d = (x[a] - x[b]) / spread
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps; the loss is convex
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d.T @ p) / size + l2 * w
        hess = (d.T * np.maximum(p * (1 - p), 1e-9)) @ d / size + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    strength = x @ w
    # the quantile at the share of bad rows, moved within the gap that it falls into
    share = len(worse) / (len(worse) + len(better))
    ordered = np.sort(strength)
    k = min(len(ordered) - 1, max(1, round(share * len(ordered))))
    threshold = float(ordered[k - 1] + ordered[k]) / 2
    return Ranker(w, threshold, max(float(np.std(strength)) / 4, 1e-6))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Ranker:
    """Fits on labelled rows that are not held out: at most ``max_labelled`` ids, by smallest hash.

    Null ids and null labels teach nothing; an id labelled twice takes its smaller label; texts that
    repeat under one id count as one example, their features averaged.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("good")).where("doc_id is not null and good is not null")
    known = known.where(~held_out()).groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = as_bytes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    names = [f"x{i}" for i in range(len(FEATURES))]
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in x.T)], ["doc_id", "good", *names])

    # max_labelled rows of 16 bytes bound what is broadcast, and of 22 numbers what is collected
    rows = texts.join(F.broadcast(known), "doc_id").select("doc_id", F.col("good").cast("int").alias("good"), "text")
    rows = rows.mapInArrow(run, f"doc_id {kind}, good int, " + ", ".join(f"{n} double" for n in names))
    rows = rows.groupBy("doc_id").agg(F.min("good").alias("good"), *[F.avg(n).alias(n) for n in names]).toArrow()
    x = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
    good = rows.column("good").to_numpy()
    order = np.lexsort((*x.T, good))  # the fit must not depend on the order in which tasks end
    return fit(x[order], good[order])


def score(docs: DataFrame, ranker: Ranker, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each input row.

    Null, empty and blank texts have the features of an empty text and the score that these give.
    Null ids are not held out. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = ranker.score(matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)[doc_id]
    source = as_bytes(docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")))
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``CUT`` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text)).cast(pa.binary()).fill_null(b"")
            yield b.filter(pa.array(ranker.score(matrix(column)) >= CUT))

    return docs.mapInArrow(run, docs.schema)
