"""Operator 10: a quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; unlabelled are documents of any
kind.  With a class prior p a classifier's risk is ``p R_p+ + max(0, R_u- - p R_p-)``,
the non-negative unbiased estimate that needs no negative document.  The classifier is a
small network over features of the whole text: how character classes follow each other,
letter case, word lengths and repetition of words and lines.  It is trained on bounded
samples; the features and the scores are computed for every document.

The prior is estimated from positives and unlabelled documents alone: a first network tells
the two apart on one half of the sample, and scores the other; the share of unlabelled over
the share of positives that score above some t is the prior where only positives score so.
The t is taken whose ratio, with room for the error of both counts, is smallest.

Cases: null text is empty and scored like any text; labels other than 0 and 1 are left
out; without a positive to learn from every score is one half; repeated rows are scored
one by one, repeated labels of a document count once, as quality 0 if they differ; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, is_training, materialize, restrict, ship_package, text_or_empty
from .shingles import _SPACE, _slices, _word_hashes, string_bytes

#: Most trusted positives and unlabelled documents to learn from: those of smallest hash.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Training: hidden units, steps, documents of a kind in a step, step size, weight decay, seed.
HIDDEN, STEPS, BATCH, RATE, DECAY, SEED = 24, 600, 512, 0.005, 1e-3, 7

# character classes: lower, upper, digit, blank, line end, sentence mark, other ASCII, beyond ASCII
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4
_CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = 5
_CLASS[128:] = 7
_PAIRS = 64
N_FEATURES = _PAIRS + 8


def features(column: pa.Array) -> np.ndarray:
    """One row of N_FEATURES numbers for each text."""
    data, offsets = string_bytes(column)
    out = np.zeros((len(column), N_FEATURES), np.float32)
    for lo, hi in _slices(offsets):
        base, cuts = int(offsets[lo]), offsets[lo : hi + 1] - int(offsets[lo])
        text, rows = data[base : int(offsets[hi])], hi - lo
        size = np.diff(cuts)
        row = np.repeat(np.arange(rows), size)
        kind = _CLASS[text].astype(np.int64)
        follows = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
        pairs = np.bincount(row[follows] * _PAIRS + kind[follows] * 8 + kind[follows + 1], minlength=rows * _PAIRS).reshape(rows, _PAIRS)
        own = out[lo:hi]
        own[:, :_PAIRS] = np.sqrt(pairs / np.maximum(size, 1)[:, None])
        words, count = _word_hashes(data, offsets[lo : hi + 1])
        of = np.repeat(np.arange(rows), count)
        n = np.maximum(count, 1)
        order = np.lexsort((words, of))
        fresh = np.append(True, (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])) if len(words) else np.zeros(0, bool)
        distinct = np.bincount(of[order][fresh], minlength=rows)
        again = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=rows) if len(words) else np.zeros(rows)
        runs = np.diff(np.append(np.flatnonzero(fresh), len(words)))
        top = np.zeros(rows)
        np.maximum.at(top, of[order][fresh], runs)
        solid = np.bincount(row, weights=~_SPACE[text], minlength=rows)
        lines = np.bincount(row, weights=text == 10, minlength=rows)
        own[:, _PAIRS:] = np.stack([np.log1p(size), np.log1p(count), distinct / n, again / n, top / n, np.log1p(solid / n), lines / n, count == 0], 1)
    return out


@dataclass(frozen=True)
class Network:
    """One hidden layer; without weights it answers the prior."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: tuple[np.ndarray, ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return _sigmoid(np.tanh(z @ w1 + b1) @ w2 + b2[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_step(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative unbiased risk of the outputs z with the logistic loss, and the gradients by which to step.

    The part that stands for the negatives, the unlabelled loss less the positives' share of it, cannot
    be negative in truth.  Where it is, the step goes up that part alone.
    """
    sp, su = _sigmoid(positive), _sigmoid(unlabelled)
    negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    risk = prior * np.logaddexp(0, -positive).mean() + max(negative, 0.0)
    if negative >= 0:
        return risk, prior * (sp - 1) / len(sp) - prior * sp / len(sp), su / len(su)
    return risk, prior * sp / len(sp), -su / len(su)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimises the non-negative unbiased risk with the logistic loss."""
    if not len(positive) or not len(unlabelled):
        return Network(prior)
    rng = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive.astype(np.float64), unlabelled.astype(np.float64)))
    theta = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array([np.log(prior / (1 - prior))])]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), min(BATCH, len(p)))], u[rng.integers(0, len(u), min(2 * BATCH, len(u)))]
        x = np.concatenate([xp, xu])
        hidden = np.tanh(x @ theta[0] + theta[1])
        z = hidden @ theta[2] + theta[3][0]
        gp, gu = risk_step(z[: len(xp)], z[len(xp) :], prior)[1:]
        g = np.concatenate([gp, gu])
        back = np.outer(g, theta[2]) * (1 - hidden**2)
        grads = [x.T @ back + DECAY * theta[0], back.sum(0), hidden.T @ g + DECAY * theta[2], np.array([g.sum()])]
        for i, grad in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(prior, mean, scale, tuple(theta))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled; one half where there is nothing to estimate it from."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    scored = []
    for half in (0, 1):
        network = train(positive[half::2], unlabelled[half::2], 0.5)
        scored.append((network.score(positive[1 - half :: 2]), network.score(unlabelled[1 - half :: 2])))
    p, u = (np.sort(np.concatenate(x)) for x in zip(*scored, strict=True))
    cut = np.unique(np.concatenate([p, u]))
    above_p, above_u = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    room = 1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u))
    some = np.flatnonzero(above_p > 0)
    best = some[((above_u[some] + room) / above_p[some]).argmin()]
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network:
    """A network from the labels and documents that may be learned."""
    ship_package(docs.sparkSession)
    told = labels.filter(is_training() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    told = materialize(told, "told")
    draw = F.xxhash64("doc_id")
    trusted = told.filter("quality = 1").select("doc_id").orderBy(draw, "doc_id").limit(positives).withColumn("kind", F.lit(1))
    rows = docs.filter(is_training()).select(F.col("doc_id").cast("long").alias("doc_id"))
    others = rows.distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).withColumn("kind", F.lit(0))
    drawn = materialize(trusted.union(others).groupBy("doc_id").agg(F.max("kind").alias("trusted"), F.min("kind").alias("other")), "drawn")
    chosen = restrict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), drawn.select("doc_id"), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([x.tobytes() for x in features(batch.column("text"))], pa.binary())})

    measured = arrow_map(chosen, measure, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x"))  # of rows of equal id one is learned
    measured = measured.join(F.broadcast(drawn), "doc_id").toPandas().sort_values("doc_id")  # at most positives + unlabelled rows
    x = np.stack([np.frombuffer(v, np.float32) for v in measured["x"]]) if len(measured) else np.zeros((0, N_FEATURES), np.float32)
    positive, unlabelled_ = x[(measured["trusted"] == 1).to_numpy(bool)], x[(measured["other"] == 0).to_numpy(bool)]
    return train(positive, unlabelled_, estimated_prior(positive, unlabelled_))


def score_documents(docs: DataFrame, network: Network) -> DataFrame:
    """Per row of documents: doc_id, held_out, score, predicted."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(network.score(features(batch.column("text"))).astype(np.float64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = arrow_map(rows, run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
