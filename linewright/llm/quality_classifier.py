"""Quality by random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Each token bucket has a sparse random index vector. The vector of a bucket is the sum of the index vectors of
what stands within two tokens of it, over all documents. A document is the mean of its tokens' vectors and a few
measures of how its tokens repeat. The network learns from a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow import append
from .folds import held_out, labelled_sample, sampled_texts
from .tokens import summed, text_chunks, token_ids

BUCKETS = 4096
DIMS = 32
REACH = 2
PER_CLASS = 3000
HIDDEN = 24
_ENTRIES = 2
_RANDOM = np.random.Generator(np.random.PCG64(11))
_INDEX_DIMS = _RANDOM.integers(0, DIMS, (BUCKETS, _ENTRIES))
_INDEX_SIGNS = _RANDOM.choice([-1.0, 1.0], (BUCKETS, _ENTRIES))
N_FEATURES = DIMS + 4


def _owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def context_sums(groups: Iterator[list[bytes]]) -> np.ndarray:
    """Sum of the neighbours' index vectors per bucket, flattened."""
    out = np.zeros(BUCKETS * DIMS)
    for texts in groups:
        ids, bounds = token_ids(texts, BUCKETS)
        owner = _owners(bounds)
        for step in range(1, REACH + 1):
            together = np.flatnonzero(owner[step:] == owner[:-step])
            left, right = ids[together], ids[together + step]
            for word, context in ((left, right), (right, left)):
                for e in range(_ENTRIES):
                    cells = word.astype(np.int64) * DIMS + _INDEX_DIMS[context, e]
                    out += np.bincount(cells, _INDEX_SIGNS[context, e], BUCKETS * DIMS)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors of the buckets, what all have in common removed; buckets never seen stay zero."""
    rows = sums.reshape(BUCKETS, DIMS)
    seen = np.abs(rows).sum(1) > 0
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.maximum(lengths, 1e-9)
    if seen.any():
        unit[seen] -= unit[seen].mean(0)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    unit[~seen] = 0
    return unit.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row of features per text; zeros for a text without tokens."""
    ids, bounds = token_ids(texts, BUCKETS)
    out = np.zeros((len(texts), N_FEATURES))
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(float)
    owner = _owners(bounds)
    # Each bucket once per text, so that a very long text takes no more than a vector per bucket.
    keys, counts = np.unique(owner * BUCKETS + ids, return_counts=True)
    weighed = vectors[keys % BUCKETS] * counts[:, None]
    firsts = np.flatnonzero(np.diff(keys // BUCKETS, prepend=-1))
    out[full, :DIMS] = np.add.reduceat(weighed, firsts, axis=0) / n[:, None]
    # Share of equal pairs among all pairs of tokens, and among neighbours.
    squares = np.bincount(keys // BUCKETS, counts.astype(float) ** 2, len(texts))[full]
    out[full, DIMS] = squares / n**2
    out[full, DIMS + 1] = np.log1p(n) / 10
    same = (owner[1:] == owner[:-1]) & (ids[1:] == ids[:-1])
    out[full, DIMS + 2] = np.bincount(owner[1:], same, len(texts))[full] / n
    different = np.bincount(keys // BUCKETS, minlength=len(texts))[full]
    out[full, DIMS + 3] = different / n
    return out


def _features(vectors: np.ndarray, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for group in text_chunks(batch["text"].to_pylist()) for r in pooled(group, vectors)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "features"])

    return run


class Network:
    """Two layers: tanh units and one logit; `temperature` and `shift` calibrate the probability."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0, shift=0.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2
        self.temperature, self.shift = temperature, shift

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the cross-entropy with both classes weighing the same."""
    random = np.random.Generator(np.random.PCG64(seed))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    p = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        miss = weight * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y)
        back = np.outer(miss, p[2]) * (1 - h * h)
        slopes = [z.T @ back + decay * p[0], back.sum(0), h.T @ miss + decay * p[2], np.array([miss.sum()])]
        for i, g in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, *p)


def calibrated(net: Network, x: np.ndarray, y: np.ndarray, prior: float) -> Network:
    """The temperature of least loss on rows not trained on, and the shift from equal classes to the true share of label 1."""
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        logits = net.logits(x)

        def loss(t: float) -> float:
            return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * logits / t)).sum())

        net.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    net.shift = float(np.log(prior / (1 - prior)))
    return net


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> Network | None:
    """A network from sample rows, a fifth of them kept for calibration; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    fifth = np.arange(len(y)) % 5 == 0
    if len(set(y[~fifth].tolist())) < 2:
        fifth[:] = False
    return calibrated(train(x[~fifth], y[~fifth]), x[fifth], y[fifth], prior)


def _score(vectors: np.ndarray, net: Network | None, prior: float):
    def run(batch: pa.RecordBatch) -> pa.Array:
        groups = text_chunks(batch["text"].to_pylist())
        scores = [net.probabilities(pooled(g, vectors)) if net else np.full(len(g), prior) for g in groups]
        return pa.array(np.concatenate(scores) if scores else [], pa.float64())

    return run


def with_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality", out_col: str = "score") -> DataFrame:
    """Every row of `docs` with the probability of label 1 as `out_col`; a column of that name is replaced.

    Word vectors come from all texts; the network learns from at most `per_class` labelled rows of each class (the bound
    of the sample), never from the held-out fold; only the text is an input of the score. A null or empty text
    has features of zero and the score that follows from them. Without labels of both classes every score is the share of
    label 1, or 0.5. Repeated rows score alike; an empty table gives no rows.
    """
    vectors = word_vectors(summed(docs, BUCKETS * DIMS, context_sums))
    sample, counts = labelled_sample(labels, label, per_class)
    rows = sampled_texts(docs, sample).mapInArrow(_features(vectors, ("doc_id", "label")), "doc_id bigint, label int, features array<double>")
    known = sorted(rows.collect())
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / total, 1e-3), 1 - 1e-3) if total else 0.5
    net = fit(np.array([r["features"] for r in known]).reshape(-1, N_FEATURES), np.array([r["label"] for r in known]), prior)
    return append(docs, out_col, "double", _score(vectors, net, prior))


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score) per row of (doc_id, text), as with_quality."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_quality(docs, labels, per_class, label)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
