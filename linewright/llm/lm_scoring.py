"""Documents scored by masked pseudo-likelihood.

A window network predicts each token from two tokens on either side, as if it were masked: the class of the token
from a hidden layer over the context, then the token by its share of its class. The sum of the conditional log-probabilities over
a document is its pseudo-log-likelihood. Token counts come from all documents. Training is
by parameter mixing: in each round every task starts from the same parameters, trains on every position of its own
documents and sends them back once; the mean, weighted by positions, starts the next round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .tokens import summed, text_chunks, token_ids

BUCKETS = 1 << 15
# The edge of a text, and every bucket.
INPUTS = BUCKETS + 1
CLASSES = 48
DIMS = 16
HIDDEN = 24
OFFSETS = (-2, -1, 1, 2)
STRIDE = 1
ROUNDS = 2
_BATCH = 512
GROUP_TOKENS = 65536
_ROWS = 2048
_SHAPES = {"embed": (INPUTS, DIMS), "mix": (len(OFFSETS), DIMS, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES), "level": (CLASSES,)}


class Tokens(NamedTuple):
    """Buckets of the tokens of some texts, and the bounds of the texts."""

    ids: np.ndarray
    bounds: np.ndarray


# Texts as they are, or their tokens.
Group = list[bytes] | Tokens


def _tokens(group: Group) -> Tokens:
    return group if isinstance(group, Tokens) else Tokens(*token_ids(group, BUCKETS))


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids): the buckets of a text's tokens, two bytes each."""
    for batch in batches:
        ids = []
        for group in text_chunks(batch["text"].to_pylist()):
            found, bounds = token_ids(group, BUCKETS)
            found = found.astype(np.uint16)
            ids += [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def token_groups(values: Sequence[bytes]) -> Iterator[Tokens]:
    """Tokenized texts in groups of bounded size; a longer text goes alone."""
    at = 0
    while at < len(values):
        to, size = at, 0
        while to < len(values) and (to == at or size + len(values[to]) <= 2 * GROUP_TOKENS):
            size += len(values[to])
            to += 1
        ids = np.frombuffer(b"".join(values[at:to]), np.uint16).astype(np.int64)
        yield Tokens(ids, np.concatenate(([0], np.cumsum([len(v) // 2 for v in values[at:to]]))))
        at = to


def bucket_counts(groups: Iterator[Group]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for group in groups:
        out += np.bincount(_tokens(group).ids, minlength=BUCKETS)
    return out


class Vocabulary:
    """Input number, class and share of its class for every bucket, from corpus counts."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(BUCKETS, np.int64)
        rank[order] = np.arange(BUCKETS)
        # Input 0 is the edge of a text; frequent buckets stand together.
        self.inputs = (rank + 1).astype(np.int32)
        # The most frequent tokens are classes of their own; the others share classes of about equal mass.
        own = CLASSES - 16
        smooth = counts[order] + 0.5
        mass = np.cumsum(smooth[own:])
        shared = own + np.minimum(mass * 16 / mass[-1], 15.999).astype(np.int64)
        classes = np.concatenate([np.arange(own), shared])
        self.classes = classes[rank].astype(np.int32)
        totals = np.bincount(classes, smooth, CLASSES)
        self.log_share = np.log(smooth / totals[classes])[rank]
        self.level = np.log(totals / totals.sum())


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(5))
    p = {name: random.normal(0, 0.1, shape).astype(np.float32) for name, shape in _SHAPES.items()}
    p["mix"] *= 3
    p["bias"][:] = 0
    p["level"][:] = vocabulary.level
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].reshape(-1) for name in _SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def windows(group: Group, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context inputs of every token, buckets of the tokens, and the bounds of the texts."""
    ids, bounds = _tokens(group)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inputs = vocabulary.inputs[ids]
    context = np.zeros((len(ids), len(OFFSETS)), np.int32)
    for k, step in enumerate(OFFSETS):
        a, b = max(0, -step), len(ids) - max(0, step)
        if a < b:
            same = owner[a:b] == owner[a + step : b + step]
            context[a:b, k] = np.where(same, inputs[a + step : b + step], 0)
    return context, ids, bounds


def _train_batch(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> None:
    n = len(target)
    vectors = p["embed"][context].reshape(n, -1)
    mix = p["mix"].reshape(-1, HIDDEN)
    hidden = np.tanh(vectors @ mix + p["bias"])
    logits = hidden @ p["out"] + p["level"]
    logits -= logits.max(1, keepdims=True)
    q = np.exp(logits)
    q /= q.sum(1, keepdims=True)
    q[np.arange(n), target] -= 1
    q *= rate / n
    back = (q @ p["out"].T) * (1 - hidden * hidden)
    to_vectors = back @ mix.T
    p["out"] -= hidden.T @ q
    p["level"] -= q.sum(0)
    p["mix"] -= (vectors.T @ back).reshape(p["mix"].shape)
    p["bias"] -= back.sum(0)
    # In one dimension, where numpy adds up repeated places without a loop over rows.
    places = context.reshape(-1, 1).astype(np.intp) * DIMS + np.arange(DIMS)
    np.subtract.at(p["embed"].reshape(-1), places.reshape(-1), to_vectors.reshape(-1))


def trained(start: np.ndarray, vocabulary: Vocabulary, stride: int = STRIDE, rate: float = 1.0):
    """A function that trains on a task's texts and returns its parameters times its positions, and the positions."""

    def run(groups: Iterator[Group]) -> np.ndarray:
        p, seen = shaped(start), 0
        for group in groups:
            context, ids, _ = windows(group, vocabulary)
            picked = np.arange(seen % stride, len(ids), stride)
            for at in range(0, len(picked), _BATCH):
                rows = picked[at : at + _BATCH]
                _train_batch(p, context[rows], vocabulary.classes[ids[rows]], rate)
            seen += len(picked)
        return np.append(flat(p) * seen, seen)

    return run


class Scorer:
    """Log-probabilities of whole texts; the context's share of the hidden layer is a table look-up."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.tables = [(p["embed"] @ p["mix"][k]).astype(np.float32) for k in range(len(OFFSETS))]
        self.bias, self.out, self.level = p["bias"], p["out"], p["level"]
        self.vocabulary = vocabulary

    def score(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and sum of log-probabilities per text."""
        context, ids, bounds = windows(group, self.vocabulary)
        logp = np.empty(len(ids))
        for at in range(0, len(ids), _ROWS):
            rows = slice(at, at + _ROWS)
            hidden = self.bias + sum(table[context[rows, k]] for k, table in enumerate(self.tables))
            np.tanh(hidden, out=hidden)
            logits = hidden @ self.out + self.level
            logits -= logits.max(1, keepdims=True)
            own = logits[np.arange(len(logits)), self.vocabulary.classes[ids[rows]]]
            logp[rows] = own - np.log(np.exp(logits).sum(1)) + self.vocabulary.log_share[ids[rows]]
        total = np.concatenate(([0.0], np.cumsum(logp)))
        return np.diff(bounds), total[bounds[1:]] - total[bounds[:-1]]


def score_documents(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) per row of (doc_id, text).

    A text without tokens, empty or null, has a likelihood of 0 and a null mean. Every document is
    counted, trained on and scored whole; repeated rows score alike. The model depends on which texts a task trains on, so other
    input splits give other scores; on the same splits only the order in which parameters are added can change the last digits. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts are read and cut once; all later passes read two bytes a token.
    tokens = stage(docs.mapInArrow(_tokenized, "doc_id bigint, ids binary"), "tokens")
    vocabulary = Vocabulary(summed(tokens, BUCKETS, bucket_counts, "ids", token_groups, np.float64))
    values = flat(initial(vocabulary))
    for _ in range(rounds):
        mixed = summed(tokens, len(values) + 1, trained(values, vocabulary, stride), "ids", token_groups)
        if mixed[-1]:
            values = (mixed[:-1] / mixed[-1]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The tables are six times as large as the parameters that they are made of.
        scorer = Scorer(shaped(values), vocabulary)
        for batch in batches:
            pairs = [scorer.score(group) for group in token_groups(batch["ids"].to_pylist())]
            n = np.concatenate([a for a, _ in pairs]) if pairs else np.zeros(0, np.int64)
            total = np.concatenate([b for _, b in pairs]) if pairs else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "n_tokens", "log_likelihood"]
            )

    scored = tokens.mapInArrow(run, "doc_id bigint, n_tokens bigint, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
