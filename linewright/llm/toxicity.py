"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding maps look-alike letters and digits to one skeleton, on both sides. The lexicon joins a short list of
general insults with words and word beginnings that are significantly more frequent in toxic texts of the labelled
sample. Weights are smoothed log-odds; matches inside exception phrases don't count; the sum is normalised by length and
calibrated on the same sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .folds import held_out, labelled_sample, sampled_texts

# General insults, with no claim to be complete; the labels add what a corpus uses.
SEED = (
    "idiot moron stupid scum loser pathetic worthless disgusting trash clown imbecile dumbass bastard bitch asshole "
    "retard subhuman vermin crap shit fuck fucking whore slut cunt"
).split()
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "class clown", "scum bag liner", "pond scum", "idiot proof", "idiot light",
    "stupid simple", "sore loser rule", "keep it simple stupid",
)
PER_CLASS = 4000
MIN_STEM, MAX_STEM = 4, 10
_END = "$"

# Letters of other scripts that look Latin, digits in place of letters; i, l and 1 are one.
_LOOKS = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏi ԛq ԝw кk мm тt вb нh αa βb εe ιi κk οo ρp τt υu νv χx ηn ıi ɡg ℓi ᴏo "
    "0o 1i 3e 4a 5s 7t 8b 9g @a li"
)


def _table() -> dict[int, str]:
    table = {ord(p[0]): p[1] for p in _LOOKS.split()}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)}
    table[0xFF4C] = "i"
    return table


_FOLD = _table()
# Zero-width characters vanish.
_FOLD |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def _words(folded: str) -> Iterator[str]:
    import re

    return iter(re.findall(r"[^\W\d_]+", folded))


def stems(folded: str) -> set[str]:
    """Beginnings of the words of a text, and the words themselves with an end mark."""
    out = set()
    for word in set(_words(folded)):
        if len(word) < MIN_STEM - 1:
            continue
        out.add(word + _END)
        out.update(word[:n] for n in range(MIN_STEM, min(len(word), MAX_STEM) + 1))
    return out


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("stem", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            counts[label].update(stems(fold(text or "")))
        names = list({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][s] for s in names], pa.int64()), pa.array([counts[0][s] for s in names], pa.int64())],
            schema=schema,
        )


def evidence(a: int, c: int, base: float) -> float:
    """Natural log of the odds against seeing `a` of `a + c` texts toxic by chance at the rate `base`."""
    n, share = a + c, a / (a + c)
    if share <= base:
        return 0.0
    return n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if c else 0.0))


def _evidence(base: float) -> Column:
    """`evidence` of the columns toxic and clean; null where no text is toxic."""
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    against = F.when(F.col("clean") > 0, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when((F.col("toxic") > 0) & (share > base), n * (share * F.log(share / base) + against))


def choose(counts: Sequence[tuple[str, int, int]], toxic: int, clean: int, n_stems: int) -> dict[str, float]:
    """Weights of the stems that pass: significant against all that were tried, rarely clean, and not better told by a longer one."""
    base = toxic / max(1, toxic + clean)
    passed = {}
    for stem, a, c in counts:
        if a and a >= 9 * c and evidence(a, c, base) > math.log(max(2, n_stems)) + 3:
            passed[stem] = a, c
    longer: Counter = Counter()
    for stem, (a, _) in passed.items():
        bare = stem.removesuffix(_END)
        for n in range(MIN_STEM, len(bare) + (stem != bare)):
            longer[bare[:n]] = max(longer[bare[:n]], a)
    out = {_skeleton_end(s): math.log(2.0 / 0.2) for s in SEED}
    for stem, (a, c) in passed.items():
        if longer[stem] < 0.95 * a:
            out[stem] = math.log(((a + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))
    # A seed word that the sample shows in clean texts loses its weight.
    known = {s: (a, c) for s, a, c in counts}
    for s in map(_skeleton_end, SEED):
        a, c = known.get(s, (0, 0))
        if a + c:
            out[s] = math.log(((a + 2.0) / (toxic + 2)) / ((c + 0.2) / (clean + 2)))
    return {s: w for s, w in out.items() if w > 0}


def _skeleton_end(word: str) -> str:
    return fold(word) + _END


class Matcher:
    """The automaton over the lexicon and the exception phrases."""

    def __init__(self, weights: Sequence[tuple[str, float]], exceptions: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list[tuple[bool, float]]] = {}
        for stem, weight in weights:
            entries.setdefault(stem.removesuffix(_END), []).append((stem.endswith(_END), weight))
        for phrase in exceptions:
            entries.setdefault(fold(phrase), []).append((True, -1.0))
        for key, values in entries.items():
            self.automaton.add_word(key, (len(key), values))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def total(self, folded: str) -> tuple[float, int]:
        """Sum of the weights and number of the words that match outside exception phrases."""
        if self.empty:
            return 0.0, 0
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, values) in self.automaton.iter(folded):
            first = last - size + 1
            if first and folded[first - 1].isalpha():
                continue
            inside = last + 1 < len(folded) and folded[last + 1].isalpha()
            for whole, weight in values:
                if whole and inside:
                    continue
                if weight < 0:
                    spared.append((first, last))
                else:
                    found[first] = max(weight, found.get(first, 0.0))
        if spared:
            # Phrases in order, so that one sweep tells which words they hold.
            spared.sort()
            reach, at, kept = -1, 0, {}
            for first in sorted(found):
                while at < len(spared) and spared[at][0] <= first:
                    reach = max(reach, spared[at][1])
                    at += 1
                if first > reach:
                    kept[first] = found[first]
            found = kept
        return sum(found.values()), len(found)


@lru_cache(maxsize=4)
def _matcher(weights: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> Matcher:
    return Matcher(weights, exceptions)


def measures(matcher: Matcher, text: str | None) -> tuple[float, float, int]:
    """(sum, sum per hundred words, matches) on a log scale; nothing matches in an empty text."""
    folded = fold(text or "")
    total, n = matcher.total(folded)
    words = len(folded.split())
    return math.log1p(total), math.log1p(100 * total / (words + 20)), n


def _measure(weights: tuple[tuple[str, float], ...], exceptions: tuple[str, ...], keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(weights, exceptions)
        for batch in batches:
            rows = [measures(matcher, t.as_py()) for t in batch["text"]]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64())],
                names=[*keep, "sum", "density", "matches"],
            )

    return run


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Logistic weights (bias, sum, density) by Newton's method with a small ridge, the sample weighed to the true share of toxic texts."""
    start = np.array([-3.0, 1.5, 1.0])
    if len(set(y.tolist())) < 2:
        return tuple(start)
    design = np.column_stack([np.ones(len(x)), x])
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * len(y) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge @ w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: Sequence[str] = EXCEPTIONS, label: str = "toxic"
) -> DataFrame:
    """(doc_id, held_out, score, matches) per row of (doc_id, text).

    Learns from at most `per_class` labelled rows of each class (the bound of the sample), never from the held-out fold; only the text is an
    input of the score. Null and empty texts match nothing and get the score of a text without matches. Without labels the
    general list decides. Repeated rows score alike; other columns are ignored.
    """
    sample, counts = labelled_sample(labels, label, per_class)
    # A text counts once, however many rows of the sample's ids have it.
    texts = stage(sampled_texts(docs, sample).select("text", "label").distinct(), "sample")
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sizes.get(c, 0) for c in (1, 0))
    weights = choose([], toxic, clean, 0)
    if toxic and clean:
        tried = texts.mapInArrow(_count_stems, "stem string, toxic bigint, clean bigint").groupBy("stem").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
        )
        tried = stage(tried, "stems")
        n_stems = tried.count()
        # What passes the test of significance is a lexicon; its size is bounded by the sample's texts.
        telling = tried.where((F.col("toxic") >= 9 * F.col("clean")) & (_evidence(toxic / (toxic + clean)) > math.log(max(2, n_stems)) + 3))
        seeds = tried.where(F.col("stem").isin(*map(_skeleton_end, SEED)))
        rows = {r["stem"]: (r["stem"], r["toxic"], r["clean"]) for r in telling.unionByName(seeds).collect()}
        weights = choose(list(rows.values()), toxic, clean, n_stems)
    lexicon, phrases = tuple(sorted(weights.items())), tuple(exceptions)
    known = texts.mapInArrow(_measure(lexicon, phrases, ("label",)), "label int, sum double, density double, matches bigint").collect()
    x = np.array([(r["sum"], r["density"]) for r in known]).reshape(-1, 2)
    y = np.array([r["label"] for r in known])
    total = sum(counts.values())
    bias, by_sum, by_density = calibrate(x, y, counts.get(1, 0) / total if total else 0.1)
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _measure(lexicon, phrases, ("doc_id",)), "doc_id bigint, sum double, density double, matches bigint"
    )
    logit = F.lit(bias) + F.col("sum") * by_sum + F.col("density") * by_density
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"), "matches")
