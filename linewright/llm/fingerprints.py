"""Vectorized hashing of words inside Arrow tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

# White space of the word definition: the space and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20250101))
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_PAIR = np.uint64(0xD1342543DE82EF95)
# Texts are hashed together up to this many bytes; a longer text goes alone.
CHUNK_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the bounds of each text's words among them."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    ends_of_texts = np.cumsum(lengths)
    space = _SPACE[data]
    # A word starts after white space or at the front, and ends before white space.
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    keep = np.flatnonzero(~space)
    before = np.searchsorted(keep, starts)
    sizes = np.diff(np.append(before, len(keep)))
    inside = np.arange(len(keep)) - np.repeat(before, sizes)
    values = _BYTES[data[keep]] * _powers(int(sizes.max()))[inside]
    return mixed(np.add.reduceat(values, before) + sizes.astype(np.uint64)), bounds


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` consecutive words; fewer words count as one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = mixed(out * _PAIR + words[i : i + n])
    return np.unique(out)


def chunks(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    """The texts as UTF-8 in groups of bounded size, ASCII letters lower-cased; null is empty."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()
        if group and size + len(data) > CHUNK_BYTES:
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data)
    if group:
        yield group


def shingle_sets(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """One shingle set per text."""
    for group in chunks(texts):
        hashes, bounds = word_hashes(group)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield shingle_set(hashes[a:b], width)


def digest(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
