"""Vectorized tokens for the trained models: runs of letters, digits or signs, hashed into buckets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fingerprints import _BYTES, _powers, mixed

CHUNK_BYTES = 1 << 18
SPACE, LETTER, DIGIT, SIGN = range(4)
_CLASS = np.full(256, SIGN, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[128:] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_ids(texts: Sequence[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of every text, and the bounds of each text's tokens.

    Letters are lower-cased, but a run of capitals keeps buckets of its own; runs of digits share one per length; signs
    count up to three of a kind.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    kind = _CLASS[data]
    first = kind != SPACE
    change = kind[1:] != kind[:-1]
    # Different signs in a row are different tokens.
    change |= (kind[1:] == SIGN) & (data[1:] != data[:-1])
    first[1:] &= change
    starts = np.flatnonzero(first)
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths))))
    if not len(starts):
        return np.zeros(0, np.int32), bounds
    keep = np.flatnonzero(kind != SPACE)
    before = np.searchsorted(keep, starts)
    sizes = np.diff(np.append(before, len(keep)))
    inside = np.arange(len(keep)) - np.repeat(before, sizes)
    held = data[keep]
    values = _BYTES[_LOWER[held]] * _powers(int(sizes.max()))[inside]
    hashes = np.add.reduceat(values, before)
    kinds = kind[starts]
    capital = np.add.reduceat(((held >= 65) & (held <= 90)).astype(np.int64), before)
    hashes += ((capital == sizes) & (sizes > 1)).astype(np.uint64) * np.uint64(0x51ED270B)
    hashes = np.where(kinds == DIGIT, sizes.astype(np.uint64) + np.uint64(1 << 40), hashes)
    hashes = np.where(kinds == SIGN, data[starts].astype(np.uint64) * np.uint64(4) + np.minimum(sizes, 3).astype(np.uint64), hashes)
    return (mixed(hashes) % np.uint64(buckets)).astype(np.int32), bounds


def text_chunks(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    """The texts as UTF-8 in groups of bounded size; null is empty."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        if group and size + len(data) > CHUNK_BYTES:
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data)
    if group:
        yield group


_BLOCK = 1024


def _blocks(values: np.ndarray, kind: type) -> pa.RecordBatch:
    padded = np.zeros(-(-len(values) // _BLOCK) * _BLOCK, kind)
    padded[: len(values)] = values
    rows = padded.reshape(-1, _BLOCK)
    used = np.flatnonzero(rows.any(1))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=["block", "cells"]
    )


def _sum_blocks(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch["block"].to_pylist(), batch["cells"]):
                row = np.frombuffer(cells.as_py(), kind)
                sums[block] = sums[block] + row if block in sums else row.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in sums.values()], pa.binary())], names=["block", "cells"]
            )

    return run


def summed(docs: DataFrame, size: int, of_texts, column: str = "text", groups_of=text_chunks, kind: type = np.float32) -> np.ndarray:
    """The sum over all texts of a vector of `size` numbers.

    `of_texts` makes one vector of a task's texts (an iterator of byte groups, or of what `groups_of` makes of another column), so each task
    sends one, in numbers of `kind`; their blocks are added in a stream by other tasks, and the driver gets `size` numbers however many
    tasks there are.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _blocks(of_texts(group for batch in batches for group in groups_of(batch[column].to_pylist())), kind)

    parts = docs.select(column).mapInArrow(each, "block int, cells binary").repartition(F.col("block"))
    out = np.zeros(-(-size // _BLOCK) * _BLOCK)
    for r in parts.mapInArrow(_sum_blocks(kind), "block int, cells binary").collect():
        out[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] += np.frombuffer(r["cells"], np.float64)
    return out[:size]
