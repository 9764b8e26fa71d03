"""Arrays of small counters of bounded size, filled by tasks and added up block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_BLOCK = 1 << 14
# Cells that a task holds before it sends them on.
_HELD = 1 << 20


def table_size(rows: int, per_row: int, least: int, most: int) -> int:
    """The power of two from `least` to `most` that gives `per_row` cells to each of `rows`."""
    size = least
    while size < min(most, rows * per_row):
        size *= 2
    return size


def _parts(cells: np.ndarray, top: int) -> pa.RecordBatch:
    used, counts = np.unique(cells, return_counts=True)
    blocks, starts = np.unique(used // _BLOCK, return_index=True)
    places = np.split((used % _BLOCK).astype(np.uint16), starts[1:])
    held = np.split(np.minimum(counts, top).astype(np.uint8), starts[1:])
    columns = [pa.array(blocks.astype(np.int32)), pa.array([x.tobytes() for x in places], pa.binary()), pa.array([x.tobytes() for x in held], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "places", "counts"])


def _added(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(batch["block"].to_pylist(), batch["places"], batch["counts"]):
                row = sums.setdefault(block, np.zeros(_BLOCK, np.uint8))
                at = np.frombuffer(places.as_py(), np.uint16)
                row[at] = np.minimum(row[at].astype(np.int16) + np.frombuffer(counts.as_py(), np.uint8), top)
        for block, row in sums.items():
            cells = row.tobytes() if top > 1 else np.packbits(row).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells], pa.binary())], names=["block", "cells"])

    return run


def counted(rows: DataFrame, cells_of: Callable[[pa.RecordBatch], np.ndarray], size: int, top: int) -> np.ndarray:
    """How often each of `size` cells was named by `cells_of` over all rows, counts above `top` left at `top`.

    With top = 1 the result holds eight cells a byte (numpy.packbits). A task sends the cells it has met, other tasks add
    them up per block, and the driver gets the finished blocks: `size` bytes or bits, however many rows there are.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(cells_of(batch))
            if sum(map(len, held)) >= _HELD:
                yield _parts(np.concatenate(held), top)
                held = []
        if held:
            yield _parts(np.concatenate(held), top)

    parts = rows.mapInArrow(each, "block int, places binary, counts binary").repartition(F.col("block"))
    width = _BLOCK if top > 1 else _BLOCK // 8
    out = np.zeros(max(size // _BLOCK, 1) * width, np.uint8)
    for r in parts.mapInArrow(_added(top), "block int, cells binary").toLocalIterator():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["cells"], np.uint8)
    return out
