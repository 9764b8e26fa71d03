"""Columns made in Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Rows handed to a function at once; bounds what one call keeps in memory besides its batch.
ROWS = 256


def append(df: DataFrame, column: str, kind: str, run: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """`df` with one more column, made by `run` from the batches of its rows; a column of that name is replaced."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, run(part)], names=[*part.schema.names, column])

    df = df.drop(column)
    return df.mapInArrow(each, df.withColumn(column, F.lit(None).cast(kind)).schema)
