"""Intermediate tables in the cluster's shared folder.

Operators that read one intermediate result several times write it once as Parquet:
later passes then read only the columns they need, the optimizer sees true sizes, and a
lost executor costs a re-read instead of a recomputation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .sources import hadoop

# Regex work costs much time per byte, so a task should be able to read a small piece.
ROW_GROUP_BYTES = 16 * 1024 * 1024
# Rows of a few numbers that a task may well take: a file for fewer costs more than its rows.
ROWS_PER_TASK = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors must share."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/linewright/{name}-{uuid.uuid4().hex}"


_OWNED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own the tables that are staged inside: they are deleted at the end, so nothing that reads them may be used after it.

    Frames that came in from outside keep what they read. Without it a staged table stays, as results may read it later.
    """
    mark = _OWNED.set([])
    try:
        yield
    finally:
        paths = _OWNED.get()
        _OWNED.reset(mark)
        for path in paths:
            hadoop.delete(spark, path)


def tasks_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """How many tasks are enough for a table of at most `rows` rows: two per core, and more as the rows grow."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task))


def stage(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return a frame that reads it back.

    With `tasks`, shuffle partitions in excess of that number are written together.
    """
    spark = df.sparkSession
    if tasks:
        df = df.coalesce(tasks)
    path = new_path(spark, name)
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
