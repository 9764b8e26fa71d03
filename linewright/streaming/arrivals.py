"""Ingest of log files as they arrive: the batch ingest, run once per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import DEFAULT_RULES, Rule
from ..plans.ingest import normalized_records
from ..sources.files import LOG_GLOB, READ_OPTIONS, number_scan, parse_records, split_columns
from ..sources.hadoop import hidden_below
from ..sources.record_table import RecordTable
from ..staging import scratch


def ingest_arrivals(
    spark: SparkSession,
    root: str,
    table_path: str,
    checkpoint: str,
    job_id: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    files_per_batch: int = 10_000,
    on_hidden: str = "fail",
    **parse_options,
) -> StreamingQuery:
    """Ingest files new since the last run and stop.

    A file is read whole within one micro-batch, so its lines can be numbered there. A micro-batch
    that is run again after a failure replaces what it wrote itself, by its number and the checkpoint's name, and reads nothing
    else of the table. A file counts as known once it was read: lines appended to it later are not ingested. A file stream passes over
    hidden names: log files that have one when the stream starts are an error, or with `on_hidden="skip"` are left out.
    """
    if on_hidden not in ("fail", "skip"):
        raise ValueError(f"on_hidden must be 'fail' or 'skip', not {on_hidden!r}")
    hidden = hidden_below(spark, root, LOG_GLOB)
    if on_hidden == "fail" and (hidden.files or hidden.folders):
        raise ValueError(f"{len(hidden.files)} log files and {len(hidden.folders)} folders have names that a stream does not read, such as {(hidden.folders + [f for f, _ in hidden.files])[0]}")
    table = RecordTable(spark, table_path)
    table.create()

    def store(lines: DataFrame, batch: int) -> None:
        with scratch(spark):
            records = parse_records(number_scan(lines, root), job_id, **parse_options)
            table.replace_load(normalized_records(records, rules), f"{checkpoint}#{batch}")

    arriving = (
        spark.readStream.format("text")
        .options(**READ_OPTIONS, maxFilesPerTrigger=str(files_per_batch))
        .load(root)
        .select("value", *split_columns())
    )
    return (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
