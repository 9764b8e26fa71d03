"""Ingest: scan, parse, normalize and store a tree of log files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.normalize import normalize
from ..functions.rules import DEFAULT_RULES, Rule
from ..sources import files
from ..sources.record_table import RecordTable
from ..staging import scratch


@dataclass(frozen=True)
class IngestSummary:
    files_processed: int
    log_lines_ingested: int
    records_written: int
    table_path: str
    files_skipped: int = 0


def normalized_records(records: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    return records.withColumn("normalized_text", normalize(F.col("raw_text"), rules))


def same_job(job_id: str | None) -> Column:
    return F.col("job_id").eqNullSafe(F.lit(job_id).cast("string"))


def store_records(table: RecordTable, records: DataFrame, job_id: str | None, id_mode: str = "stable") -> int:
    """Upsert the records of one run.

    A scan yields every (file, line) once, so ids are unique within it. Stable ids
    include the job, so they can only meet rows of the same job; random ones meet none.
    """
    stable = id_mode == "stable"
    return table.upsert(records, unique_ids=True, scope=same_job(job_id) if stable else None, new_ids=not stable)


def ingest(
    spark: SparkSession,
    root: str,
    table_path: str,
    job_id: str | None = None,
    rules: Sequence[Rule] = DEFAULT_RULES,
    id_mode: str = "stable",
    on_hidden: str = "read",
    **parse_options,
) -> IngestSummary:
    """Ingest all log files below `root`; a repeated run with stable ids replaces its rows.

    Files are counted in the listing that the scan reads from. For `on_hidden` see `files.open_scan`.
    """
    table = RecordTable(spark, table_path)
    table.create()
    with scratch(spark):
        scan = files.open_scan(spark, root, on_hidden)
        records = files.parse_records(files.numbered(scan, root), job_id, id_mode=id_mode, **parse_options)
        written = store_records(table, normalized_records(records, rules), job_id, id_mode)
    return IngestSummary(scan.n_files, written, written, table_path, len(scan.skipped))
