"""Labelled line sets: one text file with line labels, or a log tree with a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import text
from ..operators.labels import label_by_file_line, label_by_index, last_wins
from ..operators.numbering import dense_index, index_in_place
from . import files, hadoop
from .label_json import read_label_document

# File names of the two layouts.
LINES_FILE = "logs.txt"
LABELS_FILE = "labels.json"
MANIFEST_FILE = "benchmark_manifest.json"


@dataclass(frozen=True)
class LabelledLines:
    """Name, kind and location of a set; `records` has the EVAL_RECORD columns."""

    name: str
    kind: str
    path: str
    records: DataFrame


def load_labelled(
    spark: SparkSession, path: str, mode: str = "auto", labels: DataFrame | None = None
) -> LabelledLines:
    """Load a labelled set; `auto` looks at which files exist.

    Label files are single JSON documents, whole or in parts, parsed in parallel (see label_json). Labels
    can be passed as a frame with the same columns instead.
    """
    mode = resolve_mode(spark, path, mode)
    if mode == "local":
        return load_line_file(spark, path, labels)
    if mode == "synthetic":
        return load_log_tree(spark, path, labels)
    raise ValueError(f"unsupported mode: {mode}")


def resolve_mode(spark: SparkSession, path: str, mode: str) -> str:
    if mode != "auto":
        return mode
    has_both = all(hadoop.exists(spark, f"{path}/{name}") for name in (LINES_FILE, LABELS_FILE))
    return "local" if has_both else "synthetic"


def _read_label_file(spark: SparkSession, path: str, schema) -> tuple[str | None, DataFrame]:
    record = schema["records"].dataType.elementType
    return read_label_document(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in record))


def _required_number(name: str):
    """A label id as a number; label files may quote it."""
    present = F.coalesce(F.col(name), F.raise_error(F.lit(f"label without {name}")))
    return present.cast("decimal(38,9)").cast("bigint")


def read_line_labels(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """(name, labels by index) of a labels file; the last of several labels counts."""
    name, labels = _read_label_file(spark, path, schemas.LABEL_FILE)
    keyed = labels.withColumn("index", _required_number("line_index"))
    return name, last_wins(keyed, ["index"], ["position"])


def read_manifest(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """(name, labels by file and line number) of a manifest; the last of several counts."""
    name, labels = _read_label_file(spark, path, schemas.MANIFEST_FILE)
    keyed = labels.withColumn("line_number", _required_number("line_number"))
    return name, last_wins(keyed, ["file", "line_number"], ["position"])


def load_line_file(spark: SparkSession, path: str, labels: DataFrame | None = None) -> LabelledLines:
    """A text file whose non-blank lines are numbered from 1 and labelled by that number.

    `logs.txt` may also be a folder of text files, taken in order of their names.
    """
    name = None
    if labels is None:
        name, labels = read_line_labels(spark, f"{path}/{LABELS_FILE}")
    lines = spark.read.text(f"{path}/{LINES_FILE}").select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block_start"),
        text.decode_strict(F.col("value")).alias("value"),
    )
    pieces = lines.select(
        "uri", "block_start", F.explode(F.split("value", text.EXTRA_LINE_BREAKS)).alias("raw_text")
    ).where(text.not_blank(F.col("raw_text")))
    order = [F.split("uri", "/"), F.col("first")]
    indexed = index_in_place(pieces, ["uri", "block_start"], F.min("block_start"), order)
    missing = [F.lit(None).cast(kind).alias(column) for column, kind in _FILE_COLUMNS]
    records = label_by_index(indexed.select("index", "raw_text", *missing), labels)
    return LabelledLines(name or hadoop.base_name(path), "local", path, _eval_columns(records))


_FILE_COLUMNS = [("source", "string"), ("host", "string"), ("file_path", "string"), ("line_number", "bigint")]


def load_log_tree(spark: SparkSession, path: str, labels: DataFrame | None = None) -> LabelledLines:
    """A tree of log files, labelled by (relative path, line number) if a manifest exists."""
    name = None
    manifest = f"{path}/{MANIFEST_FILE}"
    if labels is None and hadoop.exists(spark, manifest):
        name, labels = read_manifest(spark, manifest)
    records = _indexed_tree(spark, path)
    if labels is None:
        empty = [F.lit(None).cast("string").alias(c) for c in ("expected_template", "expected_group_id")]
        records = records.select("*", *empty)
    else:
        records = label_by_file_line(records.withColumnRenamed("relative_path", "file"), labels)
    return LabelledLines(name or hadoop.base_name(path), "synthetic", path, _eval_columns(records))


def _indexed_tree(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log tree numbered from 1 over all files, files ordered by their path components."""
    scan = files.open_scan(spark, path)
    if scan.lines is None:
        return files.load_records(spark, path).withColumn("index", F.lit(None).cast("bigint"))
    lines, in_order = files.place_scan(scan.lines, path)
    records = files.parse_records(lines)
    parts = F.split("relative_path", "/")
    if in_order:
        return index_in_place(records, ["relative_path", "block_start"], F.min("line_number"), [parts, F.col("first")])
    return dense_index(records.withColumn("_parts", parts), ["_parts", "line_number"]).drop("_parts")


def _eval_columns(records: DataFrame) -> DataFrame:
    return records.select(*schemas.EVAL_RECORD.fieldNames())
