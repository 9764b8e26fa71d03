"""Log files as DataFrames: discovery, physical line numbers, parsed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import parse, text
from ..operators.numbering import physical_line_numbers
from ..staging import stage
from . import hadoop
from .hidden import hidden_lines

# Suffixes of log files, in any letter case.
LOG_GLOB = "*.{[lL][oO][gG],[tT][xX][tT]}"


_LINE_SCHEMA = "file_path string, relative_path string, source string, host string, line_number bigint, value string"

READ_OPTIONS = {"recursiveFileLookup": "true", "pathGlobFilter": LOG_GLOB}


@dataclass(frozen=True)
class Scan:
    """The lines below a root with `split_columns()`, the number of files they come from, and log files left out."""

    lines: DataFrame | None
    n_files: int
    skipped: list[str]


def open_scan(spark: SparkSession, root: str, on_hidden: str = "read") -> Scan:
    """Start a scan of all log files below `root`, whatever their names.

    Spark can be sent into a hidden folder, but not to a hidden file: those are read by `hidden_lines`, or with
    `on_hidden="skip"` left out and named in `skipped`, or with "fail" an error.
    """
    hidden = _hidden(spark, root, on_hidden)
    skipped = [hadoop.below(spark, uri, root) for uri, _ in hidden.files] if on_hidden == "skip" else []
    lines = _visible(spark, root, hidden, "text")
    n_files = 0 if lines is None else len(lines._jdf.inputFiles())
    scan = None if not n_files else lines.select("value", *split_columns())
    if hidden.files and on_hidden == "read":
        others = hidden_lines(spark, hidden.files)
        scan = others if scan is None else scan.unionByName(others)
        n_files += len(hidden.files)
    return Scan(scan, n_files, skipped)


def _hidden(spark: SparkSession, root: str, on_hidden: str = "read") -> hadoop.Hidden:
    if on_hidden not in ("read", "fail", "skip"):
        raise ValueError(f"on_hidden must be 'read', 'fail' or 'skip', not {on_hidden!r}")
    hidden = hadoop.hidden_below(spark, root, LOG_GLOB)
    if hidden.files and on_hidden == "fail":
        raise ValueError(f"{len(hidden.files)} log files have names that Spark does not read, such as {hidden.files[0][0]}")
    return hidden


def _visible(spark: SparkSession, root: str, hidden: hadoop.Hidden, fmt: str) -> DataFrame | None:
    """The log files below a root that Spark lists, hidden folders included."""
    if not hadoop.exists(spark, root):
        return None
    # Spark takes a path for a pattern; hidden folders are given by their plain names.
    roots = [root, *map(hadoop.as_pattern, hidden.folders)]
    return spark.read.format(fmt).options(**READ_OPTIONS).load(roots)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, relative_path, length, modified) of the log files below `root` (or `root` itself), whatever their names.

    Spark lists the folders, in parallel where there are many; no content is read and no name passes through Python, but for hidden
    files. Times of empty and hidden files are null.
    """
    hidden = _hidden(spark, root)
    listed = _visible(spark, root, hidden, "binaryFile")
    shape = "path string, modified timestamp, length bigint"
    found = spark.createDataFrame([(uri, None, size) for uri, size in hidden.files], shape)
    if listed is not None:
        of_file = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "uri"), ("file_modification_time", "modified"), ("file_size", "length"))]
        # A scan passes over empty files, which the listing has. The two write a URI without an authority differently.
        sizes = listed.select(*of_file).withColumn("key", relative_path(spark, F.col("uri"), root)).drop("uri")
        names = hadoop.listed_names(listed).withColumn("key", relative_path(spark, F.col("path"), root)).join(sizes, "key", "left")
        found = found.unionByName(names.select("path", "modified", F.coalesce("length", F.lit(0)).alias("length")))
    path = F.col("path")
    return found.select(
        given_path(spark, path, root).alias("file_path"), relative_path(spark, path, root).alias("relative_path"), "length", "modified"
    )


def given_path(spark: SparkSession, uri: Column, root: str) -> Column:
    """Path of a file in the caller's own terms: the root as given plus the part below it."""
    below = relative_path(spark, uri, root)
    return F.when(below == "", F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), below))


def relative_path(spark: SparkSession, uri: Column, root: str) -> Column:
    """Path of a file below `root`; empty if the root is the file itself."""
    path = F.regexp_replace(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    absolute = hadoop.absolute_path(spark, root).rstrip("/")
    return F.substring(decoded, len(absolute) + 2, 2**31 - 1)


def scan_lines(spark: SparkSession, root: str, on_hidden: str = "read") -> DataFrame:
    """Every physical line below `root`: (file_path, relative_path, source, host, line_number, value).

    Blank lines are included and keep their numbers. The text is read once, in parallel
    over file splits, and staged; see `physical_line_numbers`.
    """
    return numbered(open_scan(spark, root, on_hidden), root)


def numbered(scan: Scan, root: str) -> DataFrame:
    """The lines of a scan with their numbers."""
    if scan.lines is None:
        return SparkSession.active().createDataFrame([], _LINE_SCHEMA)
    return number_scan(scan.lines, root)


def split_columns() -> list[Column]:
    """Where a line came from: the file and the file split it was read in."""
    return [
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ]


def number_scan(lines: DataFrame, root: str) -> DataFrame:
    """Line numbers and paths for a text scan with `split_columns()`, rows in scan order."""
    return place_scan(lines, root)[0].select(*T.StructType.fromDDL(_LINE_SCHEMA).fieldNames())


def place_scan(lines: DataFrame, root: str) -> tuple[DataFrame, bool]:
    """As number_scan with `block_start`, and whether the lines still stand in the order of their splits."""
    spark = lines.sparkSession
    staged = stage(
        lines.select(
            "uri",
            "block_start",
            F.monotonically_increasing_id().alias("pos"),
            text.decode_lenient(F.col("value")).alias("value"),
        ),
        "lines",
    )
    numbered, in_order = physical_line_numbers(staged)
    path = given_path(spark, F.col("uri"), root)
    named = numbered.select(
        path.alias("file_path"), relative_path(spark, F.col("uri"), root).alias("relative_path"), "block_start", "line_number", "value"
    )
    return named.withColumns({"source": parse.source_of(F.col("file_path")), "host": parse.host_of(F.col("file_path"))}), in_order


def parse_records(
    lines: DataFrame,
    job_id: str | None = None,
    reference_year: int | None = None,
    on_bad_timestamp: str = "null",
    id_mode: str = "stable",
) -> DataFrame:
    """Turn (file_path, line_number, value) into parsed records; blank lines are dropped.

    Source and host are taken over if the lines have them already. Other columns are kept.
    """
    raw = F.col("raw_text")
    path = F.col("file_path")
    job = F.lit(job_id).cast("string")
    kept = lines.withColumn("raw_text", text.strip(F.col("value"))).where(raw != "")
    return kept.select(
        parse.record_id(job, path, F.col("line_number"), id_mode).alias("id"),
        parse.timestamp(raw, reference_year, on_bad_timestamp).alias("timestamp"),
        (F.col("source") if "source" in lines.columns else parse.source_of(path).alias("source")),
        (F.col("host") if "host" in lines.columns else parse.host_of(path).alias("host")),
        job.alias("job_id"),
        parse.severity(raw).alias("severity"),
        parse.component(raw).alias("component"),
        raw,
        path,
        F.col("line_number"),
        *[c for c in lines.columns if c not in ("file_path", "line_number", "value", "source", "host")],
    )


def load_records(
    spark: SparkSession, root: str, job_id: str | None = None, on_hidden: str = "read", **options
) -> DataFrame:
    """Parsed records of all log files below `root`."""
    return parse_records(scan_lines(spark, root, on_hidden), job_id, **options)
