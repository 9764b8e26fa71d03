"""Log lines derived from the `events` and `documents` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..staging import new_path
from . import files

# One column expression per line part; see the README for the shape of a line.
_TIME = """case event_id % 5
    when 0 then concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z ')
    when 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS ')
    when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss ')
    when 3 then date_format(ts, 'MMM dd HH:mm:ss ')
    else '' end"""
_LEVEL = """case event_type when 'error' then 'ERROR ' when 'purchase' then 'INFO '
    when 'signup' then 'WARNING ' when 'click' then 'DEBUG ' else '' end"""
_COMPONENT = "case when event_type = 'view' then '' else concat('[', event_type, '] ') end"
_UUID = """case when event_id % 3 = 0 then concat(' uuid ', substring(digest, 1, 8), '-', substring(digest, 9, 4), '-',
    substring(digest, 13, 4), '-', substring(digest, 17, 4), '-', substring(digest, 21, 12)) else '' end"""
_LINE = f"""case when event_id % 97 = 13 then ' \t ' else concat(
    case when event_id % 7 = 0 then '\t ' else '' end,
    {_TIME}, {_LEVEL}, {_COMPONENT}, 'user ', user_id, ' node', user_id % 8,
    ' from 10.0.', user_id % 256, '.', event_id % 256, ' took ', event_id % 5000,
    ' ms amount ', cast(value as decimal(12,2)), ' delta -', event_id % 10,
    ' open /var/log/u', user_id, '/run.log addr 0x', lower(hex(event_id + 4096)),
    ' request_id=req', lpad(cast(event_id as string), 12, '0'), {_UUID},
    case when event_id % 7 = 1 then '  ' else '' end) end"""
_FILE = """concat('/logs/', event_type, '_node', user_id % 8,
    case when event_type = 'view' then '.txt' else '.log' end)"""
_LABEL = "case when event_id % 11 = 5 then null else concat(event_type, '_', user_id % 3) end"
_EXPECTED = f"""case when event_id % 4 = 1 then null else concat(
    '<INT>-<INT>-<INT> <INT>:<INT>:<INT> ', {_LEVEL}, {_COMPONENT}, 'user <INT> ',
    case when event_id % 3 = 1 then '<VAR>' else concat('node', user_id % 8) end,
    ' from <IP> took <DURATION> amount <FLOAT> delta <INT> open <PATH> addr <HEX> request_id=',
    case when event_id % 3 = 1 then '<id>' else '<ID>' end) end"""
_TREE_FILE = "concat(event_type, '_node', user_id % 8, '_', event_id div 16777216)"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    events = _read(spark, sf_dir, "events").select(*columns)
    return events.withColumn("digest", F.md5(F.col("event_id").cast("string")))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One physical log line per event: (event_id, event_type, user_id, file_path, line_number, value)."""
    events = _events(spark, sf_dir)
    return events.selectExpr(
        "event_id",
        "event_type",
        "user_id",
        f"{_FILE} as file_path",
        "event_id + 1 as line_number",
        f"{_LINE} as value",
    )


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped non-blank event lines: (event_id, index, raw_text)."""
    lines = event_lines(spark, sf_dir).select(
        "event_id",
        (F.col("event_id") + 1).alias("index"),
        text.strip(F.col("value")).alias("raw_text"),
    )
    return lines.where("raw_text <> ''")


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of event lines, some absent: (index, file, line_number, expected_group_id, expected_template).

    Labels both split and merge what the rules produce.
    """
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id + 1 as index",
        f"{_FILE} as file",
        "event_id + 1 as line_number",
        f"{_LABEL} as expected_group_id",
        f"{_EXPECTED} as expected_template",
    )


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped non-blank event lines with their labels as columns of the same row."""
    events = _events(spark, sf_dir)
    lines = events.selectExpr(
        "event_id + 1 as index",
        f"{_LINE} as value",
        f"{_LABEL} as expected_group_id",
        f"{_EXPECTED} as expected_template",
    )
    stripped = lines.withColumn("raw_text", text.strip(F.col("value"))).where("raw_text <> ''")
    return stripped.select("index", "raw_text", "expected_group_id", "expected_template")


def write_log_tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the event lines as a tree of text files in the shared folder; return its root.

    The file of a line follows from its event, and no file gets more than 2**24 lines.
    """
    root = new_path(spark, "log-tree")
    lines = event_lines(spark, sf_dir).selectExpr("event_id", f"{_TREE_FILE} as log", "value")
    (
        lines.repartition("log")
        .sortWithinPartitions("log", "event_id")
        .select("log", "value")
        .write.partitionBy("log")
        .text(root)
    )
    return root


def write_line_set(spark: SparkSession, sf_dir: str) -> str:
    """Write the event lines in order as a labelled set of one line file (a folder of parts); return its folder."""
    root = new_path(spark, "line-set")
    lines = event_lines(spark, sf_dir).select("event_id", "value")
    ordered = lines.repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select("value").write.text(f"{root}/logs.txt")
    return root


def write_label_file(labels: DataFrame, path: str) -> None:
    """Write (index, position, expected_group_id, expected_template) as one label document, in order; the folder `path` holds its parts."""
    spark = labels.sparkSession
    item = F.to_json(F.struct(F.col("index").alias("line_index"), "expected_group_id", "expected_template"))
    rows = labels.select(F.lit(1).alias("place"), "index", "position", F.concat(F.lit(", "), item).alias("value"))
    # A first label that no line has, so that all others follow a comma.
    ends = [(0, 0, 0, '{"name": "events", "records": [{"line_index": 0}'), (2, 0, 0, "]}")]
    whole = rows.unionByName(spark.createDataFrame(ends, "place int, index bigint, position int, value string"))
    order = ["place", "index", "position"]
    whole.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def tree_labels(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Labels of a written log tree by (relative path, physical line number)."""
    names = F.regexp_extract("relative_path", "^log=([^/]+)/", 1).alias("log")
    paths = files.discover(spark, root).select(names, F.col("relative_path").alias("file"))
    labels = _read(spark, sf_dir, "events").selectExpr(
        "event_id", f"{_TREE_FILE} as log", f"{_LABEL} as expected_group_id", f"{_EXPECTED} as expected_template"
    )
    number = F.row_number().over(Window.partitionBy("log").orderBy("event_id"))
    return labels.withColumn("line_number", number).join(paths, "log").drop("event_id", "log")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every physical line of every document: (doc_id, file_path, line_number, value)."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    pieces = documents.select(
        "doc_id",
        F.concat(F.lit("/docs/"), "source", F.lit("-doc"), "doc_id", F.lit(".txt")).alias("file_path"),
        F.posexplode(F.split("text", "\r\n|\r|\n")).alias("position", "value"),
    )
    return pieces.select("doc_id", "file_path", (F.col("position") + 1).cast("bigint").alias("line_number"), "value")
