"""Label documents of any size: one JSON object whose `records` array is cut into its objects and parsed in parallel.

The file, or a folder of files that hold a document's lines in order of their names, is read as pieces that end with a closing brace, in file splits. What a brace means depends on all that stands before it,
but only through sums: the parity of the quotes so far tells strings from structure, and the open braces and brackets so far
tell where an object of the array ends. These sums are taken in two levels, over pieces in buckets and over buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.numbering import index_in_place
from ..staging import stage

_BUCKET_BITS = 12
# Anything after a backslash is escaped; a quoted text may end in a later piece.
_ESCAPED = r"(?s)\\."
_QUOTED = r'(?s)"(?:[^"\\]|\\.)*+(?:"|$)'
_OPENING = r'(?s)^(.*?"records"\s*:\s*\[)\s*(\{.*)$'
_FOLLOWING = r"(?s)^\s*,\s*(\{.*)$"


def _with_sums(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds, under each name, the sum of a value over all rows with a lesser `number`; `rows` are staged."""
    known = rows.withColumn("_bucket", F.shiftright("number", _BUCKET_BITS)).withColumns({f"_{n}": v.cast("bigint") for n, v in values.items()})
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = known.groupBy("_bucket").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in values))
    # A row per 4096 pieces.
    bases = totals.select("_bucket", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in values))
    within = Window.partitionBy("_bucket").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    summed = known.withColumns({n: F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)) for n in values}).join(bases, "_bucket")
    return summed.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in values}).drop("_bucket", *(f"_{n}" for n in values), *(f"_base_{n}" for n in values))


def _count(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(number, value, braced): the text before each closing brace and after a file's last one, in order, and whether a brace follows."""
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(
        F.col("_metadata.file_path").alias("uri"),
        F.col("_metadata.file_block_start").alias("block_start"),
        "value",
        F.col("_metadata.file_size").alias("size"),
    )
    numbered = index_in_place(pieces, ["uri", "block_start"], F.min("block_start"), [F.split("uri", "/"), F.col("first")], "number")
    # The last piece of a file has a brace behind it only if the file ends with one; a byte order mark is not counted.
    of_file = numbered.groupBy("uri").agg(F.max("number").alias("number"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    bare = of_file.where(~F.expr("bytes in (size, size - 3)")).select("number", F.lit(False).alias("braced"))
    # A row per file at most.
    return numbered.select("number", "value").join(F.broadcast(bare), "number", "left").select("number", "value", F.coalesce("braced", F.lit(True)).alias("braced"))


def _units(spark: SparkSession, path: str) -> DataFrame:
    """(unit, text, opens, ends, depth): runs of pieces that end where at most the document's own brace is open.

    `opens` and `ends` are the brackets open before and after, `depth` the braces open after.
    """
    pieces = _pieces(spark, path)
    if pieces.isEmpty():
        raise ValueError(f"[MALFORMED_LABELS] {path} is empty")
    braced = F.col("braced")
    bare = F.regexp_replace("value", _ESCAPED, "")
    quoted = stage(_with_sums(pieces, quotes=_count(bare, '"')), "quoted")
    inside = F.col("quotes") % 2 == 1
    structure = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "value"), _QUOTED, "")
    # A quote left open is followed by the brace as text.
    ends_inside = (F.col("quotes") + _count(bare, '"')) % 2 == 1
    read = stage(
        quoted.select(
            "number",
            F.when(braced, F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("text"),
            (_count(structure, "{") - F.when(braced & ~ends_inside, 1).otherwise(0)).alias("braces"),
            (_count(structure, "[") - _count(structure, "]")).alias("brackets"),
            (braced & ~ends_inside).alias("closes"),
            ends_inside.alias("ends_inside"),
        ),
        "read",
    )
    nested = stage(_with_sums(read, depth=F.col("braces"), opens=F.col("brackets")), "nested")
    after = F.col("depth") + F.col("braces")
    cut = F.col("closes") & (after <= 1)
    united = _with_sums(nested.withColumn("cut", cut), unit=F.col("cut"))
    last = nested.orderBy(F.desc("number")).select(after.alias("depth"), (F.col("opens") + F.col("brackets")).alias("brackets"), "ends_inside").first()
    if tuple(last) != (0, 0, False) or not nested.where(after < 0).isEmpty():
        raise ValueError(f"[MALFORMED_LABELS] {path} is not a whole JSON object")
    parts = F.sort_array(F.collect_list(F.struct("number", "text")))
    in_order = united.groupBy("unit").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        F.min_by("opens", "number").alias("opens"),
        F.max_by(F.col("opens") + F.col("brackets"), "number").alias("ends"),
        F.max_by(after, "number").alias("depth"),
    )
    return stage(in_order, "units")


def read_label_document(spark: SparkSession, path: str, record: str) -> tuple[str | None, DataFrame]:
    """(name, records) of a document `{"name": ..., "records": [{...}, ...]}` in UTF-8; records have `position` and the fields of the schema `record`.

    Positions rise in the order of the file. Keys besides these two are passed over; all of the document but its records is parsed in one task. A
    document that is not well-formed is an error, at once or when the records are read.
    """
    units = _units(spark, path)
    lead = F.regexp_replace(F.regexp_extract("text", _OPENING, 1), _QUOTED, "")
    # The key stands in the document itself: no brace but the document's own before it, and no bracket but its array's.
    at_top = (_count(lead, "{") == (F.col("unit") == 0).cast("int")) & (F.col("opens") + _count(lead, "[") - _count(lead, "]") == 1)
    opening = (F.col("ends") == 1) & (F.col("depth") == 1) & F.col("text").rlike(_OPENING) & at_top
    first = units.where(opening).agg(F.max("unit")).first()[0]
    if first is None:
        skeleton, records = units.select("unit", "text"), None
    else:
        after = units.where((F.col("unit") > first) & ~F.col("text").rlike(_FOLLOWING))
        end = after.agg(F.min("unit").alias("unit"), F.min_by(F.col("text").rlike(r"^\s*\]"), "unit").alias("closes")).first()
        if not end["closes"]:
            raise ValueError(f"[MALFORMED_LABELS] {path}: records without commas between them")
        inner = (F.col("unit") > first) & (F.col("unit") < end["unit"])
        skeleton = units.where(~inner).select("unit", F.when(F.col("unit") == first, F.regexp_extract("text", _OPENING, 1)).otherwise(F.col("text")).alias("text"))
        texts = F.when(F.col("unit") == first, F.regexp_extract("text", _OPENING, 2)).otherwise(F.regexp_extract("text", _FOLLOWING, 1))
        records = units.where(inner | (F.col("unit") == first)).select("unit", texts.alias("text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit", "text"))), lambda u: u["text"]), "")
    strict = {"mode": "FAILFAST"}
    named = skeleton.agg(whole.alias("text")).select(F.from_json("text", "name string, records array<string>", strict).alias("document")).first()["document"]
    if records is None:
        empty = spark.createDataFrame([], f"position bigint, {record}")
        if named["records"]:
            raise ValueError(f"[MALFORMED_LABELS] {path}: records that are no objects")
        return named["name"], empty
    parsed = records.select(F.col("unit").alias("position"), F.from_json("text", record, strict).alias("item"))
    return named["name"], parsed.select("position", "item.*")
