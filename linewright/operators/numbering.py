"""Line numbers and ranks without a sort that runs in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

# monotonically_increasing_id() puts the partition above this many low bits.
_POSITION_BITS = 33
# Splits whose offsets are broadcast: three integers each.
MAX_SPLITS = 4_000_000
# Ranks are taken within buckets of this many consecutive first indexes.
_BUCKET_BITS = 18


def _before(window) -> Column:
    """Sum of `n` over the rows of a window that come before the current one."""
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _meets_all(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """Join rows with a staged table of a few integers per file split, and whether the rows stayed where they were.

    The table is counted first: up to MAX_SPLITS rows it is broadcast, beyond that the rows are shuffled.
    """
    near = table.count() <= MAX_SPLITS
    return rows.join(F.broadcast(table) if near else table, list(keys)), near


def _running_offsets(runs: DataFrame, order: Sequence[Column], name: str = "offset") -> DataFrame:
    """Add to each row the sum of `n` over the rows before it in a total order; the rows are staged once.

    Prefix sums in two levels: within ranges of the order, and over the ranges, of which there is one per shuffle
    partition. No task sees more rows than a range holds.
    """
    ranges = stage(runs.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.sum("n").alias("n"))
    starts = sizes.select("_range", _before(Window.orderBy("_range")).alias("_start"))
    within = _before(Window.partitionBy("_range").orderBy(*order)).alias("_within")
    summed = ranges.select("*", within).join(F.broadcast(starts), "_range")
    return summed.withColumn(name, F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")


def physical_line_numbers(staged: DataFrame) -> tuple[DataFrame, bool]:
    """Number the lines of each file from 1, given (uri, block_start, pos) of a staged scan; and whether no line moved.

    Within one file split `pos` rises by one per line, so a line's number is the lines of
    the file's earlier splits plus its distance from the first line of its own split. Only
    one row per split is aggregated and sorted; what the lines need of it are two integers and a task number.
    """
    part = F.shiftright("pos", _POSITION_BITS).cast("int").alias("_part")
    # Splits read by one task are told apart by a hash.
    split = F.xxhash64("uri", "block_start").alias("_split")
    splits = staged.groupBy("uri", "block_start", part).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    by_file = Window.partitionBy("uri").orderBy("block_start")
    offsets = splits.select(split, "_part", (_before(by_file) - F.col("first_pos") + 1).alias("_shift"))
    numbered, in_order = _meets_all(staged.select("*", split, part), stage(offsets, "splits"), ["_split", "_part"])
    return numbered.withColumn("line_number", F.col("pos") + F.col("_shift")).drop("_split", "_part", "_shift", "pos"), in_order


def index_in_place(
    rows: DataFrame, split: Sequence[str], first: Column, order: Sequence[Column], name: str = "index"
) -> DataFrame:
    """Number all rows 1..n, given rows that stand in order within each split; the rows are staged once and never sorted.

    `split` names the columns that tell file splits apart. `first` is an aggregate over the rows of a split that one task
    read, `order` the order of splits by those columns and `first`.
    """
    placed = stage(rows.withColumn("_position", F.monotonically_increasing_id()), "placed").withColumn(
        "_part", F.shiftright("_position", _POSITION_BITS).cast("int")
    )
    key = F.xxhash64(*split).alias("_split")
    runs = placed.groupBy(*split, "_part").agg(
        F.count("*").alias("n"), F.min("_position").alias("_first_position"), first.alias("first")
    )
    shift = (F.col("offset") - F.col("_first_position") + 1).alias("_shift")
    offsets = stage(_running_offsets(runs, order).select(key, "_part", shift), "runs")
    met, _ = _meets_all(placed.select("*", key), offsets, ["_split", "_part"])
    return met.withColumn(name, F.col("_position") + F.col("_shift")).drop("_split", "_part", "_shift", "_position")


def dense_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Number all rows 1..n in a total order, wherever they stand.

    Rows are range-partitioned, sorted inside each partition and staged with their position;
    the index is that position plus the size of the earlier partitions. The broadcast table
    has one row per shuffle partition, whatever the number of rows.
    """
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_position", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_position", _POSITION_BITS))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = sizes.select("_part", _before(Window.orderBy("_part")).alias("_offset"))
    in_part = F.col("_position").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + in_part + 1)
        .drop("_part", "_position", "_offset")
    )


def rank_by_first_index(keys: DataFrame, first: str = "first_index", name: str = "rank") -> DataFrame:
    """Rank distinct keys 1..n by a unique, non-negative integer column; `keys` is read twice.

    A bucket of consecutive integers holds at most 2**18 keys, so each is ranked in one
    task; the table of bucket sizes has at most max(first) / 2**18 rows of two numbers.
    """
    bucketed = keys.withColumn("_bucket", F.shiftright(first, _BUCKET_BITS))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("n"))
    offsets = sizes.select("_bucket", _before(Window.orderBy("_bucket")).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(first))
    return (
        bucketed.withColumn("_within", within)
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_within"))
        .drop("_bucket", "_within", "_offset")
    )
