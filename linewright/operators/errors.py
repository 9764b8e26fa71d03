"""Concrete error examples: the first k mistakes in line order, and the most frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Examples whose tables are broadcast: lines of text, one each.
MAX_BROADCAST = 10_000


def template_mismatches(predicted: DataFrame, k: int = 5) -> DataFrame:
    """First k template-labelled lines whose predicted template differs."""
    wrong = F.col("expected_template") != F.col("predicted_template")
    return (
        predicted.where(wrong)
        .orderBy("index")
        .limit(k)
        .select("index", "raw_text", "expected_template", "predicted_template")
    )


def failure_patterns(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent template mistakes of one method; ties go to the earlier one."""
    expected, predicted = F.col("expected_template"), F.col("predicted_template")
    return (
        cells.where(expected != predicted)
        .groupBy(expected, predicted)
        .agg(F.sum("n").alias("count"), F.min("first_index").alias("first_index"))
        .orderBy(F.desc("count"), "first_index")
        .limit(k)
        .select(
            F.concat(F.lit("template_mismatch::"), expected, F.lit(" -> "), predicted).alias("pattern"),
            "count",
        )
    )


def false_splits(predicted: DataFrame, cells: DataFrame, k: int = 5) -> DataFrame:
    """First k pairs (by left, then right index) with one label but different groups.

    `cells` is the contingency table of the same lines; it is read twice.
    """
    return _first_pairs(predicted, cells, "expected_group_id", "predicted_group_id", k)


def false_merges(predicted: DataFrame, cells: DataFrame, k: int = 5) -> DataFrame:
    """First k pairs (by left, then right index) with different labels but one group."""
    return _first_pairs(predicted, cells, "predicted_group_id", "expected_group_id", k)


def _small(rows: DataFrame, k: int) -> DataFrame:
    """A table of at most k rows as the side of a join."""
    return F.broadcast(rows) if k <= MAX_BROADCAST else rows.hint("merge")


def _first_pairs(predicted: DataFrame, cells: DataFrame, same: str, differing: str, k: int) -> DataFrame:
    """First k pairs i < j that agree on `same` and differ on `differing`.

    Split each `same` group into cells by `differing`, and let S be the second largest of
    the cells' last indexes. A line i has a partner to its right exactly if i <= S: up to S
    at least two cells still go on, after it only one does. The k smallest such lines lie
    in the k groups that start first, so two tables of k rows find all answers. Up to MAX_BROADCAST
    rows they are broadcast and no line is shuffled; beyond that lines are joined by key.
    """
    labelled = F.col("expected_group_id").isNotNull()
    extents = (
        cells.where(labelled)
        .groupBy(same, differing)
        .agg(F.min("first_index").alias("first"), F.max("last_index").alias("last"))
    )
    by_last = Window.partitionBy(same).orderBy(F.desc("last"))
    limits = (
        extents.select(same, "last", F.row_number().over(by_last).alias("place"))
        .where("place = 2")
        .select(same, F.col("last").alias("limit"))
    )
    starts = extents.groupBy(same).agg(F.min("first").alias("start"))
    groups = starts.join(limits, same).orderBy("start").limit(k).select(same, "limit")
    lines = predicted.where(labelled)
    left = (
        lines.join(_small(groups, k), same)
        .where(F.col("index") <= F.col("limit"))
        .orderBy("index")
        .limit(k)
        .select(
            same,
            F.col(differing).alias("_left"),
            F.col("index").alias("left_index"),
            F.col("raw_text").alias("left_text"),
        )
    )
    pairs = lines.join(_small(left, k), same).where(
        (F.col(differing) != F.col("_left")) & (F.col("index") > F.col("left_index"))
    )
    return (
        pairs.orderBy("left_index", "index")
        .limit(k)
        .select(
            "left_index",
            F.col("index").alias("right_index"),
            "left_text",
            F.col("raw_text").alias("right_text"),
            same,
        )
    )
