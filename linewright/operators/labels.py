"""Joins of lines with labels and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

LABELS = ("expected_group_id", "expected_template")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key in the given total order; partial results combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), F.struct(*order)).alias("latest")
    return df.groupBy(*keys).agg(latest).select(*keys, "latest.*")


def label_by_index(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on `index`; labels have one row per index."""
    return lines.join(labels.select("index", *LABELS), "index", "left")


def label_by_file_line(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on (`file`, `line_number`); labels have one row per pair."""
    return lines.join(labels.select("file", "line_number", *LABELS), ["file", "line_number"], "left")


def join_predictions(lines: DataFrame, predictions: DataFrame) -> DataFrame:
    """Attach predictions by `index`; a labelled line without one is an error."""
    found = predictions.select(
        "index", "predicted_group_id", "predicted_template", F.lit(True).alias("_found")
    )
    joined = lines.join(found, "index", "left")
    labelled = F.coalesce(*LABELS).isNotNull()
    missing = F.raise_error(F.concat(F.lit("no prediction for index "), F.col("index").cast("string")))
    checked = F.when(F.col("_found").isNull() & labelled, missing.cast("boolean")).otherwise(
        F.coalesce("_found", F.lit(False))
    )
    return joined.where(checked).drop("_found")
