"""Normalization and grouping scores as tidy tables with exact counts and unrounded ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import active, hits_of
from ..functions.rules import DEFAULT_RULES, Rule

_EXACT = "decimal(38,0)"  # pair counts outgrow 64 bits at about 4e9 lines


def normalization_metrics(lines: DataFrame) -> DataFrame:
    """Total and changed lines, and the changed share in percent (0 for no lines)."""
    counts = lines.agg(
        F.count("*").alias("total_lines"), F.count_if("changed").alias("changed_lines")
    )
    share = F.col("changed_lines") / F.col("total_lines") * 100.0
    return counts.withColumn(
        "percent_changed", F.when(F.col("total_lines") > 0, share).otherwise(F.lit(0.0))
    )


def replacement_counts(counted: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Replacements per rule name over lines that carry hit-count columns; zeros are left out."""
    rules = active(rules)
    names = list(dict.fromkeys(rule.name for rule in rules))
    if not names:
        return counted.sparkSession.createDataFrame([], "rule string, replacements bigint")
    totals = counted.agg(*[F.sum(hits_of(name, rules)).alias(f"r{i}") for i, name in enumerate(names)])
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("replacements"))
            for i, name in enumerate(names)
        ]
    )
    return totals.select(F.inline(rows)).where(F.col("replacements") > 0)


def changed_examples(lines: DataFrame, k: int = 5) -> DataFrame:
    """The first k changed lines by index."""
    return (
        lines.where("changed").orderBy("index").limit(k).select("index", "raw_text", "normalized_text")
    )


def contingency(predicted: DataFrame) -> DataFrame:
    """Line counts and first and last index per method, labels and prediction.

    This one pass over the lines is all that the scores need.
    """
    return predicted.groupBy(
        "method", "expected_group_id", "expected_template", "predicted_group_id", "predicted_template"
    ).agg(
        F.count("*").alias("n"),
        F.min("index").alias("first_index"),
        F.max("index").alias("last_index"),
    )


def _when_any(count: Column, value: Column) -> Column:
    return F.when(count > 0, value)


def template_metrics(cells: DataFrame) -> DataFrame:
    """Per method: template counts, exact match rate and labelled lines."""
    expected, predicted = F.col("expected_template"), F.col("predicted_template")
    labelled = expected.isNotNull() | F.col("expected_group_id").isNotNull()
    n = F.col("n")
    sums = cells.groupBy("method").agg(
        F.count_distinct(predicted).alias("predicted_template_count"),
        F.count_distinct(expected).alias("_expected"),
        F.sum(F.when(labelled, n).otherwise(0)).alias("labelled_lines"),
        F.sum(F.when(expected.isNotNull(), n).otherwise(0)).alias("_templated"),
        F.sum(F.when(expected == predicted, n).otherwise(0)).alias("_exact"),
    )
    return sums.select(
        "method",
        "predicted_template_count",
        _when_any(F.col("_expected"), F.col("_expected")).alias("expected_template_count"),
        _when_any(F.col("_templated"), F.col("_exact") / F.col("_templated")).alias(
            "exact_template_match_rate"
        ),
        "labelled_lines",
    )


def pair_metrics(cells: DataFrame) -> DataFrame:
    """Per method: agreement over all pairs of group-labelled lines, without forming pairs.

    With C(n) = n(n-1)/2 summed over (label, group) cells, labels and groups, pairs split by
    mistake are C(labels) - C(cells) and pairs merged by mistake C(groups) - C(cells). The
    grouping sets run over the small contingency table.
    """
    keys = ["method", "expected_group_id", "predicted_group_id"]
    label, group = keys[1:]
    sizes = (
        cells.where(F.col(label).isNotNull())
        .groupingSets([keys, ["method", label], ["method", group], ["method"]], *keys)
        .agg(F.sum("n").alias("n"), F.grouping_id(*keys).alias("_level"))
    )
    n = F.col("n").cast("decimal(19,0)")
    twice = (n * (n - 1)).cast(_EXACT)

    def pairs(level: int) -> Column:
        return (F.sum(F.when(F.col("_level") == level, twice).otherwise(0)) / 2).cast(_EXACT)

    counted = sizes.groupBy("method").agg(
        pairs(0).alias("both"), pairs(1).alias("labels"), pairs(2).alias("groups"), pairs(3).alias("total")
    )
    split = (F.col("labels") - F.col("both")).cast(_EXACT)
    merged = (F.col("groups") - F.col("both")).cast(_EXACT)
    correct = F.col("total") - split - merged
    some = F.col("total") > 0
    return counted.select(
        "method",
        F.when(some, correct.cast("double") / F.col("total").cast("double")).alias("grouping_pair_accuracy"),
        F.when(some, split).alias("over_splitting_pairs"),
        F.when(some, merged).alias("over_merging_pairs"),
    )


def grouping_metrics(cells: DataFrame) -> DataFrame:
    """All scores of each method in one row."""
    return template_metrics(cells).join(pair_metrics(cells), "method", "left")
