"""Evaluation of normalization and grouping on a labelled set."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.normalize import with_counts
from ..functions.perturb import DEFAULT_SEED, perturb
from ..functions.rules import DEFAULT_RULES, Rule
from ..operators import errors, metrics
from ..operators.grouping import METHODS, keyed_methods, name_groups, predict_all, with_templates
from ..sources.datasets import LabelledLines, load_labelled
from ..staging import stage

MAX_EXAMPLES = 5  # fixed value: examples per list


def run_id(name: str, now: datetime | None = None) -> str:
    """UTC time and set name, spaces as underscores."""
    moment = now or datetime.now(UTC)
    return f"{moment:%Y%m%dT%H%M%SZ}_{name.replace(' ', '_')}"


@dataclass(frozen=True)
class Evaluation:
    """Result tables of one run, each with a run_id column."""

    summary: DataFrame
    rule_counts: DataFrame
    changed_examples: DataFrame
    template_mismatches: DataFrame
    false_splits: DataFrame
    false_merges: DataFrame
    failure_patterns: DataFrame
    predictions: DataFrame

    def write(self, path: str, fmt: str = "parquet") -> None:
        """Append every table below `path`, partitioned by run."""
        for field in fields(self):
            table = getattr(self, field.name)
            table.write.mode("append").partitionBy("run_id").format(fmt).save(f"{path}/{field.name}")


def normalized_lines(
    lines: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, perturbed: bool = False, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Labelled lines, perturbed if asked, with normalization and its counts.

    Labels are never perturbed.
    """
    return with_counts(perturb(lines, seed=seed) if perturbed else lines, rules=rules)


def per_method(analysis: Callable[..., DataFrame], *frames: DataFrame) -> DataFrame:
    """Run an analysis on one method's rows at a time, for each method of the fixed list."""
    result = None
    for method in METHODS:
        own = [frame.where(F.col("method") == method) for frame in frames]
        rows = analysis(*own).select(F.lit(method).alias("method"), "*")
        result = rows if result is None else result.unionByName(rows)
    return result


def summarize(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per method with every score; methods without rows score as on no lines."""
    spark = lines.sparkSession
    methods = spark.createDataFrame([(m,) for m in METHODS], "method string")
    total = metrics.normalization_metrics(lines).select(
        F.explode(F.array(*map(F.lit, METHODS))).alias("method"), "*"
    )
    scores = metrics.grouping_metrics(cells)
    return (
        methods.join(total, "method")
        .join(scores, "method", "left")
        .fillna(0, ["predicted_template_count", "labelled_lines"])
    )


@dataclass(frozen=True)
class Scored:
    """Two staged inputs of the result tables, normalized lines and the contingency table; `keyed` is a view of the lines."""

    lines: DataFrame
    keyed: DataFrame
    cells: DataFrame


LINE_COLUMNS = ("index", "raw_text", "expected_group_id", "expected_template")


def score_inputs(lines: DataFrame) -> Scored:
    """Stage normalized lines once, with a template per method, and count them per label and template.

    Scores tell groups apart by template keys; group ids are only made for predictions and printed examples.
    """
    lines = stage(with_templates(lines).drop("normalized_text"), "normalized")
    keyed = keyed_methods(lines.select(*LINE_COLUMNS, *METHODS))
    return Scored(lines, keyed, stage(metrics.contingency(keyed), "cells"))


def named_merges(keyed: DataFrame, cells: DataFrame, k: int = MAX_EXAMPLES) -> DataFrame:
    return name_groups(errors.false_merges(keyed, cells, k), cells)


def result_tables(
    scored: Scored, rules: Sequence[Rule] = DEFAULT_RULES, k: int = MAX_EXAMPLES
) -> dict[str, DataFrame]:
    """All result tables by name."""
    lines, keyed, cells = scored.lines, scored.keyed, scored.cells
    plain = lines.withColumn("normalized_text", F.col("normalized_identity"))
    return {
        "summary": summarize(lines, cells),
        "rule_counts": metrics.replacement_counts(lines, rules),
        "changed_examples": metrics.changed_examples(plain, k),
        "template_mismatches": per_method(lambda p: errors.template_mismatches(p, k), keyed),
        "false_splits": per_method(lambda p, c: errors.false_splits(p, c, k), keyed, cells),
        "false_merges": per_method(lambda p, c: named_merges(p, c, k), keyed, cells),
        "failure_patterns": per_method(lambda c: errors.failure_patterns(c, k), cells),
        "predictions": predict_all(lines.select("index", *METHODS)).select(
            "method", "index", "predicted_group_id", "predicted_template"
        ),
    }


def evaluate(
    dataset: LabelledLines,
    rules: Sequence[Rule] = DEFAULT_RULES,
    perturbed: bool = False,
    seed: int = DEFAULT_SEED,
    k: int = MAX_EXAMPLES,
    now: datetime | None = None,
) -> Evaluation:
    """Normalize, group and score a labelled set with every method."""
    lines = normalized_lines(dataset.records, rules, perturbed, seed)
    tables = result_tables(score_inputs(lines), rules, k)
    tables["summary"] = tables["summary"].select(
        F.lit(dataset.name).alias("dataset"),
        F.lit(dataset.kind).alias("kind"),
        F.lit(dataset.path).alias("path"),
        F.col("total_lines").alias("record_count"),
        F.lit(perturbed).alias("perturbed"),
        "*",
    )
    run = F.lit(run_id(dataset.name, now)).alias("run_id")
    return Evaluation(**{name: table.select(run, "*") for name, table in tables.items()})


def evaluate_path(
    spark: SparkSession,
    path: str,
    mode: str = "auto",
    report_dir: str | None = None,
    fmt: str = "parquet",
    **options,
) -> Evaluation:
    """Load a labelled set, evaluate it, and write the result tables if a folder is given."""
    result = evaluate(load_labelled(spark, path, mode), **options)
    if report_dir is not None:
        result.write(report_dir, fmt)
    return result
