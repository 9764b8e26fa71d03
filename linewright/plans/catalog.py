"""Every operator as a query over the given tables: name -> (session, table folder) -> DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import fields
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse, text
from ..functions.normalize import normalize, with_counts, with_trace
from ..functions.perturb import perturb
from ..functions.rules import DEFAULT_RULES, Rule, rule_named
from ..functions.signature import token_signature
from ..operators import errors, grouping, metrics
from ..operators.labels import join_predictions, label_by_file_line, label_by_index, last_wins
from ..sources import corpus, datasets, files, hadoop
from ..sources.record_table import RecordTable, first_records
from ..sources.rule_files import load_rules
from ..staging import new_path, stage
from . import evaluate
from .ingest import ingest, normalized_records

Query = Callable[[SparkSession, str], DataFrame]

YEAR = 2024  # year of syslog times in these tables
JOB = "events"

# A user's own list: a disabled rule, a group reference, two rules that share a name.
CUSTOM_RULES = (
    Rule("colour", r"\033\[[0-9;]*m", ""),
    Rule("bracket", r"\[error]\b|\[[a-z]+\]", "[<KIND>]"),
    Rule("key_value", r"(\w+)=\w+", r"\1=<VALUE>"),
    Rule("number", r"\b\d+\b", "<N>", enabled=False),
    Rule("unit", r"\b\d+\s?ms\b", "<MS>"),
    Rule("node", r"\bnode\d+\b", "<NODE>"),
    Rule("node", r"\buser \d+\b", "$USER"),
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.event_texts(spark, d)


def _records(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.event_lines(spark, d).select("file_path", "line_number", "value")
    return files.parse_records(lines, JOB, reference_year=YEAR)


def _templated(spark: SparkSession, d: str) -> DataFrame:
    """Labelled event lines with one template column per method; staged."""
    lines = corpus.labelled_events(spark, d).withColumn("normalized_text", normalize(F.col("raw_text")))
    return stage(grouping.with_templates(lines).select(*evaluate.LINE_COLUMNS, *grouping.METHODS), "templated")


def _method_lines(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Labelled event lines with the template column of one method; staged."""
    normalized = corpus.labelled_events(spark, d).withColumn("normalized_text", normalize(F.col("raw_text")))
    template = grouping.METHODS[name](F.col("normalized_text"))
    return stage(normalized.select("index", template.alias(name)), "templated")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return grouping.keyed_methods(_templated(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """The contingency table straight from the lines: staged, as each score reads it several times."""
    keyed = grouping.keyed_methods(
        grouping.with_templates(corpus.labelled_events(spark, d).withColumn("normalized_text", normalize(F.col("raw_text")))).select(
            *evaluate.LINE_COLUMNS, *grouping.METHODS
        )
    )
    return metrics.contingency(keyed)


def _one_method(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        predicted = grouping.predict(_method_lines(spark, d, name), name)
        return predicted.select("index", "predicted_group_id", "predicted_template")

    return query


def _one_rule(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        changed = normalize(F.col("raw_text"), [rule_named(name)])
        return _texts(spark, d).select("event_id", changed.alias("normalized_text"))

    return query


def top_templates(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent normalized lines of the event log."""
    lines = _texts(spark, d).withColumn("template", normalize(F.col("raw_text")))
    counts = grouping.template_counts(lines)
    return counts.orderBy(F.desc("lines"), "first_index").limit(20)


def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = files.scan_lines(spark, corpus.write_log_tree(spark, d))
    log = F.regexp_extract("relative_path", "^log=([^/]+)/", 1)
    return lines.select(log.alias("log"), "line_number", "value")


def discover_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes per log folder, from the listing alone."""
    found = files.discover(spark, corpus.write_log_tree(spark, d))
    log = F.regexp_extract("relative_path", "^log=([^/]+)/", 1).alias("log")
    return found.groupBy(log).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines per folder below the root, for a root given with a scheme."""
    lines = files.scan_lines(spark, corpus.write_log_tree(spark, d))
    folder = F.regexp_replace("relative_path", "/[^/]+$", "").alias("folder")
    return lines.groupBy(folder).agg(F.count("*").alias("lines"))


def dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Records that each layout gives when its kind is found out by what files exist."""
    line_set, tree = corpus.write_line_set(spark, d), corpus.write_log_tree(spark, d)
    hadoop.write_text(spark, f"{line_set}/{datasets.LABELS_FILE}", '{"name": "events", "records": []}')
    counted = None
    for path in (line_set, tree):
        loaded = datasets.load_labelled(spark, path)
        one = loaded.records.agg(F.count("*").alias("records"), F.max("index").alias("last_index")).select(F.lit(loaded.kind).alias("kind"), "*")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def rules_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Event lines normalized by the rules of a written rule file, one of them disabled."""
    path = f"{new_path(spark, 'rules')}/rules.json"
    entries = [{"name": r.name, "pattern": r.pattern, "replacement": r.replacement} for r in DEFAULT_RULES]
    entries.append({"name": "all", "pattern": ".", "replacement": "", "enabled": False})
    hadoop.write_text(spark, path, json.dumps({"rules": entries}))
    changed = normalize(F.col("raw_text"), load_rules(path, spark))
    return _texts(spark, d).select("event_id", changed.alias("normalized_text"))


def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """Number and rows of the record table after it is made twice, filled, filled again and partly replaced."""
    table = RecordTable(spark, new_path(spark, "records"))
    records = stage(normalized_records(_records(spark, d)), "records")
    steps = []
    for name, some in (("made", None), ("made again", None), ("filled", "true"), ("filled again", "true"), ("partly replaced", "severity = 'ERROR'")):
        if some is None:
            table.create()
        else:
            table.upsert(records.where(some), unique_ids=True)
        version = table.current()
        steps.append(table.read(version).agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).select(F.lit(name).alias("step"), F.lit(version.number).alias("version"), "*"))
    return reduce(DataFrame.unionByName, steps)


def log_records(spark: SparkSession, d: str) -> DataFrame:
    return normalized_records(_records(spark, d))


def document_records(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.document_lines(spark, d).select("file_path", "line_number", "value")
    return files.parse_records(lines, "documents", reference_year=YEAR)


def _label_versions(spark: SparkSession, d: str) -> DataFrame:
    """Labels of event lines by index, several for some."""
    labels = corpus.event_labels(spark, d).select(
        F.col("index"),
        F.explode(F.when(F.col("index") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("position"),
        F.col("expected_group_id"),
        F.col("expected_template"),
    )
    return labels.withColumn("expected_group_id", F.concat_ws("#", "expected_group_id", "position"))


def eval_local_file(spark: SparkSession, d: str) -> DataFrame:
    """As eval_local, with the labels in a written label file."""
    root = corpus.write_line_set(spark, d)
    corpus.write_label_file(_label_versions(spark, d), f"{root}/{datasets.LABELS_FILE}")
    loaded = datasets.load_labelled(spark, root)
    return loaded.records.select("index", "raw_text", "expected_group_id", "expected_template")


def eval_local(spark: SparkSession, d: str) -> DataFrame:
    """Lines numbered without blanks, labels in label-file form with several per line, through the loader."""
    last = last_wins(_label_versions(spark, d), ["index"], ["position"])
    loaded = datasets.load_labelled(spark, corpus.write_line_set(spark, d), "local", last)
    return loaded.records.select("index", "raw_text", "expected_group_id", "expected_template")


def eval_synthetic(spark: SparkSession, d: str) -> DataFrame:
    """Records numbered over all files in path order, labelled by (file, line number), through the loader."""
    root = corpus.write_log_tree(spark, d)
    loaded = datasets.load_labelled(spark, root, "synthetic", corpus.tree_labels(spark, d, root))
    log = F.regexp_extract("file_path", "/log=([^/]+)/", 1)
    return loaded.records.select("index", "raw_text", log.alias("log"), "line_number", "expected_template", "expected_group_id")


def strip_lines(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("event_id", "raw_text")


def strip_document_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.document_lines(spark, d)
    stripped = lines.select("doc_id", "line_number", text.strip(F.col("value")).alias("raw_text"))
    return stripped.where("raw_text <> ''")


def parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("event_id", parse.timestamp(F.col("raw_text"), YEAR).alias("timestamp"))


def severity(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("event_id", parse.severity(F.col("raw_text")).alias("severity"))


def component(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("event_id", parse.component(F.col("raw_text")).alias("component"))


def source_host(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    return corpus.event_lines(spark, d).select(
        "event_id", parse.source_of(path).alias("source"), parse.host_of(path).alias("host")
    )


def record_ids(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.event_lines(spark, d)
    key = parse.record_id(F.lit(JOB), F.col("file_path"), F.col("line_number"))
    return lines.select("event_id", key.alias("id"), F.lit(JOB).alias("job_id"))


def normalize_events(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("event_id", normalize(F.col("raw_text")).alias("normalized_text"))


def normalize_trace(spark: SparkSession, d: str) -> DataFrame:
    traced = with_trace(_texts(spark, d))
    counts = F.to_json("replacement_counts").alias("replacement_counts")
    return traced.select("event_id", "normalized_text", "changed", counts)


def normalize_custom(spark: SparkSession, d: str) -> DataFrame:
    coloured = F.concat(F.lit("\x1b[31m"), "raw_text", F.lit("\x1b[0m"))
    traced = with_trace(_texts(spark, d).withColumn("raw_text", coloured), rules=CUSTOM_RULES)
    counts = F.to_json("replacement_counts").alias("replacement_counts")
    return traced.select("event_id", "normalized_text", "changed", counts)


def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    traced = with_trace(document_records(spark, d))
    counts = F.to_json("replacement_counts").alias("replacement_counts")
    return traced.select("file_path", "line_number", "normalized_text", "changed", counts)


def token_signatures(spark: SparkSession, d: str) -> DataFrame:
    normalized = normalize(F.col("raw_text"))
    return _texts(spark, d).select("event_id", token_signature(normalized).alias("signature"))


def group_all_methods(spark: SparkSession, d: str) -> DataFrame:
    lines = _templated(spark, d).select("index", *grouping.METHODS)
    return grouping.predict_all(lines).select("method", "index", "predicted_group_id", "predicted_template")


def template_counts(spark: SparkSession, d: str) -> DataFrame:
    return grouping.template_counts(_texts(spark, d).select("index", normalize(F.col("raw_text")).alias("template")))


def document_templates(spark: SparkSession, d: str) -> DataFrame:
    """Line counts and first (file, line) per token signature of the documents."""
    lines = normalized_records(document_records(spark, d))
    signed = lines.withColumn("template", token_signature(F.col("normalized_text")))
    first = F.min(F.struct("file_path", "line_number")).alias("first")
    return (
        signed.groupBy("template")
        .agg(F.count("*").alias("lines"), first)
        .select("template", "lines", F.col("first.file_path").alias("first_file"), F.col("first.line_number").alias("first_line"))
    )


def join_labels_index(spark: SparkSession, d: str) -> DataFrame:
    lines = _texts(spark, d).select("index", "raw_text")
    return label_by_index(lines, corpus.event_labels(spark, d))


def join_labels_file_line(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.event_lines(spark, d).select(F.col("file_path").alias("file"), "line_number", "value")
    return label_by_file_line(lines, corpus.event_labels(spark, d))


def join_predicted(spark: SparkSession, d: str) -> DataFrame:
    lines = corpus.labelled_events(spark, d)
    predictions = grouping.predict(_method_lines(spark, d, "token_pattern"), "token_pattern").select(
        "index", "predicted_group_id", "predicted_template"
    )
    return join_predictions(lines, predictions)


def norm_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.normalization_metrics(with_counts(_texts(spark, d)))


def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.replacement_counts(with_counts(_texts(spark, d)))


def changed_examples(spark: SparkSession, d: str) -> DataFrame:
    normalized = _texts(spark, d).withColumn("normalized_text", normalize(F.col("raw_text")))
    return metrics.changed_examples(normalized.withColumn("changed", F.expr("normalized_text <> raw_text")))


def template_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.template_metrics(stage(_cells(spark, d), "cells"))


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pair_metrics(stage(_cells(spark, d), "cells"))


def template_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_method(errors.template_mismatches, _keyed(spark, d))


def false_splits(spark: SparkSession, d: str) -> DataFrame:
    keyed = _keyed(spark, d)
    return evaluate.per_method(errors.false_splits, keyed, stage(metrics.contingency(keyed), "cells"))


def false_merges(spark: SparkSession, d: str) -> DataFrame:
    keyed = _keyed(spark, d)
    return evaluate.per_method(evaluate.named_merges, keyed, stage(metrics.contingency(keyed), "cells"))


def failure_patterns(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_method(errors.failure_patterns, stage(_cells(spark, d), "cells"))


def perturb_events(spark: SparkSession, d: str) -> DataFrame:
    return perturb(_texts(spark, d)).select("index", "raw_text")


def perturbed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines per template after perturbing, labels untouched."""
    lines = evaluate.normalized_lines(corpus.labelled_events(spark, d), perturbed=True)
    return (
        lines.groupBy("expected_group_id", F.col("normalized_text").alias("template"))
        .agg(F.count("*").alias("lines"))
    )


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Store all event records, then again those of errors with normalized text."""
    table = RecordTable(spark, new_path(spark, "records"))
    table.create()
    records = stage(_records(spark, d), "records")
    table.upsert(records.withColumn("normalized_text", F.lit(None).cast("string")), unique_ids=True)
    table.upsert(normalized_records(records.where("severity = 'ERROR'")))
    return table.read().select("id", "severity", "raw_text", "normalized_text")


def inspect_records(spark: SparkSession, d: str) -> DataFrame:
    return first_records(normalized_records(_records(spark, d)))


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ingest the event log tree and summarize the run."""
    summary = ingest(spark, corpus.write_log_tree(spark, d), new_path(spark, "table"), JOB, reference_year=YEAR)
    row = (summary.files_processed, summary.log_lines_ingested, summary.records_written)
    schema = "files_processed bigint, log_lines_ingested bigint, records_written bigint"
    return spark.createDataFrame([row], schema)


def stored_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Evaluate the event lines, write all result tables, and count what reads back."""
    lines = datasets.LabelledLines("events", "synthetic", d, corpus.labelled_events(spark, d))
    folder = new_path(spark, "reports")
    evaluate.evaluate(lines, now=datetime(2030, 1, 2, 3, 4, 5)).write(folder)
    counted = None
    for field in fields(evaluate.Evaluation):
        table = spark.read.parquet(f"{folder}/{field.name}")
        one = table.groupBy("run_id").agg(F.count("*").alias("rows")).select(F.lit(field.name).alias("result_table"), "run_id", "rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    scored = evaluate.score_inputs(evaluate.normalized_lines(corpus.labelled_events(spark, d)))
    return evaluate.summarize(scored.lines, scored.cells)


QUERIES: dict[str, Query] = {
    "top_templates": top_templates,
    "line_numbers": line_numbers,
    "discover_files": discover_files,
    "relative_paths": relative_paths,
    "dispatch": dispatch,
    "rules_from_file": rules_from_file,
    "table_versions": table_versions,
    "log_records": log_records,
    "document_records": document_records,
    "eval_local": eval_local,
    "eval_local_file": eval_local_file,
    "eval_synthetic": eval_synthetic,
    "strip_lines": strip_lines,
    "strip_document_lines": strip_document_lines,
    "parse_timestamp": parse_timestamp,
    "severity": severity,
    "component": component,
    "source_host": source_host,
    "record_ids": record_ids,
    "normalize": normalize_events,
    "normalize_trace": normalize_trace,
    "rule_ip": _one_rule("ip_address"),
    "rule_uuid": _one_rule("uuid"),
    "rule_hex": _one_rule("hex_value"),
    "rule_duration": _one_rule("duration"),
    "rule_path": _one_rule("file_path"),
    "rule_float": _one_rule("float_value"),
    "rule_long_id": _one_rule("long_id"),
    "rule_int": _one_rule("integer"),
    "normalize_custom": normalize_custom,
    "normalize_documents": normalize_documents,
    "token_signature": token_signatures,
    "group_identity": _one_method("normalized_identity"),
    "group_token_pattern": _one_method("token_pattern"),
    "group_all_methods": group_all_methods,
    "template_counts": template_counts,
    "document_templates": document_templates,
    "join_labels_index": join_labels_index,
    "join_labels_file_line": join_labels_file_line,
    "join_predictions": join_predicted,
    "norm_metrics": norm_metrics,
    "rule_counts": rule_counts,
    "changed_examples": changed_examples,
    "grouping_metrics": template_scores,
    "pair_metrics": pair_metrics,
    "template_mismatches": template_mismatches,
    "false_splits": false_splits,
    "false_merges": false_merges,
    "failure_patterns": failure_patterns,
    "perturb": perturb_events,
    "perturbed_groups": perturbed_groups,
    "upsert_latest": upsert_latest,
    "inspect_records": inspect_records,
    "ingest_summary": ingest_summary,
    "benchmark_summary": benchmark_summary,
    "stored_evaluation": stored_evaluation,
}
