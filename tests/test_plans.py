"""What the plans of large steps must not do."""

import os

import pytest

import __spark_entry__ as contract
from linewright.operators import grouping, metrics, numbering
from linewright.plans import evaluate
from linewright.sources import corpus, files

FOLDER = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1KB")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def text_exchanges(text):
    return [line for line in text.split("\n") if "Exchange" in line and "BroadcastExchange" not in line]


def test_line_numbers_move_no_text(spark, no_auto_broadcast):
    lines = files.scan_lines(spark, corpus.write_log_tree(spark, FOLDER))
    assert text_exchanges(plan(lines)) == [] and "BroadcastHashJoin" in plan(lines)


def test_dense_index_moves_no_text(spark, no_auto_broadcast):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id", "cast(id div 100 as string) as file", "repeat('x', 50) as value")
    from pyspark.sql import functions as F

    placed = numbering.index_in_place(rows, ["file"], F.min("id"), [F.col("first")])
    assert text_exchanges(plan(placed)) == []
    assert all(r["index"] == r["id"] + 1 for r in placed.collect())


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_numbers_agree_when_splits_are_many(spark, monkeypatch, limit):
    monkeypatch.setattr(numbering, "MAX_SPLITS", limit)
    lines = files.scan_lines(spark, corpus.write_log_tree(spark, FOLDER))
    by_file = {}
    for r in lines.collect():
        by_file.setdefault(r["file_path"], []).append(r["line_number"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_file.values())


def test_scores_join_nothing(spark):
    lines = evaluate.normalized_lines(corpus.labelled_events(spark, FOLDER))
    scored = evaluate.score_inputs(lines)
    assert "Join" not in plan(metrics.contingency(scored.keyed))
    assert "Join" not in plan(metrics.pair_metrics(scored.cells))
    from linewright.operators import errors

    assert "Join" not in plan(errors.failure_patterns(scored.cells))
    assert "method" not in scored.lines.columns


def test_group_ids_are_joined_by_key(spark):
    lines = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "index bigint, normalized_text string")
    text = plan(grouping.predict(grouping.with_templates(lines), "normalized_identity"))
    for line in text.split("\n"):
        if "hashpartitioning" in line:
            assert "hashpartitioning(_key" in line or "hashpartitioning(_bucket" in line, line
