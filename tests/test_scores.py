"""Scores and error examples against brute force over all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from linewright.functions.normalize import with_counts
from linewright.functions.rules import Rule
from linewright.operators import errors, metrics

SCHEMA = """method string, index bigint, raw_text string, expected_group_id string, expected_template string,
    predicted_group_id string, predicted_template string"""


def random_rows(seed, n=60, labels=4, cells=5, method="m"):
    rng = random.Random(seed)
    indexes = rng.sample(range(1, 10 * n + 1), n)
    rows = []
    for i in sorted(indexes):
        group = rng.choice([None, *"abcdefgh"[:labels]])
        cell = rng.randrange(cells)
        template = rng.choice([None, f"t{cell}", f"t{rng.randrange(cells)}"])
        rows.append((method, i, f"text {i}", group, template, f"g{cell}", f"t{cell}"))
    rng.shuffle(rows)
    return rows


def predicted(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_scores(rows):
    labelled = [r for r in rows if r[3] is not None]
    templated = [r for r in rows if r[4] is not None]
    pairs = Counter((a[3] == b[3], a[5] == b[5]) for a, b in combinations(labelled, 2))
    total = sum(pairs.values())
    return (
        len({r[6] for r in rows}),
        len({r[4] for r in templated}) or None,
        sum(r[4] == r[6] for r in templated) / len(templated) if templated else None,
        sum(r[3] is not None or r[4] is not None for r in rows),
        (pairs[True, True] + pairs[False, False]) / total if total else None,
        pairs[True, False] if total else None,
        pairs[False, True] if total else None,
    )


def scores(df):
    return {r["method"]: tuple(r)[1:] for r in metrics.grouping_metrics(metrics.contingency(df)).collect()}


@pytest.mark.parametrize("seed, n, labels, cells", [(1, 60, 4, 5), (2, 60, 1, 3), (3, 60, 8, 1), (4, 40, 3, 40), (5, 1, 1, 1), (6, 3, 1, 1)])
def test_scores(spark, seed, n, labels, cells):
    rows = random_rows(seed, n, labels, cells) + random_rows(seed + 100, n, labels, cells, "other")
    got = scores(predicted(spark, rows))
    assert got == {m: pytest.approx(brute_scores([r for r in rows if r[0] == m])) for m in ("m", "other")}


def test_scores_with_few_labels(spark):
    unlabelled = ("m", 1, "a", None, None, "g1", "t1")
    one = ("m", 2, "b", "x", None, "g1", "t1")
    assert scores(predicted(spark, [unlabelled]))["m"] == (1, None, None, 0, None, None, None)
    assert scores(predicted(spark, [unlabelled, one]))["m"] == (1, None, None, 1, None, None, None)
    split = [("m", 1, "a", "timeout", "timeout", "group_001", "timeout"), ("m", 2, "b", "timeout", "timeout", "group_002", "timeout")]
    assert scores(predicted(spark, split))["m"] == (1, 1, 1.0, 2, 0.0, 1, 0)


def test_pair_counts_past_64_bits(spark):
    cells = spark.createDataFrame(
        [("m", "a", None, "g", "t", 6_000_000_000), ("m", "b", None, "g", "t", 1), ("m", "a", None, "h", "u", 2)],
        "method string, expected_group_id string, expected_template string, predicted_group_id string, predicted_template string, n bigint",
    )
    row = metrics.pair_metrics(cells).first()
    assert int(row["over_merging_pairs"]) == 6_000_000_000
    assert int(row["over_splitting_pairs"]) == 12_000_000_000
    big = cells.withColumn("expected_group_id", F.lit("a")).withColumn("predicted_group_id", F.col("predicted_template"))
    assert int(metrics.pair_metrics(big.withColumn("n", F.lit(6_000_000_000))).first()["over_splitting_pairs"]) == 12 * 10**9 * 6 * 10**9


def brute_pairs(rows, k, same, differ, shown):
    labelled = sorted((r for r in rows if r[3] is not None), key=lambda r: r[1])
    found = [(a[1], b[1], a[2], b[2], a[shown]) for a, b in combinations(labelled, 2) if a[same] == b[same] and a[differ] != b[differ]]
    return found[:k]


@pytest.mark.parametrize("k", [0, 1, 5, 1000])
@pytest.mark.parametrize("seed, labels, cells", [(1, 4, 5), (2, 1, 3), (3, 8, 1), (4, 8, 40), (5, 2, 2)])
def test_first_pairs(spark, seed, labels, cells, k):
    rows = random_rows(seed, 50, labels, cells)
    df = predicted(spark, rows)
    assert [tuple(r) for r in errors.false_splits(df, metrics.contingency(df), k).collect()] == brute_pairs(rows, k, 3, 5, 3)
    assert [tuple(r) for r in errors.false_merges(df, metrics.contingency(df), k).collect()] == brute_pairs(rows, k, 5, 3, 5)


def test_first_pairs_at_the_end_of_a_group(spark):
    # the last cell goes on alone; only lines up to the other cells' end have partners
    rows = [("m", i, str(i), "e", None, g, g) for i, g in enumerate("aababbb", 1)]
    df = predicted(spark, rows)
    assert [tuple(r)[:2] for r in errors.false_splits(df, metrics.contingency(df), 100).collect()] == [p[:2] for p in brute_pairs(rows, 100, 3, 5, 3)]


@pytest.mark.parametrize("k", [0, 2, 50])
def test_mismatches_and_patterns(spark, k):
    rows = random_rows(7, 80)
    df = predicted(spark, rows)
    wrong = sorted((r for r in rows if r[4] is not None and r[4] != r[6]), key=lambda r: r[1])
    assert [tuple(r) for r in errors.template_mismatches(df, k).collect()] == [(r[1], r[2], r[4], r[6]) for r in wrong][:k]
    counts = Counter(f"template_mismatch::{r[4]} -> {r[6]}" for r in wrong)
    got = errors.failure_patterns(metrics.contingency(df), k).collect()
    assert [(r["pattern"], r["count"]) for r in got] == counts.most_common(k)


def test_normalization_scores(texts):
    rules = [Rule("n", r"\d+", "<N>"), Rule("w", r"zz", "y"), Rule("n", r"q", "<N>"), Rule("off", "a", "b", enabled=False)]
    counted = with_counts(texts("a 1 2", "plain", "3 q", "x"), rules=rules)
    row = metrics.normalization_metrics(counted).first()
    assert tuple(row) == (4, 2, 50.0)
    assert [tuple(r) for r in metrics.replacement_counts(counted, rules).collect()] == [("n", 4)]
    examples = metrics.changed_examples(counted, 1).collect()
    assert [tuple(r) for r in examples] == [(1, "a 1 2", "a <N> <N>")]
    assert metrics.changed_examples(counted, 0).count() == 0
    empty = counted.where("index > 99")
    assert tuple(metrics.normalization_metrics(empty).first()) == (0, 0, 0.0)
    assert metrics.replacement_counts(empty, rules).count() == 0
    assert metrics.replacement_counts(empty, []).count() == 0


@pytest.mark.parametrize("most", [0, 10_000])
def test_many_examples_are_joined_by_key(spark, monkeypatch, most):
    """All false splits of a set, with and without a broadcast."""
    monkeypatch.setattr(errors, "MAX_BROADCAST", most)
    rows = [(i, f"line {i}", f"g{i % 7}", f"p{i % 3}") for i in range(60)]
    lines = spark.createDataFrame(rows, "index bigint, raw_text string, expected_group_id string, predicted_group_id string")
    cells = lines.groupBy("expected_group_id", "predicted_group_id").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    found = [(r["left_index"], r["right_index"]) for r in errors.false_splits(lines, cells, 5000).collect()]
    assert found == [(i, j) for i in range(60) for j in range(i + 1, 60) if i % 7 == j % 7 and i % 3 != j % 3]
    plan = errors.false_splits(lines, cells, 5000)._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == bool(most)
