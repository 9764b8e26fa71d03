import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import grouping
from linewright.operators.labels import join_predictions, last_wins
from linewright.operators.numbering import _running_offsets, dense_index, rank_by_first_index


def normalized(spark, values):
    df = spark.createDataFrame(list(enumerate(values, 1)), "index bigint, normalized_text string")
    return grouping.with_templates(df)


def groups(df):
    return {r["index"]: (r["predicted_group_id"], r["predicted_template"]) for r in df.collect()}


def test_identity_splits_and_pattern_merges(spark):
    lines = normalized(spark, ["INFO [scheduler] assigned job <INT> to node03", "INFO [scheduler] assigned job <INT> to node07"])
    identity = groups(grouping.predict(lines, "normalized_identity"))
    pattern = groups(grouping.predict(lines, "token_pattern"))
    assert identity[1][0] == "group_001" and identity[2][0] == "group_002"
    assert pattern[1] == pattern[2] == ("group_001", "INFO [scheduler] assigned job <INT> to <VAR>")


@pytest.mark.parametrize("hot_keys", [0, 3, 1000])
def test_groups_follow_first_appearance(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(grouping, "_HOT_KEYS", hot_keys)
    rng = random.Random(hot_keys)
    values = [f"w{'x' * int(rng.paretovariate(0.5)) if rng.random() < 0.6 else 'hot'}"[:60] for _ in range(800)]
    order = list(dict.fromkeys(values))
    got = groups(grouping.predict(normalized(spark, values), "normalized_identity"))
    assert got == {i: (f"group_{order.index(v) + 1:03d}", v) for i, v in enumerate(values, 1)}


def test_group_names_grow_past_three_digits(spark):
    got = {r["i"]: r["n"] for r in spark.range(0, 20000, 999).select(F.col("id").alias("i"), grouping.group_name(F.col("id")).alias("n")).collect()}
    assert got == {i: f"group_{i:03d}" for i in got}


def test_all_methods(spark):
    out = grouping.predict_all(normalized(spark, ["a 1", "a 2", "b"]))
    assert {(r["method"], r["index"], r["predicted_group_id"]) for r in out.collect()} == {
        ("normalized_identity", 1, "group_001"), ("normalized_identity", 2, "group_002"), ("normalized_identity", 3, "group_003"),
        ("token_pattern", 1, "group_001"), ("token_pattern", 2, "group_001"), ("token_pattern", 3, "group_002"),
    }
    assert list(grouping.METHODS) == ["normalized_identity", "token_pattern"]


def test_ranks_over_many_buckets(spark):
    rng = random.Random(9)
    firsts = rng.sample(range(1 << 45), 2000) + [0, 1, (1 << 20) - 1, 1 << 20]
    df = spark.createDataFrame([(f,) for f in firsts], "first_index bigint")
    got = {r["first_index"]: r["rank"] for r in rank_by_first_index(df).collect()}
    assert got == {f: i for i, f in enumerate(sorted(firsts), 1)}


def test_dense_index(spark):
    rows = [(["b"], 2), (["a", "z"], 1), (["a-b"], 1), (["a", "z"], 0), (["a"], 5)] + [([f"k{i % 7}", str(i)], i) for i in range(500)]
    got = {(tuple(r["p"]), r["n"]): r["index"] for r in dense_index(spark.createDataFrame(rows, "p array<string>, n bigint"), ["p", "n"]).collect()}
    assert got == {(tuple(p), n): i for i, (p, n) in enumerate(sorted(rows), 1)}
    assert dense_index(spark.createDataFrame([], "p string"), ["p"]).count() == 0


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in last_wins(df, ["k"], ["o"]).collect()} == {("a", None), ("b", "z")}


def test_predictions_join_and_missing_ones_fail(spark):
    lines = spark.createDataFrame(
        [(1, "g", None), (2, None, None), (3, None, "t")], "index bigint, expected_group_id string, expected_template string"
    )
    schema = "index bigint, predicted_group_id string, predicted_template string"
    full = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (9, "d", "w")], schema)
    assert {r["index"]: r["predicted_group_id"] for r in join_predictions(lines, full).collect()} == {1: "a", 2: "b", 3: "c"}
    without_2 = join_predictions(lines, full.where("index <> 2"))
    assert {r["index"] for r in without_2.collect()} == {1, 3}
    with pytest.raises(Exception, match="no prediction for index 3"):
        join_predictions(lines, full.where("index <> 3")).collect()


def test_template_counts(spark):
    lines = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a")], "index bigint, template string")
    assert {tuple(r) for r in grouping.template_counts(lines).collect()} == {("a", 2, 2), ("b", 1, 1)}


def test_running_offsets_sum_in_two_levels(spark):
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(40)}", i, rng.randrange(5)) for i in rng.sample(range(1000), 300)]
    got = _running_offsets(spark.createDataFrame(rows, "file string, start int, n bigint"), [F.col("file"), F.col("start")])
    expected, total = {}, 0
    for file, start, n in sorted(rows):
        expected[file, start] = total
        total += n
    assert {(r["file"], r["start"]): r["offset"] for r in got.collect()} == expected
    assert got.columns == ["file", "start", "n", "offset"]
    none = _running_offsets(spark.createDataFrame([], "file string, n bigint"), [F.col("file")])
    assert none.count() == 0
