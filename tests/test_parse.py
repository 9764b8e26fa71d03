import re
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linewright.functions import parse, text


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", make(F.col("t")).alias("r"))
    return [row["r"] for row in rows.orderBy("i").collect()]


TIMES = [
    ("2026-03-30T10:15:05Z INFO x", datetime(2026, 3, 30, 10, 15, 5)),
    ("2026-03-30T10:15:05.5Z", datetime(2026, 3, 30, 10, 15, 5, 500000)),
    ("2026-03-30T10:15:05.123456789Z x", datetime(2026, 3, 30, 10, 15, 5, 123456)),
    ("2026-03-30 10:15:09,120 ERROR", datetime(2026, 3, 30, 10, 15, 9, 120000)),
    ("2026-03-30 10:15:09,12 x", datetime(2026, 3, 30, 10, 15, 9)),
    ("2026-03-30 10:15:09,1234", datetime(2026, 3, 30, 10, 15, 9, 123000)),
    ("2026-03-30 10:15:09.120", datetime(2026, 3, 30, 10, 15, 9)),
    ("Mar 30 10:15:10 WARNING", datetime(2024, 3, 30, 10, 15, 10)),
    ("Feb 29 10:15:10", datetime(2024, 2, 29, 10, 15, 10)),
    ("Mar 3 10:15:10", None),
    ("2026-03-30T10:15:05+00:00", None),
    ("2026-03-30T10:15:05 x", None),
    ("x 2026-03-30 10:15:00", None),
    ("plain status line", None),
    ("", None),
]
BAD_TIMES = ["2026-13-30 10:15:00", "2026-03-30 24:00:00", "2026-02-30 10:00:00,000", "Xyz 12 10:00:00", "2026-03-30T10:61:00Z"]


def test_timestamps(spark):
    got = column(spark, [t for t, _ in TIMES], lambda c: parse.timestamp(c, 2024))
    assert got == [expected for _, expected in TIMES]


def test_impossible_timestamps(spark):
    assert column(spark, BAD_TIMES, lambda c: parse.timestamp(c, 2024)) == [None] * len(BAD_TIMES)
    for bad in BAD_TIMES:
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            column(spark, [bad], lambda c: parse.timestamp(c, 2024, on_bad="fail"))


def test_default_year_is_the_current_one(spark):
    [got] = column(spark, ["Mar 30 10:15:10 x"], parse.timestamp)
    assert got == datetime(parse.current_utc_year(), 3, 30, 10, 15, 10)


def test_severity_and_component(spark):
    lines = ["a WARNING b ERROR", "WARN", "xINFO INFO_ INFO2 éINFO", "𝔄INFO", "info", "é INFO.", "FATAL:", "[a b] [rdma] [x]", "[]", "[a.b-c_1]"]
    assert column(spark, lines, parse.severity) == ["WARNING", "WARN", None, None, None, "INFO", "FATAL", None, None, None]
    assert column(spark, lines, parse.component)[-3:] == ["rdma", None, "a.b-c_1"]


@pytest.mark.parametrize(
    "name, source, host",
    [
        ("trainer_node03.log", "trainer", "node03"), ("a-b-c1.txt", "a", "b-c1"), ("gpu-worker-node7.log", "gpu", "worker-node7"),
        ("trainer.log", "trainer", None), ("trainer-node.log", "trainer-node", None), ("trainer_node.log", None, None),
        ("worker_eu_node1.log", None, None), ("3trainer.log", None, None), ("a.b.log", None, None), ("x_n1.LOG", "x", "n1"),
    ],
)
def test_source_and_host(spark, name, source, host):
    path = F.lit(f"/some.dir/{name}")
    row = spark.range(1).select(parse.source_of(path).alias("s"), parse.host_of(path).alias("h")).first()
    assert (row["s"], row["h"]) == (source, host)


def test_strip_and_split_follow_python(spark):
    spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    values = [f"{s}a{s}{s}b{s}" for s in spaces] + ["​x​", "﻿x", "", " 　"]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.words) == [v.split() or [""] for v in values]
    pieces = [f"a{s}b" for s in spaces if s not in "\r\n"]
    got = column(spark, pieces, lambda c: F.split(c, text.EXTRA_LINE_BREAKS))
    assert got == [p.splitlines() for p in pieces]


def test_digit_class_follows_python(spark):
    # Newer Unicode versions only add digits, so compare where both engines know the character.
    points = [i for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, chr(i)) for i in points], "i int, c string")
    found = {row["i"] for row in df.where(F.rlike("c", F.lit(text.digit_class()))).select("i").collect()}
    python = {i for i in points if chr(i).isdigit()}
    assert found <= python
    assert {i for i in python - found} <= {i for i in python if i > 0x1000}
    assert len(python - found) < 60


def test_record_ids(spark):
    def ids(job, mode="stable"):
        df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "p string, n bigint")
        return [r["i"] for r in df.select(parse.record_id(F.lit(job).cast("string"), F.col("p"), F.col("n"), mode).alias("i")).collect()]

    assert ids("j") == ids("j") and len(set(ids("j"))) == 3
    assert not set(ids("j")) & set(ids(None))
    assert len(set(ids("j", "random") + ids("j", "random"))) == 6
    assert all(re.fullmatch(r"[0-9a-f-]{36}", i) for i in ids("j", "random"))
    with pytest.raises(ValueError):
        ids("j", "other")


def test_digits_of_other_scripts_and_year_zero(texts):
    df = texts("٢٠٣١-٠٥-٠٦ ٠٧:٠٨:٠٩ x", "2031-05-0६ 07:08:09 x", "Mar ٣٠ 10:15:10 é", "0000-01-01 00:00:00 x", "0000-01-01T00:00:00Z", "0001-01-01 00:00:00")
    out = [r["t"] for r in df.select("index", parse.timestamp(F.col("raw_text"), 2031).alias("t")).orderBy("index").collect()]
    assert out == [datetime(2031, 5, 6, 7, 8, 9)] * 2 + [datetime(2031, 3, 30, 10, 15, 10), None, None, datetime(1, 1, 1)]
    with pytest.raises(Exception, match="no such year"):
        texts("0000-01-01 00:00:00 x").select(parse.timestamp(F.col("raw_text"), 2031, "fail")).collect()
