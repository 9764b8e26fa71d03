"""Label documents cut into records, against Python's json."""

import json
import random

import pytest

from linewright.sources import label_json
from linewright.sources.corpus import write_label_file
from linewright.sources.label_json import read_label_document

RECORD = "line_index string, expected_group_id string, expected_template string"


def read(spark, tmp_path, text, split=None):
    path = tmp_path / "labels.json"
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        name, records = read_label_document(spark, str(path), RECORD)
        rows = sorted(records.collect())
        assert len({r["position"] for r in rows}) == len(rows)
        return name, [tuple(r)[1:] for r in rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def expected(text):
    document = json.loads(text)
    fields = [f.split()[0] for f in RECORD.split(", ")]
    return document.get("name"), [tuple(None if r.get(f) is None else str(r[f]) for f in fields) for r in document.get("records") or []]


ODD = ['}', '{', '"', '\\', '"}', '\\"}{[', ']', '[{"records": [', 'é\n\t', '"records": [', '} , {', '\\\\"', '']


def document(seed, n, **layout):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(ODD + ["a b", "x"], k=rng.randrange(0, 5)))
    records = [{"line_index": i, "expected_group_id": word(), "other": {word(): [word(), {"k": word()}]}, "expected_template": rng.choice([None, word()])} for i in range(n)]
    parts = [("meta", {"records": [{"line_index": 9}], "s": word()}), ("name", word()), ("also", [{"a": word()}, {"b": 1}]), ("records", records), ("last", [[{"c": word()}], word()])]
    rng.shuffle(parts)
    return json.dumps(dict(parts), **layout)


@pytest.mark.parametrize(("seed", "layout"), [(1, {}), (2, {"indent": 2}), (3, {"separators": (",", ":"), "ensure_ascii": False})])
def test_records_with_braces_in_texts_and_nested_objects(spark, tmp_path, monkeypatch, seed, layout):
    monkeypatch.setattr(label_json, "_BUCKET_BITS", 3)
    text = document(seed, 60, **layout)
    assert read(spark, tmp_path, text, split=500) == expected(text)


@pytest.mark.parametrize(
    "text",
    [
        "{}", '{"name": "n"}', '{"records": []}', '{"name": null, "records": [ ] }\n', '{"records": [{}]}', '{"records": [{"line_index": 1}], "name": "late"}',
        ' {"a": {"b": {}}, "records" : [ {"line_index": "7"} , {"line_index": 8} ] , "name": "x", "z": [] } ', '﻿{"name": "b", "records": [{"line_index": 1}]}',
    ],
)
def test_small_documents(spark, tmp_path, text):
    assert read(spark, tmp_path, text) == expected(text.removeprefix("﻿"))


@pytest.mark.parametrize(
    "text", ["", "{oops", "{", '{"records": [{"line_index": 1}', '{"name": "x}', '{"records": [{"line_index": 1} {"line_index": 2}]}', '{"records": [{"line_index": }]}', '{"records": [1, 2]}', '{"a": 1}}', '{"records": [{"line_index": 1}]'],
)
def test_malformed_documents(spark, tmp_path, text):
    with pytest.raises(Exception, match=r"(?i)json|malformed|empty|records|parse"):
        read(spark, tmp_path, text)


def test_document_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(label_json, "_BUCKET_BITS", 3)
    text = document(4, 80, indent=1)
    lines = text.splitlines(keepends=True)
    (tmp_path / "parts").mkdir()
    for i in range(0, len(lines), 7):
        (tmp_path / "parts" / f"part-{i:05d}.txt").write_text("".join(lines[i : i + 7]))
    name, records = read_label_document(spark, str(tmp_path / "parts"), RECORD)
    assert (name, [tuple(r)[1:] for r in sorted(records.collect())]) == expected(text)


def test_a_document_is_written_in_parts_by_several_tasks(spark, tmp_path):
    rows = [(i, p, f"g{i}#{p}", f'a "{i}" }} {{') for i in range(400) for p in range(1 + (i % 5 == 0))]
    labels = spark.createDataFrame(rows, "index bigint, position int, expected_group_id string, expected_template string")
    path = str(tmp_path / "labels.json")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_label_file(labels.repartition(3), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted((tmp_path / "labels.json").glob("part-*"))
    assert len(parts) > 1
    document = json.loads("".join(p.read_text() for p in parts))
    assert [r["line_index"] for r in document["records"]] == [0] + [r[0] for r in rows]
    name, records = read_label_document(spark, path, RECORD)
    found = [tuple(r)[1:] for r in sorted(records.collect())]
    assert name == "events" and found[1:] == [(str(i), g, t) for i, _, g, t in rows]
