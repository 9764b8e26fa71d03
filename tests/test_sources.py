import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trees import write_files
from linewright.functions.rules import Rule
from linewright.sources import datasets, files, hidden
from linewright.sources.rule_files import load_rules, rules_from


def scanned(spark, root):
    rows = files.scan_lines(spark, root).orderBy("file_path", "line_number").collect()
    return [(r["relative_path"], r["line_number"], r["value"]) for r in rows]


def discovered(spark, root):
    rows = files.discover(spark, root).collect()
    return [r["file_path"] for r in sorted(rows, key=lambda r: r["relative_path"].split("/"))]


def test_discovery(spark, tmp_path):
    root = write_files(tmp_path, {
        "zeta_rack4.log": "alpha\n", "inner/mill_host2.txt": "beta\n", "inner/notes.csv": "1,2", "B.LOG": "x\n",
        "deep/k=v/c d+e%f.TxT": "y\n", "empty.log": "", "log": "no suffix\n", "_kept/in.log": "z\n",
    })
    names = ["B.LOG", "_kept/in.log", "deep/k=v/c d+e%f.TxT", "empty.log", "inner/mill_host2.txt", "zeta_rack4.log"]
    assert discovered(spark, root) == [f"{root}/{n}" for n in names]
    assert {path for path, _, _ in scanned(spark, root)} == set(names) - {"empty.log"}
    sizes = {r["relative_path"]: (r["length"], r["modified"] is None) for r in files.discover(spark, root).collect()}
    assert sizes == {n: ((tmp_path / n).stat().st_size, n == "empty.log") for n in names}


def test_missing_empty_and_single_file_roots(spark, tmp_path):
    assert discovered(spark, str(tmp_path / "absent")) == []
    assert scanned(spark, str(tmp_path / "absent")) == []
    (tmp_path / "none").mkdir()
    assert discovered(spark, str(tmp_path / "none")) == []
    assert scanned(spark, str(tmp_path / "none")) == []
    assert files.load_records(spark, str(tmp_path / "none")).count() == 0
    root = write_files(tmp_path, {"one_node1.log": "a\nb\n", "other.json": "{}"})
    record = files.load_records(spark, f"{root}/one_node1.log").orderBy("line_number").first()
    assert (record["file_path"], record["source"], record["host"]) == (f"{root}/one_node1.log", "one", "node1")
    assert discovered(spark, f"{root}/other.json") == []


def test_line_breaks_blanks_and_decoding(spark, tmp_path):
    root = write_files(tmp_path, {"a.log": b"\n one \r\ntwo\rthree\n\n\xff\xe2\x82 x\x0cy\nlast"})
    assert scanned(spark, root) == [
        ("a.log", 1, ""), ("a.log", 2, " one "), ("a.log", 3, "two"), ("a.log", 4, "three"), ("a.log", 5, ""),
        ("a.log", 6, b"\xff\xe2\x82 x\x0cy".decode("utf-8", "replace")), ("a.log", 7, "last"),
    ]
    records = files.load_records(spark, root, job_id="j").orderBy("line_number").collect()
    assert [(r["line_number"], r["raw_text"], r["job_id"]) for r in records][:2] == [(2, "one", "j"), (3, "two", "j")]
    assert len(records) == 5


def test_numbers_over_many_splits(spark, tmp_path):
    rng = random.Random(4)
    content = {}
    for name in ("a/x.log", "a-b.log", "y.txt", "z.log"):
        lines = ["" if rng.random() < 0.2 else "w" * rng.randint(1, 60) for _ in range(rng.randint(1, 4000))]
        content[name] = "".join(line + rng.choice(["\n", "\r\n"]) for line in lines)
    root = write_files(tmp_path, content)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {}
        for path, number, value in scanned(spark, root):
            got.setdefault(path, []).append((number, value))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: list(enumerate(c.replace("\r\n", "\n").split("\n")[:-1], 1)) for n, c in content.items()}


LINES = "ERROR [rdma] after 3000 ms\n\n   \n  WARN two  \nthree\x0bfour\n"


def test_line_file_with_labels(spark, tmp_path):
    labels = {"name": "tiny", "records": [
        {"line_index": 1, "expected_group_id": "old", "expected_template": "t"}, {"line_index": "2", "expected_group_id": "g2"},
        {"line_index": 1, "expected_group_id": "g1"}, {"line_index": 99, "expected_group_id": "absent"},
    ]}
    root = write_files(tmp_path / "set", {"logs.txt": LINES, "labels.json": json.dumps(labels, indent=1)})
    loaded = datasets.load_labelled(spark, root)
    assert (loaded.name, loaded.kind, loaded.path) == ("tiny", "local", root)
    rows = loaded.records.orderBy("index").collect()
    assert [(r["index"], r["raw_text"], r["expected_group_id"], r["expected_template"]) for r in rows] == [
        (1, "ERROR [rdma] after 3000 ms", "g1", None), (2, "  WARN two  ", "g2", None), (3, "three", None, None), (4, "four", None, None),
    ]
    assert rows[0]["file_path"] is None and rows[0]["line_number"] is None


def test_line_file_without_name_and_with_bad_input(spark, tmp_path):
    root = write_files(tmp_path / "plain", {"logs.txt": "a\nb\n", "labels.json": "{}"})
    loaded = datasets.load_labelled(spark, root, mode="local")
    assert loaded.name == "plain" and loaded.records.count() == 2
    bad = write_files(tmp_path / "bad", {"logs.txt": b"ok\n\xff\n", "labels.json": "{}"})
    with pytest.raises(Exception, match="INVALID_UTF8"):
        datasets.load_labelled(spark, bad)
    broken = write_files(tmp_path / "broken", {"logs.txt": "a\n", "labels.json": "{oops"})
    with pytest.raises(Exception, match="MALFORMED"):
        datasets.load_labelled(spark, broken)
    nameless = write_files(tmp_path / "nameless", {"logs.txt": "a\n", "labels.json": '{"records": [{"expected_group_id": "g"}]}'})
    with pytest.raises(Exception, match="label without line_index"):
        datasets.load_labelled(spark, nameless).records.collect()


def test_log_tree_order_and_manifest(spark, tmp_path):
    manifest = {"name": "tree", "records": [
        {"file": "a/z_n1.log", "line_number": 3, "expected_group_id": "g", "expected_template": "t"},
        {"file": "b_n2.txt", "line_number": 1, "expected_group_id": "first"}, {"file": "b_n2.txt", "line_number": 1, "expected_group_id": "second"},
    ]}
    root = write_files(tmp_path / "tree", {
        "b_n2.txt": "one\n", "a/z_n1.log": "\n\ntwo\nthree\n", "a-c.log": "four\n", "benchmark_manifest.json": json.dumps(manifest),
    })
    loaded = datasets.load_labelled(spark, root)
    assert (loaded.name, loaded.kind) == ("tree", "synthetic")
    rows = loaded.records.orderBy("index").collect()
    # path components sort a/z before a-c
    assert [(r["index"], r["raw_text"], r["line_number"], r["expected_group_id"]) for r in rows] == [
        (1, "two", 3, "g"), (2, "three", 4, None), (3, "four", 1, None), (4, "one", 1, "second"),
    ]
    assert (rows[0]["source"], rows[0]["host"], rows[0]["file_path"]) == ("z", "n1", f"{root}/a/z_n1.log")


def test_log_tree_without_manifest_and_with_label_frame(spark, tmp_path):
    root = write_files(tmp_path / "t", {"a.log": "x\ny\n"})
    assert datasets.load_labelled(spark, root).records.where("expected_group_id is not null").count() == 0
    labels = spark.createDataFrame([("a.log", 2, "g", None)], "file string, line_number bigint, expected_group_id string, expected_template string")
    records = datasets.load_labelled(spark, root, labels=labels).records
    assert [r["raw_text"] for r in records.where("expected_group_id = 'g'").collect()] == ["y"]


def test_modes(spark, tmp_path):
    root = write_files(tmp_path, {"logs.txt": "a\n"})
    assert datasets.resolve_mode(spark, root, "auto") == "synthetic"
    assert datasets.resolve_mode(spark, root, "local") == "local"
    write_files(tmp_path, {"labels.json": "{}"})
    assert datasets.resolve_mode(spark, root, "auto") == "local"
    with pytest.raises(ValueError, match="other"):
        datasets.load_labelled(spark, root, mode="other")


def test_rule_files(spark, tmp_path):
    document = {"rules": [
        {"name": "a", "enabled": True, "pattern": "\\bx\\b", "replacement": "<X>"}, {"name": "b", "enabled": False, "pattern": "y", "replacement": ""},
        {"name": "c", "pattern": "z", "replacement": "<Z>"},
    ]}
    root = write_files(tmp_path, {"rules.json": json.dumps(document), "none.json": "{}"})
    expected = [Rule("a", r"\bx\b", "<X>"), Rule("c", "z", "<Z>")]
    assert load_rules(f"{root}/rules.json") == expected
    assert load_rules(f"{root}/rules.json", spark) == expected
    assert load_rules(f"{root}/none.json") == []
    pytest.importorskip("yaml")
    write_files(tmp_path, {"rules.yaml": 'rules:\n  - name: a\n    pattern: "\\\\bx\\\\b"\n    replacement: "<X>"\n  - {name: c, pattern: z, replacement: <Z>}\n', "empty.yaml": ""})
    assert load_rules(f"{root}/rules.yaml") == expected
    assert load_rules(f"{root}/empty.yaml") == []
    with pytest.raises(KeyError):
        rules_from([{"name": "a", "pattern": "x"}])


@pytest.mark.parametrize("read_bytes", [1, 2, 7, 1 << 20])
def test_byte_ranges_give_every_line_once(monkeypatch, read_bytes):
    """Any cut of a file into ranges, between the two bytes of a line end too, gives the lines of the whole."""
    monkeypatch.setattr(hidden, "_READ_BYTES", read_bytes)
    rng = random.Random(read_bytes)
    for _ in range(300):
        data = bytes(rng.choices(b"ab\r\n", k=rng.randrange(0, 24)))
        whole = re.split(rb"\r\n|\r|\n", data)
        whole = whole[:-1] if not whole[-1] else whole
        cuts = sorted({0, len(data), *(rng.randrange(0, len(data) + 1) for _ in range(4))})
        parts = [list(hidden.lines_from(io.BytesIO(data), a, b)) for a, b in zip(cuts, cuts[1:])]
        assert [line for part in parts for line in part] == whole, (data, cuts)


def test_hidden_files_in_many_ranges(spark, tmp_path):
    """Hidden files in several byte ranges, deep in a tree and with odd names, are read as Spark reads others."""
    rng = random.Random(5)
    content = "".join("w" * rng.randint(0, 60) + rng.choice(["\n", "\r\n"]) for _ in range(3000)).encode() + b"\xff end"
    names = ["_x.log", "a [1]/b{c}/.y z%.TXT", ".k/_deep/_z.log", "plain/q.log"]
    root = write_files(tmp_path, {**dict.fromkeys(names, content), "a/.notes": "no", "_no/readme.md": "no", "_empty.log": "", ".bom.log": b"\xef\xbb\xbfone\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {}
        for path, number, value in scanned(spark, root):
            got.setdefault(path, []).append((number, value))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    lines = content.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    assert got == {**dict.fromkeys(names, list(enumerate(lines, 1))), ".bom.log": [(1, "one")]}
    assert set(discovered(spark, root)) == {f"{root}/{n}" for n in [*names, "_empty.log", ".bom.log"]}
    alone = files.scan_lines(spark, f"{root}/_x.log")
    assert (alone.count(), alone.first()["file_path"]) == (len(lines), f"{root}/_x.log")


def test_hidden_files_in_a_store_of_spark_only():
    with pytest.raises(ValueError, match="only Spark"):
        hidden.open_store("viewfs://store/in/_x.log")
