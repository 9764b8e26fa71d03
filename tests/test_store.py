from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trees import write_files
from linewright.functions.rules import Rule
from linewright.plans.ingest import ingest
from linewright.schemas import LOG_RECORD
from linewright.sources.record_table import RecordTable
from linewright.streaming.arrivals import ingest_arrivals


def record(**changes):
    base = dict(
        id="q7", timestamp=datetime(2031, 11, 2, 4, 5, 6), source="billing", host="rack9", job_id="nightly", severity="ERROR", component="ledger",
        raw_text="2031-11-02 04:05:06 ERROR [ledger] page 17 unreadable", normalized_text="ERROR [ledger] page <INT> unreadable",
        file_path="/spool/billing_rack9.log", line_number=1,
    )
    return tuple({**base, **changes}.values())


def rows(table):
    return {r["id"]: r for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    made = RecordTable(spark, str(tmp_path / "records"))
    made.create()
    return made


def frame(spark, *records):
    return spark.createDataFrame(list(records), LOG_RECORD)


def test_round_trip(spark, table):
    assert table.read().count() == 0 and table.read().schema.fieldNames() == LOG_RECORD.fieldNames()
    assert table.upsert(frame(spark, record())) == 1
    assert tuple(table.read().first()) == record()
    table.create()
    table.create_view("log_records")
    assert spark.sql("select host from log_records where severity = 'ERROR'").first()["host"] == "rack9"


def test_upsert_replaces_by_id(spark, table):
    table.upsert(frame(spark, record(id="a"), record(id="b")))
    table.upsert(frame(spark, record(id="c")))
    assert table.upsert(frame(spark, record(id="b", raw_text="new b"), record(id="d"))) == 2
    assert {k: r["raw_text"] for k, r in rows(table).items() if r["raw_text"].startswith("new")} == {"b": "new b"}
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b", "c", "d"]
    # every stored row replaced at once
    table.upsert(frame(spark, *[record(id=i, raw_text="newer") for i in "abcd"]))
    assert sorted((r["id"], r["raw_text"]) for r in table.read().collect()) == [(i, "newer") for i in "abcd"]


def test_upsert_of_nothing_and_of_repeated_ids(spark, table):
    assert table.upsert(frame(spark)) == 0
    assert table.read().count() == 0
    batch = frame(spark, record(id="a", line_number=2, raw_text="late"), record(id="a", line_number=1, raw_text="early"), record(id="b"))
    assert table.upsert(batch) == 3
    assert rows(table)["a"]["raw_text"] == "late" and table.read().count() == 2


def test_untouched_parts_are_not_rewritten(spark, table):
    table.upsert(frame(spark, record(id="a")))
    first = set(table.current().parts)
    table.upsert(frame(spark, record(id="b")))
    second = set(table.current().parts) - first
    table.upsert(frame(spark, record(id="b", raw_text="new"), record(id="c")))
    now = set(table.current().parts)
    assert first <= now and not second & now
    assert rows(table)["b"]["raw_text"] == "new"


def test_interleaved_writers(spark, table, monkeypatch):
    table.upsert(frame(spark, record(id="a", raw_text="old")))
    plain, once = RecordTable._publish, []

    def interrupted(self, base, parts):
        if not once:
            once.append(True)
            other = RecordTable(spark, table.path)
            assert other.upsert(frame(spark, record(id="a", raw_text="other"), record(id="b"))) == 2
        return plain(self, base, parts)

    monkeypatch.setattr(RecordTable, "_publish", interrupted)
    assert table.upsert(frame(spark, record(id="a", raw_text="mine"), record(id="c"))) == 2
    assert sorted((r["id"], r["raw_text"]) for r in table.read().collect() if r["id"] == "a") == [("a", "mine")]
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b", "c"]


def test_failed_write_and_reader_during_upsert(spark, table, monkeypatch):
    table.upsert(frame(spark, record(id="a", raw_text="old"), record(id="b")))
    reader = table.read()

    def broken(self, base, parts):
        raise OSError("gone")

    with monkeypatch.context() as patch:
        patch.setattr(RecordTable, "_publish", broken)
        with pytest.raises(OSError):
            table.upsert(frame(spark, record(id="a", raw_text="new")))
    assert rows(table)["a"]["raw_text"] == "old" and table.read().count() == 2
    table.upsert(frame(spark, record(id="a", raw_text="new")))
    assert {r["id"]: r["raw_text"] for r in reader.collect()}["a"] == "old"
    assert rows(table)["a"]["raw_text"] == "new"


def test_loads_replace_only_themselves(spark, table, monkeypatch):
    table.replace_load(frame(spark, record(id="a")), "s#0")
    table.replace_load(frame(spark, record(id="b")), "s#1")
    monkeypatch.setattr(RecordTable, "_without", None)
    assert table.replace_load(frame(spark, record(id="b"), record(id="c")), "s#1") == 2
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b", "c"]


def test_scope_reaches_the_scan(spark, table):
    table.upsert(frame(spark, record(id="a", job_id="one")))
    plan = table.read().where(F.col("job_id").eqNullSafe("one")).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [EqualNullSafe(job_id,one)]" in plan and "ReadSchema: struct<id:string,job_id:string>" in plan


def test_inspect(spark, table):
    table.upsert(frame(spark, *[record(id=str(i), file_path=f"/{'ab'[i % 2]}.log", line_number=i + 1) for i in range(12)]))
    shown = table.inspect(3).collect()
    assert len(shown) == 3 and shown[0].asDict().keys() == {"source", "host", "job_id", "raw_text", "normalized_text"}


LOGS = {
    "trainer_node03.log": "2026-03-30 10:15:00 ERROR [rdma] timeout after 3000 ms from 10.0.0.5\n\nplain\n",
    "sub/empty.txt": "", "sub/blank.txt": "\n  \n", "other.json": "{}",
}


def test_ingest_twice(spark, tmp_path):
    root, path = write_files(tmp_path / "logs", LOGS), str(tmp_path / "table")
    rules = [Rule("duration", r"\b\d+\s?ms\b", "<DURATION>")]
    first = ingest(spark, root, path, "run_042", rules)
    assert (first.files_processed, first.log_lines_ingested, first.records_written, first.table_path) == (3, 2, 2, path)
    again = ingest(spark, root, path, "run_042", rules)
    assert again == first
    stored = RecordTable(spark, path).read()
    assert stored.count() == 2
    line = stored.where("line_number = 1").first()
    assert (line["timestamp"], line["severity"], line["component"], line["source"], line["host"], line["job_id"]) == (
        datetime(2026, 3, 30, 10, 15), "ERROR", "rdma", "trainer", "node03", "run_042")
    assert line["normalized_text"] == "2026-03-30 10:15:00 ERROR [rdma] timeout after <DURATION> from 10.0.0.5"
    assert line["file_path"] == f"{root}/trainer_node03.log"
    ingest(spark, root, path, None, rules)
    assert RecordTable(spark, path).read().count() == 4
    ingest(spark, root, path, "run_042", rules, id_mode="random")
    assert RecordTable(spark, path).read().count() == 6


def test_hidden_names(spark, tmp_path):
    root, path = write_files(tmp_path / "logs", {**LOGS, "_old/a.log": "one\n", ".cache/_deep/d.log": "two\n", "sub/_k=1.log": "three\n"}), str(tmp_path / "t")
    assert ingest(spark, root, path, "j").files_processed == 6
    assert {"one", "two", "three"} <= {r["raw_text"] for r in RecordTable(spark, path).read().collect()}
    write_files(tmp_path / "logs", {"_b.log": "four\n\nfive", "sub/.c.txt": "six\n"})
    with pytest.raises(ValueError, match="2 log files"):
        ingest(spark, root, path, "j", on_hidden="fail")
    assert ingest(spark, root, path, "j").files_processed == 8
    found = {(r["file_path"].removeprefix(root + "/"), r["line_number"], r["raw_text"]) for r in RecordTable(spark, path).read().collect()}
    assert {("_b.log", 1, "four"), ("_b.log", 3, "five"), ("sub/.c.txt", 1, "six"), (".cache/_deep/d.log", 1, "two")} <= found
    summary = ingest(spark, root, path, "j", on_hidden="skip")
    assert (summary.files_processed, summary.files_skipped, summary.records_written) == (6, 2, 5)


def test_files_that_arrive_during_an_ingest_are_not_counted(spark, tmp_path, monkeypatch):
    from linewright.sources import files as module

    root, path = write_files(tmp_path / "logs", LOGS), str(tmp_path / "t")
    plain = module.numbered

    def late(scan, where):
        write_files(tmp_path / "logs", {"late.log": "late\n"})
        return plain(scan, where)

    monkeypatch.setattr(module, "numbered", late)
    summary = ingest(spark, root, path, "j")
    assert (summary.files_processed, summary.records_written) == (3, 2)


def test_ingest_of_nothing(spark, tmp_path):
    summary = ingest(spark, str(tmp_path / "absent"), str(tmp_path / "table"))
    assert (summary.files_processed, summary.log_lines_ingested, summary.records_written) == (0, 0, 0)


def test_arriving_files(spark, tmp_path):
    root, path, checkpoint = write_files(tmp_path / "in", LOGS), str(tmp_path / "table"), str(tmp_path / "cp")

    def run():
        query = ingest_arrivals(spark, root, path, checkpoint, job_id="live")
        query.awaitTermination()
        assert query.exception() is None
        return {(r["file_path"].removeprefix(root + "/"), r["line_number"], r["raw_text"]) for r in RecordTable(spark, path).read().collect()}

    first = {("trainer_node03.log", 1, LOGS["trainer_node03.log"].split("\n")[0]), ("trainer_node03.log", 3, "plain")}
    assert run() == first
    assert run() == first
    write_files(tmp_path / "in", {"late/x_n1.log": "\nlate\n"})
    assert run() == first | {("late/x_n1.log", 2, "late")}


def test_one_job_rewrites_all_touched_parts(spark, tmp_path):
    """Parts that hold replaced ids are written again together; emptied ones go, untouched ones stay as files."""
    path = str(tmp_path / "table")
    table = RecordTable(spark, path)
    table.create()
    rows = [record(id=f"{part}-{i}", raw_text=f"{part} {i}", line_number=i) for part in "abcd" for i in range(5)]
    for part in "abcd":
        table.upsert(spark.createDataFrame([r for r in rows if r[0].startswith(part)], LOG_RECORD))
    first = table.current()
    changed = [record(id=i, raw_text="new", line_number=int(i[2:])) for i in ["a-1", "b-2", "b-3", *(f"c-{k}" for k in range(5))]]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rewrite", "")
    table.upsert(spark.createDataFrame(changed, LOG_RECORD))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    now = table.current()
    ids = {r["id"]: r["raw_text"] for r in table.read().collect()}
    assert ids == {r[0]: "new" if r[0] in {c[0] for c in changed} else r[7] for r in rows}
    assert len(set(first.parts) & set(now.parts)) == 1 and len(now.parts) == 4
    # Again, so that parts which replace others are replaced themselves.
    table.upsert(spark.createDataFrame([record(id="a-0", raw_text="newer"), record(id="c-4", raw_text="newer"), record(id="d-0", raw_text="newer")], LOG_RECORD))
    ids |= {"a-0": "newer", "c-4": "newer", "d-0": "newer"}
    assert {r["id"]: r["raw_text"] for r in table.read().collect()} == ids and table.read().count() == 20
    assert {r["id"] for r in table.read(first).collect()} == {r[0] for r in rows}
    assert len(jobs.getJobIdsForGroup("rewrite")) < 25


def test_the_number_of_jobs_does_not_follow_the_parts(spark, tmp_path):
    counts = []
    for parts in (2, 12):
        table = RecordTable(spark, str(tmp_path / f"t{parts}"))
        table.create()
        for p in range(parts):
            table.upsert(spark.createDataFrame([record(id=f"{p}-{i}") for i in range(3)], LOG_RECORD), unique_ids=True, new_ids=True)
        group = f"parts {parts}"
        spark.sparkContext.setJobGroup(group, "")
        table.upsert(spark.createDataFrame([record(id=f"{p}-1", raw_text="new") for p in range(parts)], LOG_RECORD), unique_ids=True)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        assert table.read().where("raw_text = 'new'").count() == parts and table.read().count() == 3 * parts
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_nothing_staged_is_left_after_a_write(spark, tmp_path):
    staged = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "linewright"
    before = set(staged.iterdir()) if staged.exists() else set()
    root, path = write_files(tmp_path / "logs", LOGS), str(tmp_path / "t")
    ingest(spark, root, path, "j")
    ingest(spark, root, path, "j")
    RecordTable(spark, path).upsert(RecordTable(spark, path).read())
    assert (set(staged.iterdir()) if staged.exists() else set()) == before
    assert sorted(p.name for p in Path(path).iterdir()) == ["manifests", "parts"]


def test_streams_report_hidden_names(spark, tmp_path):
    root = write_files(tmp_path / "in", {**LOGS, "_b.log": "lost\n"})
    with pytest.raises(ValueError, match="1 log files"):
        ingest_arrivals(spark, root, str(tmp_path / "t"), str(tmp_path / "c"), "j")
    ingest_arrivals(spark, root, str(tmp_path / "t"), str(tmp_path / "c"), "j", on_hidden="skip").awaitTermination()
    assert RecordTable(spark, str(tmp_path / "t")).read().count() == 2


def test_parts_replaced_as_a_whole_are_not_read_for_what_is_left(spark, table, monkeypatch):
    table.upsert(frame(spark, *[record(id=i) for i in "abc"]))
    table.upsert(frame(spark, *[record(id=i) for i in "def"]))
    folders = lambda: sorted(p.name for p in Path(table.path, "parts").iterdir())
    before = folders()
    table.upsert(frame(spark, *[record(id=i, raw_text="new") for i in "abcdef"]))
    assert len(folders()) == len(before) + 1 and len(table.current().parts) == 1
    table.upsert(frame(spark, record(id="b", raw_text="newer")))
    # One part is left in place of the replaced one, besides the new one.
    assert len(table.current().parts) == 2
    assert sorted((r["id"], r["raw_text"]) for r in table.read().collect()) == [(i, "newer" if i == "b" else "new") for i in "abcdef"]
