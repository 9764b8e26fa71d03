"""The pipeline on small tables, and the registered queries."""

import pytest
from samples import odd_texts, prose

import __spark_entry__ as contract
import corpus_pipeline
from linewright.llm import queries
from linewright.llm.near_dedup import near_duplicates

NAMES = ["quality_classifier", "line_dedup", "near_dedup", "mixing", "bpe"]


def write(spark, folder, docs):
    labels = [(1000 + i, int(i % 3 > 0), 0) for i in range(300)]
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows():
    out = odd_texts()
    for i in range(300):
        text = prose(i, 80) if i % 3 else " ".join(f"{w}***" for w in prose(i, 80).split())
        out.append((1000 + i, text.replace(" ", "\n", 3), "ab"[i % 2]))
    out += [(2000 + i, prose(1, 80).replace(" ", "\n", 3), "c") for i in range(3)]
    out += [(3000, prose(400, 200), "c"), (3001, prose(400, 200).replace(" ", " x ", 1), "c")]
    return out


def test_stages(spark, docs, tmp_path):
    folder = write(spark, tmp_path, docs(rows()))
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = now.columns, {}
    for name, apply in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        apply(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != "bpe":
            assert now.columns == columns
    good = {1000 + i for i in range(300) if i % 3}
    left = {name: {r["doc_id"] for r in found} for name, found in seen.items()}
    assert len(good - left["quality_classifier"]) == 0 and len({1000 + 3 * i for i in range(100)} & left["quality_classifier"]) <= 2
    # Later copies lose all lines and go; the first of them stays.
    assert left["line_dedup"] & {1001, 2000, 2001, 2002} == {1001} | (left["line_dedup"] & {2000} if 1001 not in left["line_dedup"] else set())
    assert left["near_dedup"] & {3000, 3001} == {3000}
    groups = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.read.parquet(str(tmp_path / "line_dedup")), width=5).collect()}
    assert left["near_dedup"] - {None} == set(groups.values()) - {None}
    assert left["mixing"] <= left["near_dedup"] and all(r["round_trip"] for r in seen["bpe"])
    assert len(seen["bpe"]) == len(seen["mixing"])
    final = corpus_pipeline.run(spark, folder)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in final.collect()) == sorted((str(r["doc_id"]), r["n_tokens"]) for r in seen["bpe"])


def test_empty_table(spark, docs, tmp_path):
    folder = write(spark, tmp_path, docs([]))
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_registered_queries():
    names = contract.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    import os

    import duckdb

    folder = contract.SMOKE_DIR
    if not os.path.isdir(folder):
        pytest.skip("test tables not present")
    database = duckdb.connect()
    for file in os.listdir(folder):
        database.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    cursor = database.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    found = contract.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))
