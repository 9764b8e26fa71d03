"""Every registered query against its DuckDB counterpart on the smallest tables."""

import os
from decimal import Decimal

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
FOLDER = contract.SMOKE_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        return f"{float(v):.12g}" if isinstance(v, (float, Decimal)) else str(v)

    return [columns[i] for i in order], sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", list(contract.QUERIES))
def test_query(spark, database, name):
    df = contract.queries()[name](spark, FOLDER)
    cursor = database.execute(contract.oracle_sql()[name])
    expected = comparable([c[0] for c in cursor.description], cursor.fetchall())
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == expected
    assert expected[1]


def test_names_match():
    assert set(contract.ORACLE) == set(contract.QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 20


@pytest.fixture(scope="module")
def normalized_documents(spark):
    """Every stripped document line through Python's own engine: (file, number) -> (raw, normalized, hits per rule)."""
    import re

    from linewright.functions.rules import DEFAULT_RULES

    expected = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        for number, line in enumerate(re.split("\r\n|\r|\n", r["text"]), 1):
            raw = text = line.strip()
            hits = {}
            for rule in DEFAULT_RULES:
                text, n = re.subn(rule.pattern, rule.replacement, text)
                if n:
                    hits[rule.name] = n
            if raw:
                expected[f"/docs/{r['source']}-doc{r['doc_id']}.txt", number] = (raw, text, hits)
    return expected


def test_normalize_documents(spark, normalized_documents):
    import json

    rows = contract.queries()["normalize_documents"](spark, FOLDER).collect()
    got = {(r["file_path"], r["line_number"]): (r["normalized_text"], r["changed"], json.loads(r["replacement_counts"])) for r in rows}
    assert len(got) == len(rows)
    assert got == {k: (text, text != raw, hits) for k, (raw, text, hits) in normalized_documents.items()}


def signature(text):
    """Token signature in plain Python."""
    severities = {"DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL"}

    def one(token):
        bare = token.strip(",;")
        if bare.startswith("<") and bare.endswith(">"):
            return bare
        if bare.startswith("[") and bare.endswith("]"):
            return bare.lower()
        if bare.upper() in severities:
            return bare.upper()
        return "<VAR>" if any(c.isdigit() for c in bare) else bare.lower()

    return " ".join(map(one, text.split()))


def test_document_templates(spark, normalized_documents):
    rows = contract.queries()["document_templates"](spark, FOLDER).collect()
    expected = {}
    for place, (_, text, _) in normalized_documents.items():
        lines, first = expected.get(signature(text), (0, place))
        expected[signature(text)] = lines + 1, min(first, place)
    assert {r["template"]: (r["lines"], (r["first_file"], r["first_line"])) for r in rows} == expected
    assert len(rows) == len(expected)


def test_unicode_sql_agrees_with_python():
    """The SQL of document normalization on lines that mix scripts, digits and signs at every boundary."""
    import json
    import random
    import re

    import pandas as pd

    from linewright.functions.rules import DEFAULT_RULES

    pieces = ["é", "ß", "я", "Ñ", "٣", "²", "5", "12", "2.5", ".", "-", "+", "/", "//", "_", " ", " ", ":", "=", "a", "ms", " s"]
    pieces += ["0x1f", "abcdefghijkl", "10.0.0.1", "deadbeef-0000-1111-2222-333344445555"]
    rnd = random.Random(5)
    lines = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9))) for _ in range(5000)]
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame({"doc_id": range(len(lines)), "text": lines, "source": "s"}))
    expected = []
    for i, line in enumerate(lines):
        raw = text = line.strip()
        hits = {}
        for rule in DEFAULT_RULES:
            text, n = re.subn(rule.pattern, rule.replacement, text)
            if n:
                hits[rule.name] = n
        if raw:
            expected.append((f"/docs/s-doc{i}.txt", 1, text, text != raw, hits))
    found = connection.execute(contract.oracle_sql()["normalize_documents"]).fetchall()
    assert sorted(((*row[:4], json.loads(row[4])) for row in found), key=lambda row: row[0]) == sorted(expected, key=lambda row: row[0])
