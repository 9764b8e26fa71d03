import random
import sys

import numpy as np
import pytest
from samples import odd_texts, prose

from linewright.llm import near_dedup
from linewright.llm.components import components
from linewright.llm.fingerprints import shingle_set, word_hashes
from linewright.llm.near_dedup import near_duplicates, shared_counts
from linewright.staging import stage, tasks_for


def brute(rows, width, percent=80):
    """Component per id by comparing all pairs of shingle sets made in plain Python."""
    sets = {}
    for doc_id, text, *_ in rows:
        words = [w for w in (text or "").encode().lower().split()]
        runs = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(runs)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (root(i), {len(s) for s in sets[i]}) for i in ids}


def edited(text, seed, share):
    rng = random.Random(seed)
    return " ".join(f"new{seed}{rng.random()}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(docs, width):
    rows = list(odd_texts())
    for i in range(60):
        rows.append((100 + i, edited(prose(i % 9, 90 + i % 3), i, 0.01 * (i % 8)), "s"))
    rows += [(200 + i, t, "s") for i, t in enumerate(["A b", "a B", "a b c", "b a", "Éa b", "éa b"])]
    out = near_duplicates(docs(rows), width=width).collect()
    assert len(out) == len(rows)
    expected = brute(rows, width)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            component, sizes = expected[r["doc_id"]]
            assert (r["component_id"], r["kept"]) == (component, r["doc_id"] == component)
            assert r["n_shingles"] in sizes


def test_groups_wider_than_a_block(docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    base = prose(5, 60)
    rows = [(i, edited(base, i, 0.03 + 0.01 * (i % 5)), "s") for i in range(80)]
    out = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(rows), width=2).collect()}
    assert out == {i: c for i, (c, _) in brute(rows, 2).items()}


def test_empty_table(docs):
    assert near_duplicates(docs([])).collect() == []


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (1, 5, 100, 300, 350, 2, 0, 80)]
    assert (shared_counts(sets[:5], sets) == [[len(set(a) & set(b)) for b in sets] for a in sets[:5]]).all()


def test_hashes_tell_words_apart():
    hashes, bounds = word_hashes([b"ab c", b"", b"  ab\x0bab\xc3\xa9 c ", b"c"])
    assert bounds.tolist() == [0, 2, 2, 5, 6]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[4] == hashes[5] and hashes[3] != hashes[2]
    assert len(shingle_set(hashes[:1], 2)) == 1 and len(shingle_set(hashes[:0], 2)) == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (2, 1), (1, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for link in links for x in link}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert got == {x: root(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}


def test_texts_that_share_an_id_are_all_compared():
    import pyarrow as pa

    a, b, c = (np.arange(k, k + 50, dtype=np.uint64).tobytes() for k in (0, 100, 200))
    rows = [(1, a), (5, a), (5, b), (5, c), (9, b), (12, c)]
    for order in (rows, rows[::-1]):
        columns = [pa.array([0] * 6), pa.array([i for i, _ in order]), pa.array([True] * 6), pa.array([x for _, x in order], pa.binary())]
        batch = pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "is_query", "shingles"])
        found = {(x["a"], x["b"]) for out in near_dedup._compare(80)(iter([batch])) for x in out.to_pylist()}
        assert found == {(5, 1), (9, 5), (12, 5)}


def test_few_links_are_written_by_few_tasks_and_stars_end_at_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sys.modules["linewright.llm.components"], "stage", lambda df, name, *tasks: (frame := stage(df, name, *tasks), written.append((name, len(frame.inputFiles()))))[0])
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        links = spark.createDataFrame([(a, a - a % 50) for a in range(1000)], "a bigint, b bigint")
        found = {r["node"]: r["component"] for r in components(links, 1000).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {a: a - a % 50 for a in range(1000)}
    assert [n for n, _ in written] == ["links", "least", "star"]
    assert max(n for _, n in written) <= tasks_for(spark, 1000)
