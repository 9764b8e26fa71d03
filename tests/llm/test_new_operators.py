"""Prefix tries, collocations and near-duplicate vectors against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linewright.llm import collocations as colloc, embedding_dedup as emb, prefix_trie as trie
from linewright.llm.cells import counted, table_size


# --- prefix tries ---------------------------------------------------------------------------------


def rebuilt(rows):
    """Rebuilt conversations as lists of (role, text), for rows whose turns are distinct."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    return out


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(convs[c]) == len(path))
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(all(len(convs[c]) == len(p) for c in nodes[p]) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), up, len(members), len(children), leaves, saved, digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def spark_trie(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string, k1 int, size int")
    found = trie.prefix_trie(frame)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def conversations(seed, n, texts):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rng.random() < 0.8:
            start = rng.choice([None, 0, 3])
            for i in range(rng.randrange(1, 12)):
                rows.append((c, start if i == 0 else 10 + i, rng.choice(["user", "user", None]), rng.choice(texts)))
    return rows


def test_trie_of_random_conversations(spark):
    rows = conversations(4, 60, ["a", "b", "é", "", None]) + [(None, 1, "user", "lost")]
    assert spark_trie(spark, rows) == brute_trie(rebuilt(rows))


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    """Groups of equal conversations, pieces of few turns, and a screening table in which all prefixes clash."""
    rows = [(c, t, "user", f"t{t}" if t < 40 else f"own {c % 3}") for c in range(5, 40) for t in range(45)]
    rows += [(100, t, "user", "x" * 20000) for t in range(30)]
    expected = brute_trie(rebuilt(rows))
    assert spark_trie(spark, rows) == expected
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    monkeypatch.setattr(trie, "LEAST_CELLS", trie.PROBES)
    monkeypatch.setattr(trie, "MOST_CELLS", trie.PROBES)
    assert spark_trie(spark, rows) == expected


def test_trie_of_repeated_rows_and_nothing(spark):
    assert spark_trie(spark, []) == []
    # Turns of equal number go by role and hash, the same in each conversation; repeated rows all count.
    rows = [(c, 1, "user", t) for c in (10, 20) for t in ("p", "q", "q", None)]
    nodes = spark_trie(spark, rows)
    assert max(n[1] for n in nodes) == max(len(x) for x in rebuilt(rows).values())
    assert {n[3] for n in nodes if n[1] == 0} == {2}


def test_tails_are_proven_where_they_stand(spark, monkeypatch):
    """Only prefixes that the table cannot prove to be single reach the grouping."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(0, 500, 5) for t in range(9, 15)]
    convs, turns = trie.rebuilt_turns(trie.placed_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    states = Counter(r["state"] for r in trie.screened(trie.prefixes(turns)).collect())
    assert states[2] <= 0.02 * sum(states.values()) and states[1] <= 100


def test_counters(spark):
    frame = spark.createDataFrame([(i % 700,) for i in range(2100)] + [(5000,)], "cell bigint").repartition(3)
    many = counted(frame, lambda b: b["cell"].to_numpy(), 1 << 15, 2)
    assert set(np.flatnonzero(many == 2)) == set(range(700)) and list(np.flatnonzero(many == 1)) == [5000]
    bits = np.unpackbits(counted(frame, lambda b: b["cell"].to_numpy(), 1 << 15, 1))
    assert set(np.flatnonzero(bits)) == {*range(700), 5000}
    assert (table_size(0, 8, 16, 64), table_size(5, 8, 16, 64), table_size(10**9, 8, 16, 64)) == (16, 64, 64)


# --- collocations ---------------------------------------------------------------------------------


def brute_collocations(rows, report):
    out = []
    by_lang = defaultdict(list)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        by_lang["und" if lang is None else lang].extend(re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low))
    for lang, parts in by_lang.items():
        f = Counter(tuple(w[i : i + k]) for w in parts for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(map(len, parts))
        kept = []
        for p, a in f.items():
            if len(p) == 1 or a < 10:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= 10 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:report], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def spark_collocations(spark, rows, *limits):
    frame = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string").repartition(4)
    found = colloc.collocations(frame, *limits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def phrases(seed, n):
    rng = random.Random(seed)
    words = ["The", "river", "of", "Äpfel", "stone", "ÀB", "x", "a.b", "new", "york", "city\x1c", "tab\tbed", "two  gaps"]
    weights = [8, 4, 6, 2, 3, 1, 2, 1, 3, 3, 2, 1, 1]
    return [(" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


ODD = [(None, "en"), ("", None), (" \t\n ", "fr"), ("word", "fr"), (". , ;", "en"), ("same same same " * 40, "es"), ("long ago " * 30000 + "end", "en")]


@pytest.mark.parametrize("limits", [(2000, 4000), (5, 1), (40, 3)])
def test_collocations(spark, limits):
    """With few pairs opened at first, several rounds are needed and give the same."""
    rows = phrases(1, 300) + ODD
    assert spark_collocations(spark, rows, *limits) == brute_collocations(rows, limits[0])


def test_collocations_with_a_full_table_of_bits(spark, monkeypatch):
    monkeypatch.setattr(colloc, "LEAST_BITS", 1 << 3)
    monkeypatch.setattr(colloc, "MOST_BITS", 1 << 3)
    monkeypatch.setattr(colloc, "HELD", 7)
    rows = phrases(2, 150)
    assert spark_collocations(spark, rows, 50, 10) == brute_collocations(rows, 50)


def test_collocations_of_nothing(spark):
    assert spark_collocations(spark, []) == []
    assert spark_collocations(spark, [("a b", "en"), (None, None)]) == []


def test_scores_beyond_64_bits(spark):
    huge = spark.createDataFrame([(3 * 10**12, 4 * 10**12, 5 * 10**12), (9007199254740993, 9007199254740993, 9007199254740994)], "a bigint, l bigint, r bigint")
    assert [r[0] for r in huge.select(colloc._score("a", "l", "r")).collect()] == [450000, 10**6 * 9007199254740993 // 9007199254740994]


def test_long_pieces_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(colloc, "CHUNK_BYTES", 10)
    text = b"One two three. four five,six\nseven" * 5
    words = [w for part in colloc.chunks([text, text]) for w in colloc.Words(part).phrases(np.arange(len(colloc.Words(part).starts)), 1)]
    assert words == re.findall(rb"[^ .,\n]+", (text + b"\n" + text).lower())


# --- near-duplicate vectors ------------------------------------------------------------------------


def brute_vectors(rows):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        u, v = rows[i][1], rows[j][1]
        if i == j or rows[i][0] is None or rows[j][0] is None or not fine(u) or not fine(v) or len(u) != len(v):
            return False
        u, v = (np.array(x) / np.abs(x).max() for x in (u, v))
        return u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.9

    links = [[j for j in range(len(rows)) if linked(i, j)] for i in range(len(rows))]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, js in enumerate(links):
        for j in js:
            a, b = sorted((root(rows[i][0]), root(rows[j][0])))
            parent[b] = a
    out = []
    for i, (vec, _) in enumerate(rows):
        component = None if vec is None else root(vec)
        out.append((vec, len(links[i]), component, vec is None or vec == component))
    return sorted(out, key=str)


def spark_vectors(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, first string, n_links int").repartition(3)
    found = emb.near_vectors(frame)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(seed, dims, groups):
    """Groups around random directions; (members, cosine with the direction)."""
    rng = np.random.default_rng(seed)
    rows = []
    for size, cosine in groups:
        u = rng.standard_normal(dims)
        u /= np.linalg.norm(u)
        for _ in range(size):
            w = rng.standard_normal(dims)
            w -= (w @ u) * u
            w /= np.linalg.norm(w)
            rows.append((cosine * u + math.sqrt(1 - cosine**2) * w) * rng.uniform(0.1, 9))
    rng.shuffle(rows)
    return [(i + 1, [float(x) for x in v]) for i, v in enumerate(rows)]


ODD_VECTORS = [
    (900, None), (901, []), (902, [0.0] * 16), (903, [1.0] * 15 + [None]), (904, [1.0] * 15 + [float("nan")]), (905, [1.0] * 15 + [float("inf")]),
    (906, [1.0] * 16), (907, [1.0] * 16), (907, [1.0] * 16), (908, [1e300] * 16), (909, [1e-310] * 16), (910, [-1.0] * 16), (911, [1.0] * 8), (None, [1.0] * 16),
    (None, None), (912, [2.0] * 8), (913, [5.0]), (914, [-5.0]), (915, [7.0]),
    # One id with two vectors ties two groups; a row that links with nothing shares the place of its id.
    (906, [1.0] * 8 + [-1.0] * 8), (950, [1.0] * 8 + [-1.0] * 8), (950, None),
]


@pytest.mark.parametrize(("dims", "near"), [(16, 0.95), (64, 0.95), (100, 0.965)])
def test_near_vectors(spark, dims, near):
    """Groups whose pairs lie on both sides of the threshold; bands may leave out one pair of a thousand there, none on these rows."""
    rows = vectors(dims, dims, [(40, 0.99), (30, 0.97), (30, near), (1, 1.0), (1, 1.0)] + [(2, 0.97)] * 10 + [(1, 1.0)] * 30)
    rows += [(r[0] + 300, r[1]) for r in rows[:20]] + ODD_VECTORS
    assert spark_vectors(spark, rows) == brute_vectors(rows)


def test_near_vectors_in_small_blocks_with_a_full_table(spark, monkeypatch):
    monkeypatch.setattr(emb, "BLOCK_ROWS", 7)
    monkeypatch.setattr(emb, "LEAST_CELLS", 4)
    monkeypatch.setattr(emb, "MOST_CELLS", 4)
    rows = vectors(5, 32, [(60, 0.955), (40, 0.999), (20, 0.9)])
    assert spark_vectors(spark, rows) == brute_vectors(rows)


def test_near_vectors_of_nothing(spark):
    assert spark_vectors(spark, []) == []
    assert spark_vectors(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_estimates_are_unbiased_and_bounded():
    """Over many rotations: the mean estimate is the cosine, and no pair at the threshold falls short by more than `reach`."""
    rng = np.random.default_rng(1)
    units = emb.unit_vectors(rng.standard_normal((3000, 64)))
    turn = rng.standard_normal((3000, 64))
    turn -= (turn * units).sum(1, keepdims=True) * units
    others = 0.9 * units + math.sqrt(0.19) * emb.unit_vectors(turn)
    codes, factors = emb.encode(others)
    found = np.array([emb.estimates(units[i : i + 1], codes[i : i + 1], factors[i : i + 1])[0, 0] for i in range(3000)])
    assert abs(found.mean() - 0.9) < 0.002
    assert (found + emb.reach(factors, 256, 0.9) >= 0.9).all()
    # The bound follows the spread: six deviations are not twelve.
    assert 4 < (emb.reach(factors, 256, 0.9).mean() / found.std()) < 9


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    units = emb.unit_vectors(rng.standard_normal((2000, 64)))
    turn = rng.standard_normal((2000, 64))
    turn -= (turn * units).sum(1, keepdims=True) * units
    others = 0.9 * units + math.sqrt(0.19) * emb.unit_vectors(turn)
    plan = emb.plan_bands(100_000, 64)
    met = (emb.band_keys(units, *plan) == emb.band_keys(others, *plan)).any(1)
    assert met.mean() > 0.995
