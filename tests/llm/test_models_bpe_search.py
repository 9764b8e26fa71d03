"""Trained models on held-out rows, exact round trips, and search against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import odd_texts, prose

from linewright.llm import bpe, lm_scoring, quality_classifier, topk, toxicity
from linewright.llm.folds import held_out, labelled_sample
from linewright.llm.tokens import token_ids

public_tokenizers = pytest.importorskip("public_tokenizers")


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def junk(seed, n):
    return " ".join(f"{w}***" for w in prose(seed, n).split())


@pytest.fixture(scope="module")
def corpus():
    """Good and junk, clean and toxic texts with labels; words of one stem are toxic."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good, toxic = i % 3 > 0, i % 4 == 0
        text = prose(i, 80) if good else junk(i, 80)
        if toxic:
            words = text.split()
            words.insert(rng.randrange(80), rng.choice(["stupid", "1d10t", "zorbla", "zorblin", "zorbek", "zorbum"]))
            text = " ".join(words)
        rows.append((1000 + i, text, "s"))
        labels.append((1000 + i, int(good), int(toxic)))
    return rows, labels


def auc(scored, wanted):
    pairs = [(s, wanted[i]) for i, s in scored if i in wanted]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("score, place", [(quality_classifier.score_quality, 1), (toxicity.score_toxicity, 2)])
def test_classifiers(spark, docs, corpus, score, place):
    rows, labels = corpus
    out = score(docs(rows + odd_texts()), labelled(spark, labels)).collect()
    assert len(out) == len(rows) + len(odd_texts())
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    wanted = {row[0]: row[place] for row in labels}
    held = [(r["doc_id"], r["score"]) for r in out if r["held_out"]]
    assert auc(held, wanted) > 0.97
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3, 4)}) == 1


@pytest.mark.parametrize("score", [quality_classifier.score_quality, toxicity.score_toxicity])
def test_classifiers_without_labels_or_rows(spark, docs, odd, score):
    none = labelled(spark, [(1, None, None), (None, 1, 1), (2, 7, 7)])
    assert len(score(odd, none).collect()) == len(odd_texts())
    assert score(docs([]), none).collect() == []
    one_class = labelled(spark, [(1, 1, 1), (7, 1, 1)])
    assert len(score(odd, one_class).collect()) == len(odd_texts())


def test_samples_are_bounded_and_leave_the_fold_out(spark):
    rows = [(i, i % 2, 0) for i in range(200)] + [(5, 0, 0), (6, 1, 0)]
    sample, counts = labelled_sample(labelled(spark, rows), "quality", 20)
    got = sample.withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(got) == 40 and not any(r["held"] for r in got) and not {5, 6} & {r["doc_id"] for r in got}
    assert sum(counts.values()) < 200


def test_toxic_matching():
    matcher = toxicity.Matcher([("stupid$", 2.0), ("zorb", 1.0)], ["stupid simple"])
    found = {t: matcher.total(toxicity.fold(t))[1] for t in ["Stupid", "ѕtup1d!", "stupidly", "zorbing zorb", "unzorb", "stupid simple, stupid", "", "ｓtupid"]}
    assert found == {"Stupid": 1, "ѕtup1d!": 1, "stupidly": 0, "zorbing zorb": 2, "unzorb": 0, "stupid simple, stupid": 1, "": 0, "ｓtupid": 1}
    assert toxicity.Matcher([], []).total("x") == (0.0, 0)
    assert toxicity.measures(matcher, None) == (0.0, 0.0, 0)
    weights = toxicity.choose([("zorb", 40, 0), ("zorbl", 12, 0), ("the$", 50, 300), ("trash$", 1, 30)], 50, 300, 1000)
    assert "zorb" in weights and "the$" not in weights and toxicity._skeleton_end("trash") not in weights


def test_word_vectors_against_plain_counting():
    texts = [b"the cat sat on the mat", b"", b"a cat ** 12"]
    sums = quality_classifier.context_sums(iter([texts])).reshape(quality_classifier.BUCKETS, -1)
    index = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMS))
    for e in range(quality_classifier._ENTRIES):
        np.add.at(index, (np.arange(len(index)), quality_classifier._INDEX_DIMS[:, e]), quality_classifier._INDEX_SIGNS[:, e])
    expected = np.zeros_like(sums)
    for text in texts:
        ids = token_ids([text], quality_classifier.BUCKETS)[0]
        for i, word in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                expected[word] += index[ids[j]] if i != j else 0
    assert np.allclose(sums, expected)


def test_lm_scores_match_a_plain_sum(spark, docs):
    rows = odd_texts() + [(50 + i, prose(i, 60), "s") for i in range(40)]
    out = lm_scoring.score_documents(docs(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["n_tokens"] == 0:
            assert r["log_likelihood"] == 0 and r["mean_log_likelihood"] is None
        else:
            assert r["log_likelihood"] < 0
    assert lm_scoring.score_documents(docs([])).collect() == []
    counts = lm_scoring.bucket_counts(iter([[t.encode() for _, t, _ in rows if t]]))
    vocabulary = lm_scoring.Vocabulary(counts)
    p = lm_scoring.initial(vocabulary)
    text = b"the a of the river"
    ids = token_ids([text], lm_scoring.BUCKETS)[0]
    total = 0.0
    for i, token in enumerate(ids):
        hidden = p["bias"].astype(float)
        for k, step in enumerate(lm_scoring.OFFSETS):
            seen = vocabulary.inputs[ids[i + step]] if 0 <= i + step < len(ids) else 0
            hidden = hidden + p["embed"][seen].astype(float) @ p["mix"][k]
        logits = np.tanh(hidden) @ p["out"] + p["level"]
        own = vocabulary.classes[token]
        total += logits[own] - math.log(np.exp(logits).sum()) + vocabulary.log_share[token]
    n, scored = lm_scoring.Scorer(p, vocabulary).score([text, b""])
    assert n.tolist() == [5, 0] and scored[0] == pytest.approx(total, rel=1e-4) and scored[1] == 0
    shares = np.exp(vocabulary.log_share)
    assert np.allclose(np.bincount(vocabulary.classes, shares), 1)


def test_training_lowers_the_loss():
    texts = [("one two three four five " * 40).encode()] * 4
    vocabulary = lm_scoring.Vocabulary(lm_scoring.bucket_counts(iter([texts])))
    start = lm_scoring.flat(lm_scoring.initial(vocabulary))
    mixed = lm_scoring.trained(start, vocabulary, stride=1)(iter([texts] * 5))
    after = lm_scoring.shaped(mixed[:-1] / mixed[-1])
    before = lm_scoring.Scorer(lm_scoring.shaped(start), vocabulary).score(texts)[1].sum()
    assert lm_scoring.Scorer(after, vocabulary).score(texts)[1].sum() > before * 0.5


def test_every_token_is_a_target(monkeypatch):
    groups = [[b"one two three", b"", b"four"], [b"five six " * 300]]
    counts = lm_scoring.bucket_counts(iter(groups))
    vocabulary = lm_scoring.Vocabulary(counts)
    targets = []
    monkeypatch.setattr(lm_scoring, "_train_batch", lambda p, context, target, rate: targets.extend(target))
    mixed = lm_scoring.trained(lm_scoring.flat(lm_scoring.initial(vocabulary)), vocabulary)(iter(groups))
    expected = np.bincount(vocabulary.classes, counts, lm_scoring.CLASSES)
    assert mixed[-1] == 604 and np.bincount(targets, minlength=lm_scoring.CLASSES).tolist() == expected.tolist()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_encoding_and_decoding(spark, docs, library):
    rows = odd_texts() + [(700, "a<|endoftext|>b", "s"), (701, "ab" * 9000 + " " * 6000 + "1" * 5000 + "<|endoftext|>", "s"), (702, "日本 é😀\r\n\t's", "s")]
    out = bpe.decode(bpe.encode(docs(rows))).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs([]))).collect() == []


def test_tree_concatenation_is_exact(library):
    small = bpe.ByteBpe(bpe.default_path(), leaf=6, window=1)
    rng = random.Random(2)
    for pool in ("ab", "theanigo", "aeiou", "0123", "!?*#", "日本語é", " "):
        for _ in range(60):
            text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 150)))
            assert small.encode([text])[0] == library.encode(text, add_special_tokens=False).ids
    # Texts of ordinary words, cut at any place: contractions, runs of white space and special tokens across the seams.
    parts = bpe.ByteBpe(bpe.default_path(), part=7, window=1)
    for pool in ("ab c", "a 1'sl", "'ls dvret", "  \n\ta", "!? a1", "日 é1 '", "aé  1 \x1c\u3000x", "_ -a"):
        for _ in range(200):
            drawn = [rng.choice(["<|endoftext|>", "'ll", " ", " don't"]) if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 80))]
            assert parts.encode(["".join(drawn)])[0] == library.encode("".join(drawn), add_special_tokens=False).ids
    small.fast = None
    assert small.encode(["plain text"])[0] == library.encode("plain text", add_special_tokens=False).ids


def brute_search(vectors, k):
    good = [(i, v) for i, v in vectors if v is not None and i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in good]
    out = set()
    for q, w in ints:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ints if i != q and len(v) == len(w))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [8192, 50])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", blocks)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    rng = random.Random(blocks)
    rows = [(i, [rng.gauss(0, 1) if i % 7 else float(i % 3) for _ in range(8)]) for i in range(1, 501)]
    rows += [(501, None), (502, [None] * 8), (503, [math.nan] * 8), (504, [math.inf] * 8), (505, []), (506, [0.5, 0.5]), (600, [0.0] * 8), (None, [1.0] * 8), (700, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = table.select("vec_id", topk.integer_vectors(table, "embedding").alias("vector"))
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()
    assert {tuple(r) for r in got} == brute_search(rows, 10) and len(got) == len(brute_search(rows, 10))
    empty = vectors.where("vec_id < 0")
    assert topk.top_k(empty, empty, 10).collect() == []


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-9, 9, (3000, 16))
    vectors[:20] += 400
    index = topk.ImpactIndex(vectors)
    places, scores = index.search(np.full(16, 50), 10, np.zeros(3000, bool))
    assert len(places) < 3000
    best = np.sort(vectors @ np.full(16, 50))[::-1][:10]
    assert (np.sort(scores)[::-1][:10] == best).all()


def test_digest_columns(spark, docs, library):
    encoded = bpe.encode(docs([(1, "some text", "s")])).select(F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("h"))
    ids = library.encode("some text", add_special_tokens=False).ids
    assert encoded.first()["h"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_every_bucket_has_an_input_of_its_own():
    counts = np.bincount(np.random.default_rng(3).integers(0, lm_scoring.BUCKETS, 90_000), minlength=lm_scoring.BUCKETS).astype(float)
    vocabulary = lm_scoring.Vocabulary(counts)
    assert len(set(vocabulary.inputs.tolist())) == lm_scoring.BUCKETS and vocabulary.inputs.min() == 1
    assert vocabulary.inputs.max() < len(lm_scoring.initial(vocabulary)["embed"])
