"""Different texts under one id, and texts with many spans."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linewright.llm import pii, pipeline, toxicity
from linewright.llm.line_dedup import dedup_lines, version
from linewright.llm.near_dedup import near_duplicates

SAME = "a b\nc d\ne f"
OWN = "unique one\nunique two\nunique three"


def pairs(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_line_dedup_keeps_the_other_text_of_an_id(spark):
    frame = spark.createDataFrame([(1, SAME), (2, SAME), (2, OWN)], "doc_id bigint, text string")
    got = pairs(dedup_lines(frame).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == [(1, SAME, 3, 0), (2, "", 3, 3), (2, OWN, 3, 0)]


def brute_lines(rows, hashes):
    """Windows of three lines over documents in order of (id, hash of the text); copies of a row are one document."""
    documents = sorted({(i, hashes[t], t) for i, t in rows if i is not None and t is not None})
    seen, gone = set(), defaultdict(set)
    for i, _, text in documents:
        lines = [(k, line.strip(" \t\n\x0b\x0c\r")) for k, line in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[1]]
        for start in range(max(len(lines) - 3, 0) + 1 if lines else 0):
            window = tuple(line for _, line in lines[start : start + 3])
            if window in seen:
                gone[i, text].update(k for k, _ in lines[start : start + 3])
            seen.add(window)
    out = []
    for i, text in rows:
        lost = gone.get((i, text), set()) if text is not None else set()
        lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")]
        left = text if not lost else "" if len(lost) == len(lines) else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost)
        out.append((i, left, len(lines), len(lost)))
    return pairs(out)


def test_line_dedup_of_differing_texts_per_id(spark):
    rng = random.Random(8)
    pool = [f"line {k}" for k in range(12)] + ["", "  "]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "\n".join(rng.choices(pool, k=rng.randrange(0, 9)))])) for _ in range(120)]
    rows += rows[:15]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = {r["text"]: r["h"] for r in frame.where("text is not null").select("text", version(F.col("text")).alias("h")).collect()}
    got = pairs(dedup_lines(frame).select("doc_id", "text", "n_lines", "n_removed").collect())
    assert got == brute_lines(rows, hashes)


def test_near_dedup_ties_the_rows_of_an_id(spark):
    first, second = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(2, first), (5, first), (5, second), (9, second), (9, None), (12, None), (12, "lone words here")]
    got = pairs(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "component_id", "kept").collect())
    assert got == pairs([(2, 2, True), (5, 2, False), (5, 2, False), (9, 2, False), (9, 2, False), (12, 12, True), (12, 12, True)])


def test_one_text_of_an_id_stays_the_same_on_each_run(spark, docs):
    rows = [(1, f"text number {k} of one id with words of its own {k * 7}", "a") for k in range(20)] + [(1, "text number 3 of one id with words of its own 21", "a")]
    kept = [pairs(pipeline.one_of_each_group(spark, docs(rows).repartition(n), "").collect()) for n in (1, 3, 7)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] == kept[2]


def brute_resolved(spans):
    extra = len(pii.BASE_KINDS)
    secret = pii.KINDS.index("secret")

    def meets(s, b):
        return b["kind"] < s["kind"] and (b["base"] or b["kind"] == secret) and b["start"] < s["end"] and s["start"] < b["end"]

    return [s for s in spans if s["kind"] < extra or not any(meets(s, b) for b in spans)]


@pytest.mark.parametrize("size", [2, 64])
def test_spans_give_way_as_by_comparing_all(spark, monkeypatch, size):
    monkeypatch.setattr(pii, "_BLOCK", size)
    rng = random.Random(size)
    parts = ["ab12cd34ef56gh78ij90", "password=ab12cd34ef56gh78ij90", "4111 1111 1111 1111", "x1y2z3a4b5c6d7e8f9@mail.example.com", "pwd: hunter22", "+49 30 1234567 890", "10.0.0.1", "words"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 80))) for _ in range(30)] + [None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.candidates(frame).collect()}
    text = F.coalesce(F.col("text"), F.lit(""))
    every = frame.select("doc_id", F.concat(*[pii._spans(text, kind) for kind in pii.KINDS]).alias("spans")).collect()
    assert found == {r["doc_id"]: brute_resolved(r["spans"]) for r in every}
    assert any(len(found[r["doc_id"]]) < len(r["spans"]) for r in every)


def test_evidence_in_sql_is_that_of_python(spark):
    rows = [(a, c) for a in range(0, 40, 3) for c in range(0, 40, 7) if a + c]
    frame = spark.createDataFrame(rows, "toxic bigint, clean bigint")
    for base in (0.1, 0.5, 0.93):
        for a, c, e in frame.select("toxic", "clean", toxicity._evidence(base).alias("e")).collect():
            expected = toxicity.evidence(a, c, base) if a else 0.0
            assert (e or 0.0) == pytest.approx(expected, abs=1e-9)


def test_copies_do_not_crowd_the_lexicon(spark):
    """A group of copies of one toxic text counts once, so its ordinary words are no insults."""
    rng = random.Random(3)
    words = [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    hot = " ".join(words[:200]) + " you grumblefink"
    texts = [(i, hot, 1) for i in range(100)]
    texts += [(100 + i, " ".join(rng.choices(words, k=30)) + " grumblefink", 1) for i in range(60)]
    texts += [(200 + i, " ".join(rng.choices(words, k=30)), 0) for i in range(200)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id bigint, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((scores[i] >= 0.5) == bool(t) for i, _, t in texts)
