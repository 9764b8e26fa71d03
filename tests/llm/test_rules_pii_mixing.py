"""The operators that are built from columns alone."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import odd_texts, prose

from linewright.llm import mixing, pii
from linewright.llm.line_dedup import dedup_lines
from linewright.llm.quality_rules import clean_lines

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_base_counts_and_verdict(docs):
    rng = random.Random(3)
    rows = odd_texts() + [(100 + i, " ".join(rng.choice(["a", "b", "é😀", "c|", "d\n", " "]) for _ in range(rng.randint(0, 60))), "s") for i in range(60)]
    rows += [(300, prose(8, 100), "s"), (301, " ".join(f"{w}***" for w in prose(9, 100).split()), "s"), (302, " | ".join(prose(9, 100).split()), "s")]
    rows += [(303, prose(8, 100) + "\nAll rights reserved.\nHome | About us", "s")]
    out = clean_lines(docs(rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        expected = base_counts(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r["kept"] and r["base_failed"])
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[300]["kept"] and not by_id[301]["kept"] and not by_id[302]["kept"]
    assert by_id[303]["kept"] and by_id[303]["clean_text"] == prose(8, 100) and by_id[303]["n_failed_lines"] == 2
    assert clean_lines(docs([])).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                yield kind, m.start(), m.end()


def test_pii_base_spans(docs):
    rng = random.Random(6)
    pieces = ["a@b.c", "_d@e.f", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+12", "x", " ", "😀", ".", "-", "0001.2.3.255",
              "token = \"9c2d4f10ab66e7d8c1b2a39f\"", "password=ab12cd34", "@", "+", "7", "\n", "user.name+tag@mail-1.example.co.uk"]
    rows = odd_texts() + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))), "s") for i in range(150)]
    rows += [(500, "9" * 30000, "s"), (501, "a" * 40000 + "@", "s"), (502, " ".join(["10.0.0.1"] * 700), "s"), (503, "1 " * 20000, "s")]
    out = pii.find_pii(docs(rows)).collect()
    assert len(out) == len(rows)
    texts = Counter((i, t) for i, t, _ in rows)
    for r in out:
        mine = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert any(mine == list(base_spans(t or "")) for (i, t) in texts if i == r["doc_id"])
        places = [(pii.KINDS.index(s["kind"]), s["start"]) for s in r["spans"]]
        assert places == sorted(places)
    added = {s["kind"] for r in out for s in r["spans"] if not s["base"]}
    assert added <= {"secret", "password"} and "secret" in added
    assert pii.find_pii(docs([])).collect() == []


def test_em_prefers_agreeing_labelers():
    patterns = [((1, 1, 1), 50.0), ((1, 1, 0), 100.0), ((-1, -1, 0), 80.0), ((1, -1, 0), 10.0), ((-1, 1, 0), 5.0)]
    posterior, rates, prior = pii.estimate(patterns)
    assert posterior[1, 1, 1] > 0.95 > 0.2 > posterior[-1, -1, 0] and 0.4 < prior < 0.8
    weights = pii.fit([((1, 1, 1, 0, 1, 0), 50.0, 0.99), ((-1, -1, 0, 0, 1, 2), 50.0, 0.01)])
    assert weights["regex", 1] > 0 > weights["regex", -1]


def lines_of(text):
    return [(n, x.strip(SPACES)) for n, x in enumerate(text.split("\n")) if x.strip(SPACES)]


def deduped(rows):
    seen, out = {}, {}
    for doc_id, text in sorted({(i, t) for i, t, _ in rows if i is not None and t is not None}):
        lines = lines_of(text)
        starts = range(max(1, len(lines) - 2)) if lines else []
        gone = set()
        for k in starts:
            key = tuple(x for _, x in lines[k : k + 3])
            if key in seen:
                gone |= {n for n, _ in lines[k : k + 3]}
            seen.setdefault(key, (doc_id, k))
        kept = [x for n, x in enumerate(text.split("\n")) if n not in gone]
        out[doc_id] = ("" if gone and len(gone) == len(lines) else "\n".join(kept)) if gone else text, len(gone)
    return out


def test_line_dedup(docs):
    rng = random.Random(2)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", "line 1 "]
    rows = [r for r in odd_texts() if r[0] != 8] + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))), "s") for i in range(60)]
    rows += [(400, "q\nq\nq\nq\nq", "s"), (401, "p1\np2\np3\np1\np2\np3\nend", "s")]
    out = dedup_lines(docs(rows)).collect()
    assert len(out) == len(rows)
    expected = deduped(rows)
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] in expected:
            assert (r["text"], r["n_removed"]) == expected[r["doc_id"]]
        else:
            assert r["n_removed"] == 0
    assert {r["starts"] for r in out} == {1}  # a column of the caller, left alone
    assert dedup_lines(docs([])).collect() == []


def test_line_dedup_of_long_lines(docs):
    long, left, right = prose(70, 51), prose(71, 30), prose(72, 30)
    rows = [(1, f"{long}\nfirst end", "s"), (2, f"a\n\n{long} \nb\nc\nd", "s"), (3, long, "s"), (4, f"e\n{left}\n{right}", "s")]
    rows += [(5, f"f\ng\n{left}\n{right}\nh", "s"), (6, f"{left}\n{right}", "s"), (7, f"i\n{left}\nj\nfirst end", "s"), (8, f"{prose(73, 50)}\nk", "s")]
    rows += [(9, f"l\n{prose(73, 50)}\nm\nn", "s")]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(docs(rows), 50).collect()}
    texts = {i: t for i, t, _ in rows}
    assert out[2] == ("a\n\nb\nc\nd", 5, 1) and out[3] == ("", 1, 1)
    assert out[5] == ("f\ng\nh", 5, 2) and out[6] == ("", 2, 2)
    # First occurrences, single lines of 30 words and lines of just 50 words stay.
    assert all(out[i][0] == texts[i] and out[i][2] == 0 for i in (1, 4, 7, 8, 9))


def filled(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    target, open_, left = {}, dict(weights), share * sum(sizes.values())
    while open_:
        total = sum(open_.values())
        over = [s for s in open_ if left * open_[s] / total >= cap * sizes[s]]
        if not over:
            return target | {s: left * w / total for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
            del open_[s]
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(docs, seed):
    rng = random.Random(seed)
    rows = odd_texts() + [(1000 + i, prose(i, rng.randint(1, 80)), rng.choice(["a", "b", "é", "Z", None])) for i in range(400)]
    out = mixing.mix(docs(rows)).collect()
    assert len(out) == len(rows)
    sizes, taken, targets, longest = Counter(), Counter(), {}, Counter()
    for r in out:
        s = r["source"]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    expected = filled(sizes, weights, 1.5, 2)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s]) and abs(taken[s] - targets[s]) <= longest[s]
    again = {(r["doc_id"], r["size"], tuple(r["positions"])) for r in mixing.mix(docs(rows[::-1])).collect()}
    assert again == {(r["doc_id"], r["size"], tuple(r["positions"])) for r in out}
    assert mixing.mix(docs([])).collect() == []
    ordered = mixing.training_order(docs(rows).where("doc_id >= 1000"), mixing.mix(docs(rows).where("doc_id >= 1000")))
    assert Counter(r["doc_id"] for r in ordered.collect()) == Counter(
        {r["doc_id"]: r["copies"] for r in mixing.mix(docs(rows).where("doc_id >= 1000")).collect() if r["copies"]}
    )


def test_positions_follow_the_schedule(spark):
    grid = spark.range(101).select((F.col("id") / 100).alias("f"))
    for a, b in [(1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (0.0, 2.0)]:
        for r in grid.select("f", mixing._position(F.col("f"), F.lit(a), F.lit(b)).alias("t")).collect():
            assert (a * r["t"] + (b - a) * r["t"] ** 2 / 2) / ((a + b) / 2) == pytest.approx(r["f"], abs=1e-9)


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
