"""Personal data in text by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Pass 1 reads every text once and keeps its candidate spans with three votes each: regex (does the form hold up),
gazetteer (a known domain, prefix, issuer, country code, key prefix), context (what stands before it). The number of vote patterns
is fixed, so EM runs on their counts. A logistic span classifier over the votes and the shape is then trained on the
posteriors, also from counts, and scores every span as a plain expression. Verified spans of the four base kinds always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .quality_rules import bound

# Fixed values of the query's contract, in its order.
BASE_KINDS = ("email", "ip", "card", "phone")
# A match may only begin after the match before or where its run of characters begins; a later start inside the run
# would have matched earlier. That and possessive repeats keep the search linear on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Kinds the method adds: opaque keys and tokens, values named a password.
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{14,}+(?![A-Za-z0-9])",
    "password": r"(?i)(?<=\b(?:password|passwd|pwd)\x20?[=:]\x20?[\x22']?)[^\s\x22']{6,}+",
}
KINDS = tuple(PATTERNS)
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.)(?!255\.)(?!127\.)[0-9.]+$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|20|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|ghp|sk|xox|AIza|glpat)|^(?:[0-9a-f]{16}|[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
    "password": r"[0-9]",
}
NEAR = {
    "email": r"(?i)(?:mail|contact|write|@)",
    "ip": r"(?i)(?:\bip\b|addr|host|server|from)",
    "card": r"(?i)(?:card|visa|iban|account|payment)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax)",
    "secret": r"(?i)(?:token|secret|key|password|credential|bearer)",
    "password": r"(?i)(?:password|passwd|pwd)",
}
# Context that speaks against personal data.
AGAINST = r"(?i)(?:version|figure|page|section|isbn|order no)\W*$"
NEAR_CHARS = 24
LABELERS = ("regex", "gazetteer", "context")
# Items of a block, blocks of a block of blocks.
_BLOCK = 32
# Beyond every text.
_PAST = 1 << 62


def _parts(items: Column, size: int) -> Column:
    """A list cut into lists of `size`; the list should be bound, as each part takes it anew."""
    starts = F.filter(F.sequence(F.lit(0), F.ceil(F.size(items) / size).cast("int")), lambda at: at * size < F.size(items))
    return F.transform(starts, lambda at: F.slice(items, at * size + 1, F.lit(size)))


def _scan(items: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What `add` makes of all items before each place, from `start`; one place more than items, and short lists only."""
    return F.aggregate(items, F.array(start), lambda sums, x: F.concat(sums, F.array(add(F.element_at(sums, -1), x))))


def _before(items: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What `add` makes of all items before each place, for lists of any length.

    A slice copies the whole list it is taken from and a scan copies what it has so far, so both work on blocks, and on
    blocks of blocks, and time grows with the length.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, start, add)

    def of_wide(wide: Column) -> Column:
        def of_block(blocks: Column, base: Column) -> Column:
            scanned = _scan(F.transform(blocks, fold), base, add)
            return bound(scanned, lambda at: F.flatten(F.transform(blocks, lambda block, j: F.slice(_scan(block, F.get(at, j), add), F.lit(1), F.size(block)))))

        bases = _scan(F.transform(wide, fold), start, add)
        return bound(bases, lambda at: F.flatten(F.transform(wide, lambda part, i: bound(_parts(part, _BLOCK), lambda blocks: of_block(blocks, F.get(at, i))))))

    return bound(items, lambda items: bound(_parts(items, _BLOCK * _BLOCK), of_wide))


def _offsets(lengths: Column) -> Column:
    """Sums of all lengths before each place."""
    return _before(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _matches(text: Column, pattern: str) -> Column:
    """(start, value, before) of all matches, in code points."""

    def placed(gaps: Column) -> Column:
        def of_hits(hits: Column) -> Column:
            steps = F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)).cast("bigint") + F.char_length(h))
            return bound(
                _offsets(steps),
                lambda at: F.transform(
                    hits,
                    lambda h, i: F.struct(
                        (F.get(at, i) + F.char_length(F.get(gaps, i))).alias("start"), h.alias("value"), F.right(F.get(gaps, i), F.lit(NEAR_CHARS)).alias("before")
                    ),
                ),
            )

        return F.when(F.size(gaps) > 1, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_hits))

    return bound(F.split(text, pattern, -1), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.coalesce(total % 10 == 0, F.lit(False))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # Over three digits can be at most 255 only with leading zeros.
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.char_length(_digits(value))
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    if kind == "secret":
        return F.char_length(value) >= 18
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Candidates of one kind with votes (1 for, -1 against, 0 none) and shape."""

    def judged(m: Column) -> Column:
        value, before = m["value"], m["before"]
        valid = _valid(kind, value)
        digits = F.char_length(_digits(value)) * 4
        near = F.when(before.rlike(AGAINST), -1).when(before.rlike(NEAR[kind]), 1).otherwise(0) if kind != "password" else F.lit(1)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            m["start"].alias("start"),
            (m["start"] + F.char_length(value)).alias("end"),
            F.when(valid, 1).otherwise(-1).alias("regex"),
            F.when(value.rlike(GAZETTEER[kind]), 1).otherwise(-1).alias("gazetteer"),
            near.cast("int").alias("context"),
            F.when(digits <= F.char_length(value), 0).when(digits <= F.char_length(value) * 3, 1).otherwise(2).alias("digits"),
            F.when(F.char_length(value) < 12, 0).when(F.char_length(value) < 24, 1).otherwise(2).alias("size"),
            (valid & F.lit(kind in BASE_KINDS)).alias("base"),
        )

    hint = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]") if kind != "password" else text.rlike("(?i)passw|pwd")
    empty = F.array().cast(_SPAN_TYPE)
    return F.when(hint, F.coalesce(F.transform(_matches(text, PATTERNS[kind]), judged), empty)).otherwise(empty)


_SPAN_TYPE = (
    "array<struct<kind:int,start:bigint,end:bigint,regex:int,gazetteer:int,context:int,digits:int,size:int,base:boolean>>"
)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row of (doc_id, text): all candidates by kind and start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", F.concat(*[_spans(text, kind) for kind in KINDS]).alias("spans"))
    # An added candidate that meets a verified base span, or a password that is also a secret, gives way.
    secret = F.lit(KINDS.index("secret"))

    def resolved(spans: Column) -> Column:
        base = _ordered(F.filter(spans, lambda s: s["base"] & (s["kind"] < len(BASE_KINDS))))
        keys = _ordered(F.filter(spans, lambda s: s["kind"] == secret))

        def apart(base: Column) -> Column:
            return bound(keys, lambda keys: F.filter(spans, lambda s: (s["kind"] < len(BASE_KINDS)) | ~(_meets(base, s) | ((s["kind"] > secret) & _meets(keys, s)))))

        return F.when(F.exists(spans, lambda s: s["kind"] >= len(BASE_KINDS)), bound(base, apart)).otherwise(spans)

    return found.withColumn("spans", bound(F.col("spans"), resolved))


def _ordered(spans: Column) -> Column:
    """(starts, reach): the starts of spans in order, and for each place the furthest end before it; a last place ends both."""
    last = F.struct(F.lit(_PAST).alias("start"), F.lit(_PAST).alias("end"))
    pairs = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def columns(pairs: Column) -> Column:
        reach = _before(F.transform(pairs, lambda p: p["end"]), F.lit(-1).cast("bigint"), lambda a, x: F.greatest(a, x))
        return F.struct(F.transform(pairs, lambda p: p["start"]).alias("starts"), reach.alias("reach"))

    return bound(F.concat(pairs, F.array(last)), columns)


def _meets(ordered: Column, span: Column) -> Column:
    """Whether a span overlaps one of ordered spans: of those that start before its end, the furthest end tells."""
    starts = ordered["starts"]
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts))).cast("int"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        after = F.get(starts, middle) < span["end"]
        low, high = F.when(after, middle + 1).otherwise(at["low"]), F.when(after, at["high"]).otherwise(middle)
        return F.when(at["low"] < at["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(at)

    whole = F.struct(F.lit(0).alias("low"), (F.size(starts) - 1).alias("high"))
    place = F.aggregate(halvings, whole, halve, lambda at: at["low"])
    return F.get(ordered["reach"], place) > span["start"]


def estimate(patterns: Sequence[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]], float]:
    """EM over vote patterns with counts: the posterior of each pattern, each labeler's reliability, the prior.

    A labeler's reliability is (share of its votes that are right on personal data, on other spans). Counts are smoothed, and the
    start trusts labelers at 0.8, which also fixes which class is which.
    """
    n = len(LABELERS)
    rates, prior = [(0.8, 0.8)] * n, 0.5
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _count in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(votes, rates):
                if v:
                    yes += math.log(a if v > 0 else 1 - a)
                    no += math.log(1 - b if v > 0 else b)
            posterior[votes] = 1 / (1 + math.exp(min(50.0, no - yes)))
        total = sum(c for _, c in patterns)
        prior = (sum(c * posterior[v] for v, c in patterns) + 1) / (total + 2)
        rates = []
        for k in range(n):
            right_yes = sum(c * posterior[v] for v, c in patterns if v[k] > 0)
            all_yes = sum(c * posterior[v] for v, c in patterns if v[k])
            right_no = sum(c * (1 - posterior[v]) for v, c in patterns if v[k] < 0)
            all_no = sum(c * (1 - posterior[v]) for v, c in patterns if v[k])
            rates.append(((right_yes + 8) / (all_yes + 10), (right_no + 8) / (all_no + 10)))
    return posterior, rates, prior


FEATURES = ("regex", "gazetteer", "context", "digits", "size", "kind")


def _terms(row: Sequence[int]) -> list[tuple[str, int]]:
    return [("", 0), *zip(FEATURES, row)]


def fit(cells: Sequence[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[tuple[str, int], float]:
    """Logistic regression over cells (features, count, posterior); one weight per feature value."""
    weights: dict[tuple[str, int], float] = {}
    total = sum(c for _, c, _ in cells) or 1.0
    for _ in range(rounds):
        slope: dict[tuple[str, int], float] = {}
        for row, count, target in cells:
            score = sum(weights.get(t, 0.0) for t in _terms(row))
            miss = (1 / (1 + math.exp(-max(-50.0, min(50.0, score)))) - target) * count / total
            for t in _terms(row):
                slope[t] = slope.get(t, 0.0) + miss
        for t, s in slope.items():
            weights[t] = weights.get(t, 0.0) - rate * (s + decay * weights.get(t, 0.0))
    return weights


def _score(span: Column, weights: dict[tuple[str, int], float]) -> Column:
    total = F.lit(weights.get(("", 0), 0.0))
    for name in FEATURES:
        choice = F.lit(0.0)
        for (feature, value), w in sorted(weights.items()):
            if feature == name:
                choice = F.when(span[name] == value, F.lit(w)).otherwise(choice)
        total = total + choice
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans) per row of (doc_id, text): spans of (kind, start, end, base, score), by kind and start.

    Places count code points, the end is exclusive. Verified spans of the base kinds stay whatever their score; other candidates are
    added if the span classifier gives at least `threshold`. Null and empty texts have no spans; an empty table
    trains nothing and gives no rows. Rows are independent, so repeated ids do no harm. Other columns are ignored.
    """
    found = stage(candidates(docs), "candidates")
    counted = (
        found.select(F.explode("spans").alias("s"))
        .groupBy(*[F.col(f"s.{name}").alias(name) for name in FEATURES])
        .agg(F.count("*").alias("n"))
        .collect()  # at most 3^5 * 6 rows, however large the table
    )
    by_votes: dict[tuple[int, ...], float] = {}
    for r in counted:
        votes = tuple(r[name] for name in LABELERS)
        by_votes[votes] = by_votes.get(votes, 0.0) + r["n"]
    posterior, _, _ = estimate(sorted(by_votes.items()))
    cells = sorted((tuple(r[name] for name in FEATURES), float(r["n"]), posterior[tuple(r[name] for name in LABELERS)]) for r in counted)
    weights = fit(cells)
    scored = F.transform(
        "spans",
        lambda s: F.struct(
            F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["base"].alias("base"),
            _score(s, weights).alias("score"),
        ),
    )
    return found.select("doc_id", scored.alias("spans")).withColumn(
        "spans", F.filter("spans", lambda s: s["base"] | (~s["kind"].isin(*BASE_KINDS) & (s["score"] >= threshold)))
    )
