"""Collocations of two and three words, grown best first from prefix counts.

A phrase is counted only after its prefix. Words that occur often enough grow to pairs; a pair xy bounds all that it can
give: for a phrase xyz that occurs a times, a <= f(yz) and a <= f(xy), so the cut after x gives it at most f(xy) / f(x), and the pair's own
score is at most that too, as f(xy) <= f(y). Pairs are the frontier, opened in order of this bound, language by language, down to a
threshold: with all pairs opened whose bound reaches it, every phrase that scores so much is known, and so is every longer
phrase that can drop one of these pairs. When 2000 of them survive, ties included, nothing below can change the report;
until then the threshold of that language falls.

Counting is exact. What tasks know of earlier levels is a table of bits, one per hash of a phrase: a wrong bit lets
a phrase be counted that need not be, and changes nothing else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage
from .cells import counted, table_size
from .fingerprints import _BYTES, _powers, mixed

REPORT = 2000
LEAST_COUNT = 10
# A phrase goes if a longer one holds it this often, in percent.
DROP_PERCENT = 50
MILLION = 1_000_000
NO_LANGUAGE = "und"
# Bits of a table: 64 for each phrase up to 32 MB; beyond that more phrases are counted that need not be.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
# Distinct phrases that a task counts before it sends them on.
HELD = 200_000
# The first threshold is meant to leave so many pairs, each later one so many times more.
FIRST_PAIRS, MORE = 2 * REPORT, 4
# Text that a task cuts into words at once; a longer piece is taken whole.
CHUNK_BYTES = 1 << 20
_ENDS = re.compile(rb"[.,;:!?\x0a-\x0d]")
_WORD, _BLANK, _END = range(3)
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _END
_PAIR = np.uint64(0xD1342543DE82EF95)


class Words:
    """The words of a text, ASCII letters lower-cased, as places in its UTF-8 bytes."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\t", b" ")
        codes = np.frombuffer(self.data, np.uint8)
        kind = _KIND[codes]
        inside = kind == _WORD
        turns = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        piece = np.cumsum(kind == _END)[self.starts]
        # Whether a word and the next one lie in one piece.
        self.same = piece[1:] == piece[:-1]
        self._codes, self._inside = codes, inside

    def hashes(self) -> np.ndarray:
        """64 bits per word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        before = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
        values = _BYTES[self._codes[self._inside]] * _powers(int(sizes.max()))[place]
        return mixed(np.add.reduceat(values, before) + sizes.astype(np.uint64))

    def phrases(self, first: np.ndarray, width: int) -> list[bytes]:
        """The phrases of `width` words that start at the given words, single spaces between."""
        starts, ends, data = self.starts[first], self.ends[first + width - 1], self.data
        out = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if width > 1:
            gaps = np.concatenate((self.starts[1:] - self.ends[:-1], [0]))
            for i in np.flatnonzero(sum(gaps[first + k] for k in range(width - 1)) > width - 1):
                out[i] = b" ".join(filter(None, out[i].split(b" ")))
        return out


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """64 bits for each word and the next one."""
    return mixed(words[:-1] * _PAIR + words[1:])


def chunks(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, lower-cased and one after another, cut between pieces into parts of about CHUNK_BYTES."""
    data, at = b"\n".join(texts).lower(), 0
    while at < len(data):
        end = _ENDS.search(data, at + CHUNK_BYTES)
        to = end.end() if end else len(data)
        yield data[at:to]
        at = to


# Made once per task: takes the words of a text to the phrases that are counted.
Grower = Callable[[], Callable[[Words], list[bytes]]]


def _grow(grower: Grower):
    """Counts of phrases per language, added up in the task before they leave it."""

    def sent(held: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, counts in held.items() for _ in range(len(counts))]
        phrases = pa.array([p for counts in held.values() for p in counts], pa.binary()).cast(pa.string())
        sizes = pa.array([n for counts in held.values() for n in counts.values()], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), phrases, sizes], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases_of = grower()
        held: dict[str, Counter] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
                texts.setdefault(lang, []).append(text.as_py())
            for lang, own in texts.items():
                for part in chunks(own):
                    held.setdefault(lang, Counter()).update(phrases_of(Words(part)))
                    if sum(map(len, held.values())) >= HELD:
                        yield sent(held)
                        held = {}
        if held:
            yield sent(held)

    return run


def _counts(docs: DataFrame, grower: Grower, least: int, name: str) -> DataFrame:
    """(lang, phrase, n) of the phrases that are taken from the pieces of all texts, from `least` occurrences on."""
    grown = docs.mapInArrow(_grow(grower), "lang string, phrase string, n bigint")
    return stage(grown.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), name)


class Bits:
    """A set of phrases of one or two words of which a task can say that one is surely not in it."""

    def __init__(self, phrases: DataFrame, width: int):
        size = table_size(phrases.count(), 64, LEAST_BITS, MOST_BITS)
        self.mask = np.uint64(size - 1)

        def cells(batch: pa.RecordBatch) -> np.ndarray:
            hashes = Words(b"\n".join(batch["phrase"].cast(pa.binary()).to_pylist())).hashes()
            return ((hashes if width == 1 else pair_hashes(hashes)[::2]) & self.mask).astype(np.int64)

        bits = counted(phrases.select("phrase"), cells, size, 1)
        self.table = phrases.sparkSession.sparkContext.broadcast(bits)

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be one of the set."""
        cells = hashes & self.mask
        return (self.table.value[cells >> np.uint64(3)] << (cells & np.uint64(7)).astype(np.uint8)) & 128 > 0


def _single() -> Callable[[Words], list[bytes]]:
    return lambda words: words.phrases(np.arange(len(words.starts)), 1)


def _pairs(frequent: Bits) -> Grower:
    """Pairs of frequent words."""

    def run(words: Words) -> list[bytes]:
        known = frequent.marked(words.hashes())
        return words.phrases(np.flatnonzero(words.same & known[:-1] & known[1:]), 2)

    return lambda: run


def _triples(frequent: Bits, opened: Bits) -> Grower:
    """Phrases of three words both of whose pairs are frequent, and one of them opened."""

    def run(words: Words) -> list[bytes]:
        pairs = pair_hashes(words.hashes())
        known, is_open = words.same & frequent.marked(pairs), opened.marked(pairs)
        return words.phrases(np.flatnonzero(known[:-1] & known[1:] & (is_open[:-1] | is_open[1:])), 3)

    return lambda: run


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(10^6 a^2 / (l r)) in integers of up to 38 digits."""
    wide = {c: f"cast({c} as decimal(38,0))" for c in (a, l, r)}
    return F.expr(f"(cast({MILLION} as decimal(38,0)) * {wide[a]} * {wide[a]}) div ({wide[l]} * {wide[r]})")


def _grows(frame: DataFrame) -> DataFrame:
    """Marks the side of a join that grows with the corpus: it is never broadcast, so the plan is alike at every size."""
    return frame.hint("merge")


def _counted_as(counts: DataFrame, key: str, name: str) -> DataFrame:
    return _grows(counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(name)))


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound) of every frequent pair."""
    parts = F.split("phrase", " ")
    cut = pairs.select("lang", "phrase", F.col("n").alias("a"), parts[0].alias("x"), parts[1].alias("y"))
    met = stage(cut.join(_counted_as(words, "x", "l"), ["lang", "x"]), "pair_heads").join(_counted_as(words, "y", "r"), ["lang", "y"])
    bound = F.expr(f"cast({MILLION} as decimal(38,0)) * a div l")
    return stage(met.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"), bound.alias("bound")), "pairs_scored")


def _scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of three words by the cut that scores least, the first of equal ones."""
    head, tail = F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)
    first, last = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    met = triples.select("lang", "phrase", F.col("n").alias("a"), head.alias("head"), tail.alias("tail"), first.alias("x"), last.alias("z"))
    for key, counts, name in (("head", pairs, "l2"), ("tail", pairs, "r1"), ("x", words, "l1"), ("z", words, "r2")):
        met = met.join(_counted_as(counts, key, name), ["lang", key])
    s1, s2 = _score("a", "l1", "r1"), _score("a", "l2", "r2")
    return met.select(
        "lang",
        "phrase",
        "a",
        F.when(s1 <= s2, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(s1 <= s2, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least(s1, s2).alias("score"),
    )


def _thresholds(scored: DataFrame, wanted: int) -> DataFrame:
    """(lang, threshold): the score that `wanted` pairs of a language reach, 0 if there are fewer.

    Scores are at most 10^6, so a language's counts by score are a bounded table.
    """
    by_score = scored.groupBy("lang", "score").agg(F.count("*").alias("pairs"))
    above = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = by_score.select("lang", "score", F.sum("pairs").over(above).alias("pairs"))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("pairs") >= wanted, F.col("score"))), F.lit(0)).alias("threshold"))


def collocations(docs: DataFrame, report: int = REPORT, first_pairs: int = FIRST_PAIRS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    Takes (text, lang) of `docs`; other columns are ignored, repeated rows all count. A null text has no words, a null lang is
    `und`. Phrases lie inside pieces (texts cut at . , ; : ! ? and line ends), occur ten times or more, and are left out if a phrase
    of three words that holds them occurs half as often. Ties in score go to the more frequent, then to the lesser phrase
    by its bytes. A language without such phrases, or an empty table, gives no rows.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    docs = docs.select(lang, F.col("text").cast("string").alias("text")).where("text is not null")
    every = _counts(docs, _single, 1, "words")
    sizes = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where(F.col("n") >= LEAST_COUNT)
    pairs = _counts(docs, _pairs(Bits(words, 1)), LEAST_COUNT, "pairs")
    scored = _scored_pairs(pairs, words)
    frequent = Bits(pairs, 2)
    wanted, triples = first_pairs, None
    # Languages that are not settled, with the bound down to which their pairs were opened before.
    left = stage(scored.groupBy("lang").agg(F.lit(MILLION + 1).cast("bigint").alias("before")), "left")
    settled = None
    while not left.isEmpty():
        marks = stage(left.join(_thresholds(scored, wanted), "lang"), "marks")
        marked = scored.join(_grows(marks), "lang")
        opening = marked.where("bound >= threshold and bound < before").select("lang", "phrase")
        found = _counts(docs, _triples(frequent, Bits(opening, 2)), LEAST_COUNT, "triples")
        # A phrase counted twice was counted alike.
        triples = found if triples is None else stage(triples.unionByName(found).distinct(), "triples")
        parts = [F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)]
        longer = triples.select("lang", F.explode(F.array(*parts)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        kept_pairs = marked.join(_grows(longer), ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {DROP_PERCENT} * a")
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        both = kept_pairs.select(*columns, "threshold").unionByName(
            _scored_triples(triples, pairs, words).select(*columns).join(_grows(marks), "lang").select(*columns, "threshold")
        )
        surviving = stage(both.where("score >= threshold"), "surviving")
        done = surviving.groupBy("lang").agg(F.count("*").alias("known"))
        state = stage(marks.join(done, "lang", "left").withColumn("open", F.expr(f"threshold > 0 and coalesce(known, 0) < {report}")), "state")
        ready = surviving.join(_grows(state.where("not open").select("lang")), "lang", "left_semi").select(*columns)
        settled = ready if settled is None else settled.unionByName(ready)
        left = stage(state.where("open").select("lang", F.col("threshold").alias("before")), "left")
        wanted *= MORE
    if settled is None:
        empty = "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
        return docs.sparkSession.createDataFrame([], empty)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = settled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= report)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
with p as (select coalesce(lang, 'und') as lang, doc_id, row_number() over () as row, unnest(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents where text is not null),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) as s(k)) group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
g as (select lang, k, phrase, f as a, string_split(phrase, ' ') as v from f where k > 1 and f >= 10),
c as (select g.*, cut, array_to_string(v[1:cut], ' ') as head, array_to_string(v[cut + 1:k], ' ') as tail from g, (values (1), (2)) as s(cut) where cut < k),
s as (select c.*, x.f as l, y.f as r, (1000000::hugeint * a * a // (x.f::hugeint * y.f))::bigint as score
      from c join f x on x.lang = c.lang and x.phrase = c.head and x.k = c.cut join f y on y.lang = c.lang and y.phrase = c.tail and y.k = c.k - c.cut),
m as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
long as (select lang, array_to_string(v[i:i + 1], ' ') as phrase, max(a) as longer from (select lang, v, a, unnest([1, 2]) as i from g where k = 3) group by all),
kept as (select m.* from m left join long on long.lang = m.lang and long.phrase = m.phrase and m.k = 2 where longer is null or 100 * longer < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
"""
