"""Line-first cleaning: bad lines go, and documents that lose too much text with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the query's contract: white space, symbols.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NAVIGATION = (
    r"(?i)^\W*(?:home|menu|login|log in|sign in|sign up|next|previous|back to top|skip to (?:main )?content|search|share|"
    r"read more|contact us|about us|sitemap|follow us)(?:\W+(?:home|menu|login|log in|sign in|sign up|next|previous|search|share|"
    r"read more|contact us|about us|sitemap|follow us))*\W*$"
)
BOILERPLATE = (
    r"(?i)(?:all rights reserved|licensed under|released under the|copyright \(c\)|terms of (?:use|service)|privacy policy|"
    r"we use cookies|accept cookies|enable javascript|subscribe to our newsletter|click here to)"
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _neighbours(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items of a sorted list whose key equals that of an item next to them."""
    same = lambda x, at: F.coalesce(key(F.get(items, at)) == key(x), F.lit(False))
    return F.filter(items, lambda x, i: same(x, i - 1) | same(x, i + 1))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the list, the first occurrence included.

    Windows are sorted as (32-bit hash, place) in one integer; those that share a hash are compared as text, so a collision
    changes nothing. Linear but for the sorting, also for very long texts.
    """
    n = F.size(words)
    window = lambda i: F.hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.shiftleft(window(i).cast("bigint"), 32) + i.cast("bigint"))
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    text = lambda x: F.struct(F.array_join(F.slice(words, place(x) + 1, WINDOW), " ").alias("text"), place(x).alias("place"))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def exact(texts: Column) -> Column:
        found = _neighbours(texts, lambda x: x["text"])
        return bound(F.sort_array(F.transform(found, lambda x: x["place"])), covered)

    def of_sorted(hashes: Column) -> Column:
        suspects = _neighbours(hashes, lambda x: F.shiftright(x, 32))
        return bound(suspects, lambda s: F.when(F.size(s) == 0, F.lit(0).cast("bigint")).otherwise(bound(F.sort_array(F.transform(s, text)), exact)))

    return F.when(n <= WINDOW, F.lit(0).cast("bigint")).otherwise(bound(F.sort_array(packed), of_sorted))


def _count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def line_failure(line: Column) -> Column:
    """Name of the rule that a line fails, or null. Lines without a word pass."""
    solid = F.char_length(F.translate(line, SPACE, ""))
    symbols = _count_of(line, SYMBOLS)
    marks = _count_of(line, PUNCTUATION)
    items = _count_of(line, "|»·•>")
    return (
        F.when((symbols >= 3) & (symbols * 100 > solid * 5), F.lit("punctuation"))
        .when((marks >= 4) & (marks * 100 > solid * 15), F.lit("punctuation"))
        .when((items >= 3) & (solid < items * 20), F.lit("navigation"))
        .when((solid < 120) & line.rlike(NAVIGATION), F.lit("navigation"))
        .when(line.rlike(BOILERPLATE), F.lit("boilerplate"))
    )


def clean_lines(docs: DataFrame, max_lost_percent: int = 30, min_words: int = 50, max_repeated_percent: int = 50) -> DataFrame:
    """Every row of `docs` with counts, the text without its failed lines as `clean_text`, and `kept`.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words count the whole text. base_failed: fewer than `min_words`
    words, or more than `max_repeated_percent` of them in repeated windows. n_failed_lines and lost_chars tell what the line rules removed;
    a document is kept if its base did not fail and it lost at most `max_lost_percent` of its word characters. A null
    text counts as empty and is not kept. Columns of `docs` with one of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_failed_lines", "lost_chars", "kept"]
    docs = docs.drop(*made)
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    counted = docs.withColumns(
        {
            "__words": bound(word_list(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeated"))),
            "__lines": bound(
                F.filter(lines, lambda x: F.translate(x, SPACE, "") != ""), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")
            ),
            "__judged": F.transform(lines, lambda x: F.struct(x.alias("line"), line_failure(x).alias("rule"))),
        }
    )
    failed = F.filter("__judged", lambda x: x["rule"].isNotNull())
    lost = F.aggregate(failed, F.lit(0).cast("bigint"), lambda a, x: a + F.char_length(F.translate(x["line"], SPACE, "")))
    summed = counted.select(
        *docs.columns,
        F.col("__words.n").alias("n_words"),
        F.char_length(F.translate(text, SPACE, "")).cast("bigint").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        F.col("__lines").alias("n_dup_lines"),
        F.col("__words.repeated").alias("n_repeat_words"),
        F.array_join(F.transform(F.filter("__judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
        F.size(failed).cast("bigint").alias("n_failed_lines"),
        lost.alias("lost_chars"),
    )
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated_percent)
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * max_lost_percent)
    return summed.withColumn("base_failed", base).withColumn("kept", kept)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_count(text: str, characters: str) -> str:
    return f"(length({text}) - length(translate({text}, {_sql(characters)}, '')))"


def _sql_solid(text: str) -> str:
    return f"length(translate({text}, {_SPACES}, ''))"


ORACLE = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from t),
g as (select doc_id, unnest(range(1, greatest(len(words) - 2, 0) + 1)) as i, words from w),
h as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n from g),
c as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where n > 1) group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line from t),
d as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l where {_sql_solid('line')} > 0 group by doc_id),
m as (select doc_id, line, {_sql_solid('line')} as solid, {_sql_count('line', SYMBOLS)} as symbols,
             {_sql_count('line', PUNCTUATION)} as marks, {_sql_count('line', "|»·•>")} as items from l),
f as (select doc_id, sum(solid) as lost_chars, count(*) as n_failed_lines from m
      where (symbols >= 3 and symbols * 100 > solid * 5) or (marks >= 4 and marks * 100 > solid * 15)
         or (items >= 3 and solid < items * 20) or (solid < 120 and regexp_matches(line, {_sql(NAVIGATION)}))
         or regexp_matches(line, {_sql(BOILERPLATE)}) group by doc_id),
s as (select w.doc_id, len(words) as n_words, {_sql_solid('text')} as word_chars, {_sql_count('text', SYMBOLS)} as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
             coalesce(n_failed_lines, 0) as n_failed_lines, coalesce(lost_chars, 0)::bigint as lost_chars
      from w left join c on c.doc_id = w.doc_id left join d on d.doc_id = w.doc_id left join f on f.doc_id = w.doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines, n_repeat_words, n_failed_lines, lost_chars,
       (n_words < 50 or n_repeat_words * 100 > n_words * 50) as base_failed,
       not (n_words < 50 or n_repeat_words * 100 > n_words * 50) and lost_chars * 100 <= word_chars * 30 as kept
from s
"""
