"""Removal of passages that repeat: overlapping windows of three lines, compared over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage

WINDOW = 3
# One or two repeated lines are a passage if they hold more words than this.
LONG_WORDS = 50
# White space of the word definition.
SPACE = " \t\n\x0b\x0c\r"


def _key(parts: Column) -> list[Column]:
    """128 bits for a window: two hashes of its lines that start from different values."""
    return [F.xxhash64(F.lit(1), parts).alias("h1"), F.xxhash64(F.lit(2), parts).alias("h2")]


def _lines(text: Column) -> Column:
    """(place, line) of each line with a word, outer white space removed."""
    every = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("place"), F.btrim(line, F.lit(SPACE)).alias("line")))
    return F.filter(every, lambda x: x["line"] != "")


def _long_windows(words: Column, size: int, long_words: int) -> Column:
    """(start, size) of each `size` consecutive lines that hold more than `long_words` words; `words` has the words of each line."""

    def total(start: Column) -> Column:
        return sum((F.get(words, start + i) for i in range(1, size)), F.get(words, start))

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - size), lambda s: total(s) > long_words)
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("size")))


def _windows(long_words: int | None) -> Column:
    """(start, size) of every window over the column `lines`; see dedup_lines."""
    count = F.size("lines")
    starts = F.sequence(F.lit(0), F.greatest(count - WINDOW, F.lit(0)))
    out = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(count, F.lit(WINDOW)).alias("size")))
    if long_words is not None:
        words = F.transform("lines", lambda line: F.size(F.split(line, f"[{SPACE}]+")))
        # A text of just so many lines is a window already. The word counts are bound once.
        for size in range(1, WINDOW):
            more = F.transform(F.array(words), lambda w: _long_windows(w, size, long_words))[0]  # noqa: B023
            out = F.when(count > size, F.concat(out, more)).otherwise(out)
    return F.when(count > 0, out)


def version(text: Column) -> Column:
    """Tells different texts under one id apart."""
    return F.xxhash64(text)


def repeated_windows(docs: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, version, found): start and size of windows, counted in lines with a word, that occurred before.

    Documents are ordered by doc_id, lines by place; the first occurrence is not listed. Different texts under one id are
    versions, told apart and ordered by a hash of the text.
    """
    known = docs.where("doc_id is not null and text is not null")
    lines = known.select("doc_id", version(F.col("text")).alias("version"), _lines(F.col("text"))["line"].alias("lines"))
    placed = lines.select("doc_id", "version", "lines", F.inline(_windows(long_words)))
    windows = stage(placed.select("doc_id", "version", "start", "size", *_key(F.slice("lines", F.col("start") + 1, F.col("size")))), "windows")
    # Partial minima and counts are combined before the shuffle, so a frequent window is one row per task.
    repeated = stage(
        windows.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "start")).alias("first"))
        .where("n > 1")
        .select("h1", "h2", "first"),
        "repeated",
    )
    later = windows.join(repeated.hint("merge"), ["h1", "h2"]).where(F.struct("doc_id", "version", "start") > F.col("first"))
    # Through a table, so that the join stands alone and its frequent keys can be split.
    return stage(later.select("doc_id", "version", "start", "size"), "later").groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "size")).alias("found"))


def dedup_lines(docs: DataFrame, long_words: int | None = LONG_WORDS) -> DataFrame:
    """Every row of `docs` with repeated passages removed from `text`, plus n_lines and n_removed.

    Windows are three consecutive lines, blank ones skipped, outer white space ignored; a text of fewer lines is one
    window. One or two consecutive lines of more words than `long_words` are windows too, unless that is None. Every window that occurred before, in this or an earlier document by doc_id, is covered; all covered lines
    go, also where windows overlap. Blank lines and the others stay as they were. A text all of
    whose lines go becomes empty. Null texts and rows without an id stay unchanged. Rows of one id and text count as one document, so copies of a row are treated alike;
    different texts under one id are documents of their own, ordered by a hash. Columns named n_lines and n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    kept_names = docs.columns
    found = repeated_windows(docs.select("doc_id", "text"), long_words).withColumnsRenamed({"doc_id": "__id", "version": "__version", "found": "__found"})
    # Both joined tables grow with the corpus, so neither is broadcast at any size.
    same = (docs["doc_id"] == found["__id"]) & (version(docs["text"]) == found["__version"])
    joined = docs.join(found.hint("merge"), same, "left").drop("__id", "__version")
    lines = F.split("text", "\n", -1)
    worded = joined.withColumn("__places", F.when(F.col("text").isNotNull(), _lines(F.col("text"))["place"]))
    covered = F.array_distinct(F.flatten(F.transform("__found", lambda w: F.slice("__places", w["start"] + 1, w["size"]))))
    marked = worded.withColumn("__gone", F.when(F.col("__found").isNotNull(), covered))
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    # The lines are bound once; a plain reference inside the inner function would split the text for every line.
    text = F.transform(F.array(lines), lambda all_: F.array_join(F.transform(rest, lambda i: F.get(all_, i)), "\n"))[0]
    empty = F.size("__gone") == F.size("__places")
    return marked.select(
        *[
            F.when(F.col("__gone").isNull(), F.col("text")).when(empty, F.lit("")).otherwise(text).alias("text") if c == "text" else F.col(c)
            for c in kept_names
        ],
        F.coalesce(F.size("__places"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


ORACLE = r"""
with split as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place
               from documents where doc_id is not null and text is not null),
trimmed as (select doc_id, place, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from split),
worded as (select *, row_number() over (partition by doc_id order by place) as k, count(*) over (partition by doc_id) as n
           from trimmed where bare <> ''),
threes as (select a.doc_id, a.k, a.n, a.bare as l1, b.bare as l2, c.bare as l3,
                  len(regexp_split_to_array(a.bare, '[ \t\n\x0B\f\r]+')) as w1, len(regexp_split_to_array(b.bare, '[ \t\n\x0B\f\r]+')) as w2
           from worded a left join worded b on a.doc_id = b.doc_id and b.k = a.k + 1
           left join worded c on a.doc_id = c.doc_id and c.k = a.k + 2),
windows as (select doc_id, k, 3 as size, l1, l2, l3 from threes where k = 1 or k <= n - 2
            union all select doc_id, k, 2, l1, l2, null from threes where n > 2 and l2 is not null and w1 + w2 > 50
            union all select doc_id, k, 1, l1, null, null from threes where n > 1 and w1 > 50),
ranked as (select *, row_number() over (partition by l1, l2, l3 order by doc_id, k) as occurrence from windows),
gone as (select distinct w.doc_id, w.place from worded w join ranked r
         on r.doc_id = w.doc_id and r.occurrence > 1 and w.k between r.k and r.k + r.size - 1),
rest as (select t.doc_id, string_agg(t.line, chr(10) order by t.place) as text
         from trimmed t left join gone g on t.doc_id = g.doc_id and t.place = g.place where g.place is null group by t.doc_id),
counts as (select doc_id, count(*) as n_lines from worded group by doc_id),
losses as (select doc_id, count(*) as n_removed from gone group by doc_id)
select d.doc_id, case when l.n_removed is null then d.text when l.n_removed = c.n_lines then '' else coalesce(r.text, '') end as text,
       coalesce(c.n_lines, 0) as n_lines, coalesce(l.n_removed, 0) as n_removed
from documents d left join rest r on r.doc_id = d.doc_id left join counts c on c.doc_id = d.doc_id
left join losses l on l.doc_id = d.doc_id
"""
