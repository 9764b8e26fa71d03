"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

Each permutation gives two signature values, the least and the largest hash of the set, so 64
permutations give 128 values. For one pair of sets both agree with probability equal to the Jaccard
similarity. A band is the two values of two permutations; 32 bands miss a pair at similarity 0.8 with
probability (1 - 0.8^4)^32 < 5e-8.

Plan: documents with equal sets become one class (group by a 128-bit digest). The bands of the class
representatives form buckets. Every document of a bucket asks to be compared with the bucket's least
member; all who ask for the same one are compared with each other in blocks of bounded size. Only a bucket that
was split over several blocks and still holds several components needs more: its members outside the
largest component are compared with all its members, again in blocks. A block emits one star per part that its links connect,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage, tasks_for
from .components import components
from .fingerprints import digest, mixed, shingle_sets

PERMUTATIONS = 64
BANDS = 32
BLOCK_DOCS = 256
# Shingles of one block of many documents; bounds a task's memory.
BLOCK_SHINGLES = 1_000_000
# Rows with a text or its set that a task may well take.
TEXTS_PER_TASK = 2000
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 4096


def min_max(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest value under every permutation of a set that is not empty."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), _STEP):
        moved = _FACTORS[:, None] * values[None, at : at + _STEP]
        np.minimum(low, moved.min(1), out=low)
        np.maximum(high, moved.max(1), out=high)
    return low, high


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    low, high = min_max(values)
    rows = np.stack((low, high), 1).reshape(BANDS, -1)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in rows.T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _sketch(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for values in shingle_sets(batch["text"].to_pylist(), width):
                sizes.append(len(values))
                digests.append(digest(values) if len(values) else None)
                bands.append(band_keys(values) if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                schema=schema,
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v.tobytes() for v in shingle_sets(batch["text"].to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values, pa.binary())], names=["doc_id", "shingles"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of one list with all of the other."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    sets = left + right
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    rows = rows[shared]
    _, columns = np.unique(columns[shared], return_inverse=True)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int(columns[-1]) + 1 if len(columns) else 0
    for at in range(0, width, _STEP):
        a, b = np.searchsorted(columns, (at, at + _STEP))
        dense = np.zeros((len(sets), min(_STEP, width - at)), np.float32)
        dense[rows[a:b], columns[a:b] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def forest(ids: list[int], sets: list[np.ndarray], queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Stars that connect what the links of the queries (positions) with all sets connect: each id and the least of its part."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    both = shared_counts([sets[q] for q in queries], sets)
    union = sizes[queries][:, None] + sizes[None, :] - both
    for i, j in zip(*np.nonzero(100 * both >= percent * union)):
        a, b = root(queries[i]), root(int(j))
        # The part of the least id stays the root.
        if ids[a] < ids[b]:
            parent[b] = a
        elif a != b:
            parent[a] = b
    return [(ids[i], ids[root(i)]) for i in range(len(ids)) if root(i) != i]


def _compare(percent: int):
    """Links of rows (block, doc_id, is_query, shingles) that come sorted by block."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(rows: dict) -> list[tuple[int, int]]:
        ids = [doc for doc, _ in rows]
        sets = [np.frombuffer(shingles, np.uint64) for _, shingles in rows]
        queries = [k for k, query in enumerate(rows.values()) if query]
        found = forest(ids, sets, queries, percent) if queries and len(ids) > 1 else []
        return [(a, b) for a, b in found if a != b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, {}
        for batch in batches:
            found = []
            columns = [batch[c] for c in ("block", "doc_id", "is_query", "shingles")]
            for key, doc, query, shingles in zip(*(c.to_pylist() for c in columns[:3]), columns[3]):
                if key != block:
                    found += links_of(rows)
                    block, rows = key, {}
                # Different texts under one id are compared each, as one node.
                text = (doc, shingles.as_py())
                rows[text] = query or rows.get(text, False)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
        if found := links_of(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return run


def _grows(frame: DataFrame) -> DataFrame:
    """Marks the side of a join that grows with the corpus: it is never broadcast, so the plan is alike at every size."""
    return frame.hint("merge")


def _links(requests: DataFrame, sets: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Compare the documents of each block; requests: (block, doc_id, is_query)."""
    rows = requests.join(_grows(sets), "doc_id").select("block", "doc_id", "is_query", "shingles")
    dealt = rows.repartition("block").sortWithinPartitions("block")
    # A block stays in one shuffle partition, and a task takes whole partitions one after the other.
    return stage(dealt.mapInArrow(_compare(percent), "a bigint, b bigint"), "links", tasks)


def _salts(docs: str = "docs", shingles: str = "shingles"):
    by_count = F.ceil(F.col(docs) / (BLOCK_DOCS - 1))
    by_size = F.least(F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.col(docs))
    return F.greatest(by_count, by_size, F.lit(1)).cast("int")


def _across_blocks(asked: DataFrame, wide: DataFrame, first: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """Links in blocks and, inside the buckets whose least member has more partners than one block takes, between blocks."""
    spark = asked.sparkSession
    tasks, compared = tasks_for(spark, most), tasks_for(spark, most, TEXTS_PER_TASK)
    labels = stage(components(first, most), "labels", tasks)
    members = asked.join(_grows(wide), "center", "left_semi")
    parts = stage(
        members.join(_grows(labels), F.col("doc_id") == F.col("node"), "left").select(
            "band", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
        ),
        "parts",
        tasks,
    )
    by_part = parts.groupBy("band", "component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    split = stage(
        by_part.groupBy("band")
        .agg(
            F.max_by("component", F.struct("docs", "component")).alias("main"),
            F.max("docs").alias("in_main"),
            F.sum("docs").alias("docs"),
            F.sum("shingles").alias("shingles"),
            F.count("*").alias("parts"),
        )
        .where("parts > 1")
        .select(
            "band",
            "main",
            _salts().alias("columns"),
            F.ceil((F.col("docs") - F.col("in_main")) / BLOCK_DOCS).cast("int").alias("rows"),
        ),
        "split",
        tasks,
    )
    still = parts.join(_grows(split), "band")
    row = F.pmod(F.xxhash64("doc_id"), F.col("rows")).cast("int")
    column = F.pmod(F.xxhash64("doc_id"), F.col("columns")).cast("int")
    asking = still.where("component <> main").select(
        "doc_id", "band", row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), F.lit(True).alias("is_query")
    )
    answering = still.select(
        "doc_id", "band", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), column.alias("column"), F.lit(False).alias("is_query")
    )
    blocks = asking.unionByName(answering).select(F.struct("band", "row", "column").alias("block"), "doc_id", "is_query")
    return labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_links(blocks, sets, percent, compared))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs` (doc_id bigint, text string).

    A set holds the distinct runs of `width` words, ASCII letters lower-cased; a shorter text counts as one run,
    an empty or null text has none and links with nothing. Texts link when `percent` of the union is
    shared. component_id is the least id reachable; `kept` marks that document. Rows that share an id are one node.
    A row without an id keeps its own place: component_id is null and kept is true.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = stage(
        docs.mapInArrow(_sketch(width), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "sketch"
    )
    spark, n = docs.sparkSession, sketch.count()
    by_doc, by_band = tasks_for(spark, n), tasks_for(spark, BANDS * n)
    known = sketch.where("doc_id is not null and n_shingles > 0")
    copies = stage(
        known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"),
        "copies",
        by_doc,
    )
    bands = F.when(F.expr("first is null or first = doc_id"), F.col("bands"))
    members = stage(known.join(_grows(copies), "digest", "left").select("doc_id", "n_shingles", F.explode(bands).alias("band")), "members", by_band)
    buckets = members.groupBy("band").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last")).where("center < last")
    asked = stage(members.join(_grows(stage(buckets.select("band", "center"), "buckets", by_band)), "band").select("band", "center", "doc_id", "n_shingles"), "asked", by_band)
    pairs = stage(asked.select("center", "doc_id", "n_shingles").distinct(), "pairs", by_band)
    most = pairs.count()
    compared = tasks_for(spark, most, TEXTS_PER_TASK)
    spread = stage(
        pairs.groupBy("center").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles")).select("center", _salts().alias("salts")),
        "spread",
        by_doc,
    )
    sets = stage(
        docs.join(_grows(pairs.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id bigint, shingles binary"),
        "sets",
        tasks_for(spark, n, TEXTS_PER_TASK),
    )
    salted = pairs.join(_grows(spread), "center").select(
        "doc_id",
        "center",
        F.explode(
            F.when(F.expr("doc_id = center"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
            )
        ).alias("salt"),
    )
    first = _links(salted.select(F.struct("center", "salt").alias("block"), "doc_id", F.lit(True).alias("is_query")), sets, percent, compared)
    wide = spread.where("salts > 1").select("center")
    links = first if wide.isEmpty() else _across_blocks(asked, wide, first, sets, percent, most)
    # Every row again with the class of its set; the classes of an id's rows hang together by that id.
    located = stage(
        sketch.select("doc_id", "n_shingles", "digest").join(_grows(copies), "digest", "left").select(
            "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("first")
        ),
        "located",
        by_doc,
    )
    several = located.groupBy("doc_id").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").select("doc_id")
    tied = located.join(_grows(several), "doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    joined = stage(components(links.unionByName(tied), most + n), "components", by_doc)
    final = located.join(_grows(joined), F.col("first") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first"))
    return final.coalesce(by_doc).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


# All pairs over shared shingles: fit for small tables only.
ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x20\\x09-\\x0D]+') as w from documents where text is not null),
s as (select distinct doc_id, unnest(case when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * k >= 80 * (nx.n + ny.n - k)),
b as (select x, y from e union all select y, x from e),
r as (select doc_id as node, doc_id as root from documents union select b.y, r.root from r join b on b.x = r.node),
c as (select node, min(root) as component_id from r group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join c on c.node = d.doc_id left join n on n.doc_id = d.doc_id
"""
