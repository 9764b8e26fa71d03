"""Near-duplicate vectors by binary codes of randomly rotated vectors.

A vector's code holds the signs of its components after random rotations, D bits in all, and a stored correction factor f, the inner
product of the rotated unit vector with its signs divided by the root of D. Then <u, signs of v> / f is an unbiased estimate of
the cosine of u and v, and for a pair at cosine c its error has a standard deviation of at most sqrt(1 - f^2) / f *
sqrt(1 - c^2) / sqrt(D - 1). Pairs whose estimate stays below the threshold by more than six of these are settled; all others are
computed again in double precision, and only that value links them.

Plan: equal vectors become one class. Candidates come from the same rotations: the largest component of a rotated vector and its
sign make one of 128 values, some of them together a band key, and vectors that share a key meet. Every vector of a bucket is first
compared with the bucket's least member only. Those within half the angle of the threshold form a ball: all of its pairs link, by
the triangle inequality, so a large group of close vectors is counted and never paired. Buckets that hold more than one
ball compare the members outside the largest ball with all members, in blocks of bounded size; a pair that meets in several buckets
counts in the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .cells import counted, table_size
from .components import components
from .fingerprints import mixed

THRESHOLD = 0.9
# A rotation is used in slices of this many components; the largest one and its sign are one of 2 * SLICE values.
SLICE = 64
CODE_BITS = 256
# Bands are as many as leave a pair at the threshold out with this probability, and keys as long as leave a vector so few strangers a band.
MISSED = 0.001
STRANGERS = 1 / 32
DEVIATIONS = 6.0
BLOCK_ROWS = 512
# Counters that tell band keys met once: 8 a key up to 32 MB; beyond that more of them are shuffled that need not be.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 25
_PAIRS = 65536
# Kept free of rounding: a ball's pairs are linked without being computed.
_MARGIN = 1e-6


@lru_cache(maxsize=4096)
def rotation(dims: int, number: int, width: int = SLICE) -> np.ndarray:
    """dims x width: orthonormal columns of a random rotation; of vectors padded with zeros if they are shorter."""
    random = np.random.Generator(np.random.PCG64([dims, number, width]))
    columns, signs = np.linalg.qr(random.standard_normal((max(dims, width), width)))
    return np.ascontiguousarray((columns * np.sign(np.diag(signs)))[:dims])


def code_width(dims: int) -> int:
    """Components of the rotated vector that the code is made of, a multiple of SLICE."""
    return -(-dims // SLICE) * SLICE


def rotated(units: np.ndarray) -> np.ndarray:
    """Unit vectors after one or more whole rotations, side by side, at unit length again."""
    dims = units.shape[1]
    width = code_width(dims)
    times = max(1, CODE_BITS // width)
    turned = [units @ rotation(dims, i, width) for i in range(times)]
    return np.concatenate(turned, 1) / math.sqrt(times)


def largest(units: np.ndarray, number: int) -> np.ndarray:
    """Which component of a rotation is largest, and its sign, as one number."""
    turned = units @ rotation(units.shape[1], number)
    at = np.abs(turned).argmax(1)
    return (at * 2 + (turned[np.arange(len(at)), at] < 0)).astype(np.uint64)


@lru_cache(maxsize=64)
def agreement(dims: int, cosine: float) -> float:
    """How often the largest components of two vectors at a cosine agree, over fixed random pairs, less two deviations."""
    random = np.random.Generator(np.random.PCG64([dims, 11]))
    n = 20_000
    u = random.standard_normal((n, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = random.standard_normal((n, dims))
    w -= (w * u).sum(1, keepdims=True) * u
    length = np.linalg.norm(w, axis=1, keepdims=True)
    v = cosine * u + math.sqrt(1 - cosine * cosine) * np.divide(w, length, out=np.zeros_like(w), where=length > 0)
    share = float((largest(u, 65535) == largest(v, 65535)).mean())
    return min(max(share - 2 * math.sqrt(share * (1 - share) / n), 1e-3), 0.99)


def plan_bands(vectors: int, dims: int, cosine: float = THRESHOLD) -> tuple[int, int]:
    """(values per band key, bands) for so many vectors."""
    values = max(1, math.ceil(math.log2(max(vectors, 1) / STRANGERS) / math.log2(2 * SLICE)))
    hit = agreement(dims, cosine) ** values
    return values, math.ceil(math.log(MISSED) / math.log1p(-hit))


def band_keys(units: np.ndarray, values: int, bands: int) -> np.ndarray:
    """rows x bands: the band keys of unit vectors."""
    out = np.empty((len(units), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(units), band * 4099 + units.shape[1] * 131 + 1, np.uint64)
        for i in range(values):
            # Numbers of the rotations that the code is made of are not used again.
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + largest(units, 16 + band * values + i))
        out[:, band] = key
    return out.view(np.int64)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; scaled by a power of two first, so squares neither overflow nor vanish."""
    scaled = vectors / np.exp2(np.floor(np.log2(np.abs(vectors).max(1, keepdims=True))))
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows of packed bits) and correction factors."""
    turned = rotated(units)
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


def estimates(units: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Estimated cosines of vectors (rows) with the vectors of codes (columns)."""
    turned = rotated(units).astype(np.float32)
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    return (turned @ signs.T) / (math.sqrt(turned.shape[1]) * factors.astype(np.float32))


def reach(factors: np.ndarray, width: int, cosine: float) -> np.ndarray:
    """How far the estimate of a pair at `cosine` or more may fall short, per code."""
    return DEVIATIONS * np.sqrt(1 - factors**2) / factors * math.sqrt(1 - cosine * cosine) / math.sqrt(max(width - 1, 1))


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sketch(plans: dict[int, tuple[int, int]]):
    """Adds `unit` (bytes of the unit vector), `code`, `factor` and `keys` to rows with `dims` and `vector`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                units = unit_vectors(_rows(part["vector"]))
                codes, factors = encode(units)
                made = [
                    pa.array([x.tobytes() for x in units], pa.binary()),
                    pa.array([x.tobytes() for x in codes], pa.binary()),
                    pa.array(factors),
                    pa.array(list(band_keys(units, *plans[int(d)])), pa.list_(pa.int64())),
                ]
                names = [n for n in part.schema.names if n != "vector"]
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), *made], names=[*names, "unit", "code", "factor", "keys"])

    return run


def _cells(keys: np.ndarray, size: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64)) % np.uint64(size)).astype(np.int64)


def _meeting(table, size: int):
    """(class_id, first, band, key) of the band keys that may belong to several classes."""
    names = ["class_id", "first", "band", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["keys"].flatten().to_numpy()
            at = np.repeat(np.arange(batch.num_rows), np.diff(batch["keys"].offsets.to_numpy()))
            band = np.arange(len(keys)) - np.searchsorted(at, at)
            some = np.flatnonzero(table.value[_cells(keys, size)] > 1)
            columns = [batch["class_id"].take(at[some]), batch["first"].take(at[some]), pa.array(band[some].astype(np.int32)), pa.array(keys[some])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def stars(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The least of each connected part with every other member."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [(x, root(x)) for x in list(parent) if root(x) != x]


def _by_block(columns: list[str], make, schema: pa.Schema):
    """`make(block, rows)` for each block of rows, which come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, found = None, [], []
        for batch in batches:
            for key, *row in zip(*(batch[c].to_pylist() for c in ["block", *columns])):
                if key != block:
                    found += make(block, rows) if rows else []
                    block, rows = key, []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
                found = []
        if rows and (found := make(block, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return run


def _matrix(column, kind) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in column])


def _near_center(bound: float):
    """(class_id, first and class_id of the center) of the classes of a block within `bound` of its center."""

    def make(block: dict, rows: list) -> list[tuple]:
        ids, units = [row[0] for row in rows], _matrix((row[1] for row in rows), np.float64)
        center = block["first"], block["class_id"]
        cosines = units @ units[ids.index(center[1])]
        return [(ids[i], *center) for i in np.flatnonzero(cosines >= bound)]

    return make


def compare(rows: list, cosine: float, band: int, values: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The weight that each class of a block links with, and the links as pairs of ball nodes.

    Rows are (class_id, copies, node, ball, outside, asks, unit, code, factor): classes that ask meet those that answer, their own ball
    aside. A pair counts in the first band in which its keys agree; for one that answers only if it isn't outside the main ball, as it
    asks itself otherwise.
    """
    queries, answers = ([r for r in rows if r[5] == asks] for asks in (True, False))
    if not queries or not answers:
        return {}, []
    asking, held = (_matrix((r[6] for r in side), np.float64) for side in (queries, answers))
    codes, factors = _matrix((r[7] for r in answers), np.uint8), np.array([r[8] for r in answers])
    balls = [np.array([r[3] for r in side]) for side in (queries, answers)]
    possible = estimates(asking, codes, factors) + reach(factors, codes.shape[1] * 8, cosine) >= cosine
    q, a = np.nonzero(possible & (balls[0][:, None] != balls[1]))
    linked = np.zeros(len(q), bool)
    for at in range(0, len(q), _PAIRS):
        part = slice(at, at + _PAIRS)
        linked[part] = np.einsum("ij,ij->i", asking[q[part]], held[a[part]]) >= cosine
    q, a = q[linked], a[linked]
    # Only linked pairs are asked in which band they met first.
    used = [np.unique(x, return_inverse=True) for x in (q, a)]
    if band and len(q):
        earlier = [band_keys(units[u], values, band)[at] for units, (u, at) in zip((asking, held), used)]
        new = (earlier[0] != earlier[1]).all(1)
        q, a = q[new], a[new]
    weights: dict[int, int] = {}
    for i, j in zip(q.tolist(), a.tolist()):
        one, other = queries[i], answers[j]
        weights[one[0]] = weights.get(one[0], 0) + other[1]
        if not other[4]:
            weights[other[0]] = weights.get(other[0], 0) + one[1]
    return weights, stars((queries[i][2], answers[j][2]) for i, j in zip(q.tolist(), a.tolist()))


def _linking(cosine: float, plans: dict[int, tuple[int, int]]):
    def make(block: dict, rows: list) -> list[tuple]:
        weights, links = compare(rows, cosine, block["band"], plans[len(rows[0][6]) // 8][0])
        return [(c, w, None, None) for c, w in weights.items()] + [(None, None, a, b) for a, b in links]

    return make


def _grows(frame: DataFrame) -> DataFrame:
    """Marks the side of a join that grows with the corpus: it is never broadcast, so the plan is alike at every size."""
    return frame.hint("merge")


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _slots(count: Column) -> Column:
    return F.ceil(count / BLOCK_ROWS).cast("int")


def _slot(slots: str) -> Column:
    return F.pmod(F.xxhash64("class_id"), F.col(slots)).cast("int")


def _every(slots: str) -> Column:
    return F.sequence(F.lit(0), F.col(slots) - 1)


def _balls(asked: DataFrame, sets: DataFrame, bound: float) -> DataFrame:
    """(class_id, ball): the least center that a class is close to; a center is the least class of a bucket."""
    pairs = stage(asked.select("least", "class_id").distinct(), "pairs")
    spread = stage(pairs.groupBy("least").agg(_slots(F.count("*")).alias("slots")), "spread")
    places = F.when(F.col("class_id") == F.col("least.class_id"), _every("slots")).otherwise(F.array(_slot("slots")))
    dealt = pairs.join(_grows(spread), "least").select("least.first", F.col("least.class_id").alias("center"), F.explode(places).alias("slot"), "class_id")
    block = F.struct("first", F.col("center").alias("class_id"), "slot").alias("block")
    blocks = stage(dealt.select(block, "class_id"), "centers").join(_grows(sets.select("class_id", "unit")), "class_id").select("block", "class_id", "unit")
    schema = pa.schema([(c, pa.int64()) for c in ("class_id", "first", "center")])
    near = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(
        _by_block(["class_id", "unit"], _near_center(bound), schema), "class_id bigint, first bigint, center bigint"
    )
    return stage(near.groupBy("class_id").agg(F.min(F.struct("first", F.col("center").alias("class_id"))).alias("ball")), "balls")


def _between_balls(asked: DataFrame, balled: DataFrame, sets: DataFrame, cosine: float, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """Rows (class_id, weight) of what classes link with outside their ball, and rows (a, b) of nodes whose balls are linked."""
    members = stage(asked.select("key", "band", "class_id").distinct().join(_grows(balled.select("class_id", "copies", "ball")), "class_id"), "members")
    by_ball = members.groupBy("key", "ball").agg(F.count("*").alias("n"))
    split = stage(
        by_ball.groupBy("key")
        .agg(F.max_by("ball", F.struct("n", "ball")).alias("main"), F.max("n").alias("in_main"), F.sum("n").alias("n"), F.count("*").alias("balls"))
        .where("balls > 1")
        .select("key", "main", _slots(F.col("n")).alias("columns"), _slots(F.col("n") - F.col("in_main")).alias("rows")),
        "split",
    )
    still = members.join(_grows(split), "key").withColumn("outside", F.col("ball") != F.col("main"))
    common = ["key", "band", "class_id", "copies", F.col("ball.first").alias("node"), F.col("ball.class_id").alias("ball"), "outside"]
    asking = still.where("outside").select(*common, F.lit(True).alias("asks"), _slot("rows").alias("row"), F.explode(_every("columns")).alias("column"))
    answering = still.select(*common, F.lit(False).alias("asks"), F.explode(_every("rows")).alias("row"), _slot("columns").alias("column"))
    block = F.struct("key", "row", "column", "band").alias("block")
    dealt = stage(asking.unionByName(answering).select(block, "class_id", "copies", "node", "ball", "outside", "asks"), "dealt")
    whole = dealt.join(_grows(sets), "class_id").repartition("block").sortWithinPartitions("block")
    columns = ["class_id", "copies", "node", "ball", "outside", "asks", "unit", "code", "factor"]
    schema = pa.schema([(c, pa.int64()) for c in ("class_id", "weight", "a", "b")])
    return stage(whole.mapInArrow(_by_block(columns, _linking(cosine, plans), schema), "class_id bigint, weight bigint, a bigint, b bigint"), "linked")


def near_vectors(table: DataFrame, cosine: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `table` (vec_id, embedding).

    Rows link if their cosine in double precision is at least `cosine`, above zero; vectors of different lengths never do, and vectors that
    are null, empty, zero, or hold a null or non-finite component link with nothing. n_links counts other rows, equal vectors and
    repeated rows included. A pair is found with a probability of 0.999 at the threshold and more above it; none below it links. component_id is the least id reachable, where rows that share an id are one node. A row without an
    id links with nothing and keeps its own place: component_id null, kept true. Other columns are ignored; an empty table gives no rows.
    """
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.col("vec_id").isNotNull() & _usable(F.col("vector"))
    hashed = rows.select("vec_id", "vector", *(F.when(fine, F.xxhash64(F.lit(i), "vector")).alias(f"h{i}") for i in (1, 2)))
    # Copies meet in the task first, so a frequent vector is one row per task.
    merged = hashed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = stage(merged.select("h1", "h2", "first", "copies", "vector", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("class_id")), "classes")
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    plans = {d: plan_bands(n, d, cosine) for d, n in sizes.items()}
    made = "class_id bigint, first bigint, copies bigint, dims int, unit binary, code binary, factor double, keys array<bigint>"
    sketch = stage(classes.select("class_id", "first", "copies", "dims", "vector").mapInArrow(_sketch(plans), made), "sketch")
    size = table_size(sum(n * plans[d][1] for d, n in sizes.items()), 8, LEAST_CELLS, MOST_CELLS)
    counts = counted(sketch.select("keys"), lambda batch: _cells(batch["keys"].flatten().to_numpy(), size), size, 2)
    met = sketch.select("class_id", "first", "keys").mapInArrow(
        _meeting(table.sparkSession.sparkContext.broadcast(counts), size), "class_id bigint, first bigint, band int, key bigint"
    )
    members = stage(met, "met")
    named = F.struct("first", "class_id")
    buckets = members.groupBy("key").agg(F.min(named).alias("least"), F.max(named).alias("most")).where("least < most")
    asked = stage(members.join(_grows(stage(buckets.select("key", "least"), "buckets")), "key"), "asked")
    sets = sketch.select("class_id", "unit", "code", "factor")
    balls = _balls(asked, sets, math.sqrt((1 + cosine) / 2) + _MARGIN)
    known = classes.select("h1", "h2", "first", "copies", "class_id").join(_grows(balls), "class_id", "left")
    balled = stage(known.withColumn("ball", F.coalesce("ball", F.struct("first", "class_id"))), "balled")
    linked = _between_balls(asked, balled, sets, cosine, plans)
    weights = linked.where("class_id is not null").groupBy("class_id").agg(F.sum("weight").alias("weight"))
    whole = stage(balled.groupBy("ball").agg(F.sum("copies").alias("in_ball"), F.count("*").alias("classes")).where("in_ball > 1"), "whole")
    summed = balled.join(_grows(whole.select("ball", "in_ball")), "ball", "left").join(_grows(stage(weights, "weights")), "class_id", "left")
    n_links = (F.coalesce("in_ball", F.lit(1)) - 1 + F.coalesce("weight", F.lit(0))).alias("n_links")
    located = stage(summed.select("h1", "h2", n_links, F.col("ball.first").alias("node")), "located")
    placed = stage(hashed.select("vec_id", "h1", "h2").join(_grows(located), ["h1", "h2"], "left").drop("h1", "h2"), "placed")
    # A center may lie in the ball of another one, and an id may have several vectors.
    centers = whole.where("classes > 1").select(F.col("ball.class_id").alias("class_id"), F.col("ball.first").alias("a"))
    nested = balled.join(_grows(centers), "class_id").select("a", F.col("ball.first").alias("b"))
    several = placed.where("node is not null").groupBy("vec_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    named_twice = placed.join(_grows(several.select("vec_id")), "vec_id").select(F.col("vec_id").alias("a"), F.col("node").alias("b")).where("b is not null")
    joined = stage(components(linked.where("a is not null").select("a", "b").unionByName(nested).unionByName(named_twice.distinct())), "components")
    found = placed.join(_grows(joined), placed["node"] == joined["node"], "left").select("vec_id", "n_links", F.coalesce("component", placed["node"]).alias("component"))
    # A row that links with nothing shares the place of other rows of its id.
    by_id = stage(found, "found")
    ids = by_id.groupBy("vec_id").agg(F.min("component").alias("of_id"), F.count("*").alias("n")).where("vec_id is not null and n > 1 and of_id is not null")
    final = by_id.join(_grows(stage(ids.select("vec_id", "of_id"), "ids")), "vec_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("of_id", "component", "vec_id"))
    return final.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


ORACLE = """
with recursive u as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as node, vec_id as root from embeddings union select l.y, r.root from r join l on l.x = r.node),
c as (select node, min(root) as component_id from r group by node),
d as (select x, count(*) as n_links from l group by x)
select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept
from embeddings v join c on c.node = v.vec_id left join d on d.x = v.vec_id
"""
