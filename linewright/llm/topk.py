"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks; a block's index has one posting segment per dimension and quantised value. A query takes
the segments in descending order of the most that they can add to a score, and keeps for every vector a lower bound and the
number of dimensions still open. It stops when so few vectors can still reach the k-th lower bound that exact rescoring
is cheaper; all of those are rescored, so the result is proven whatever the stopping point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = 16
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 1024
SCALE = 1024
# Bounds are checked after each of these shares of the postings.
_CHECKS = 16


class ImpactIndex:
    """Posting segments of the integer vectors of one block."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, dims = vectors.shape
        low, high = vectors.min(0), vectors.max(0)
        level = ((vectors - low) * LEVELS) // (high - low + 1)
        # Segments in order of dimension and level; a stable sort keeps vectors in order inside.
        segment = (level + np.arange(dims) * LEVELS).T.reshape(-1)
        order = np.argsort(segment, kind="stable")
        self.members = (order % n).astype(np.int32)
        used, self.starts = np.unique(segment[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.dims = used // LEVELS
        values = vectors.T.reshape(-1)[order]
        self.least = np.minimum.reduceat(values, self.starts)
        self.most = np.maximum.reduceat(values, self.starts)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all vectors that can be among the k best, `skip` (a mask) aside."""
        n, dims = self.vectors.shape
        factor = query[self.dims]
        lower = np.minimum(factor * self.least, factor * self.most)
        upper = np.maximum(factor * self.least, factor * self.most)
        floor = np.full(dims, np.iinfo(np.int64).max)
        np.minimum.at(floor, self.dims, lower)
        slack = np.zeros(dims, np.int64)
        np.maximum.at(slack, self.dims, upper - lower)
        # A dimension that adds the same to all, such as one where the query is zero, is settled from the start.
        live = np.zeros(dims, bool)
        np.logical_or.at(live, self.dims, upper > floor[self.dims])
        gain = upper - floor[self.dims]
        order = np.argsort(-gain, kind="stable")
        order = order[live[self.dims[order]]]
        sizes = (self.ends - self.starts)[order]
        total = int(sizes.sum())
        low = np.full(n, float(floor.sum()))
        open_ = np.full(n, float(live.sum()))
        low[skip] = -np.inf
        allowed = n - int(skip.sum())
        possible = ~skip
        done = np.cumsum(sizes)
        at = 0
        for share in range(1, _CHECKS + 1):
            if at == len(order) or allowed <= k:
                break
            to = int(np.searchsorted(done, total * share // _CHECKS, side="left")) + 1
            now = order[at:to]
            at = min(to, len(order))
            members = np.concatenate([self.members[a:b] for a, b in zip(self.starts[now], self.ends[now])])
            lengths = (self.ends - self.starts)[now]
            low += np.bincount(members, np.repeat((lower - floor[self.dims])[now].astype(float), lengths), n)
            open_ -= np.bincount(members, minlength=n)
            most_left = float(gain[order[at]]) if at < len(order) else 0.0
            bar = np.partition(low, n - k)[n - k]
            # What the segments leave open by quantisation, and what open dimensions can add.
            possible = (low + float(slack.sum()) + open_ * most_left >= bar) & ~skip
            if possible.sum() <= max(4 * k, n // 64):
                break
        places = np.flatnonzero(possible)
        return places, self.vectors[places] @ query


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and block.num_rows:
            ids = block["vec_id"].to_numpy()
            index = ImpactIndex(_matrix(block["vector"], block.num_rows))
            vectors = _matrix(queries["vector"], queries.num_rows)
            for query_id, query in zip(queries["vec_id"].to_numpy(), vectors):
                places, scores = index.search(query, k, ids == query_id)
                best = np.lexsort((ids[places], -scores))[:k]
                out.append((np.full(len(best), query_id), ids[places[best]], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def integer_vectors(frame: DataFrame, vector_col: str, scale: int = SCALE) -> Column:
    """floor(scale * x) per component, null for vectors that are null, empty or hold null or non-finite values."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v.cast("double") * scale)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products, ties to the smaller id.

    Both frames hold (vec_id bigint, vector array<bigint>); rows with a null take no part, and a query meets only vectors
    of its own length. A vector with the query's id is its own and left out. Of query rows that share an id the least vector
    asks; repeated vectors all count. Scores are 64-bit integers. Blocks of queries meet blocks of vectors, each a
    bounded group; fewer than k candidates give fewer rows, an empty side none.
    """
    usable = "vec_id is not null and vector is not null"
    vectors = vectors.where(usable).select("vec_id", "vector", F.size("vector").alias("dims"))
    queries = queries.where(usable).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dims", F.size("vector"))
    n_vectors, n_queries = vectors.count(), queries.count()
    blocks, query_blocks = max(1, -(-n_vectors // BLOCK_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "vector", "dims", place(query_blocks).alias("q"), each(blocks).alias("b"))
    held = vectors.select("vec_id", "vector", "dims", place(blocks).alias("b"), each(query_blocks).alias("q"))
    found = asked.groupBy("dims", "q", "b").cogroup(held.groupBy("dims", "q", "b")).applyInArrow(
        _search(k), "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as w from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint as score
      from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 10
"""
