"""Mixing sources to target weights with a schedule over the training run.

A source's target is a share of all words by its weight, at most `max_epochs` times its size; what a capped
source can't use is shared again by weight. Each source is read in a fixed random order, as often as its target
asks. Its weight changes linearly over the run; the integral of that weight is its cumulative demand for words, and
the place of a copy in the run is where that demand reaches the copy's place in its source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage

WEIGHTS = (3.0, 1.0, 2.0)
# Weight at the start and at the end of the run, relative to the mean; cycled over the sources like the weights.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
# Ordering buckets per source, so that no window holds a whole source.
BUCKET_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def _cycled(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, rank, target) per source of (source, size).

    With sources in order of the level at which they reach their cap, the level of the others is
    (budget - caps so far) / (weights left); the caps hold for all sources below the level. One row per source is sorted.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", _cycled(F.col("rank"), weights)).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * float(share)
    left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    leveled = weighed.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # The first source that isn't capped fixes the level of all after it.
    final = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(whole)["level"]
    return leveled.select(
        "source",
        "source_size",
        "rank",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight"))).alias("target"),
    )


def _order(doc_id: Column, seed: int) -> Column:
    """60 bits of a digest of seed and id: a fixed random order that other engines can follow."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _bucket(order: Column) -> Column:
    """The leading bits of an order value."""
    return F.shiftright(order, 60 - BUCKET_BITS)


def _position(fraction: Column, start: Column, end: Column) -> Column:
    """The time t in [0, 1] at which a demand that grows from `start` to `end` reaches `fraction` of its total."""
    slope = end - start
    area = fraction * (start + end) / 2
    return F.when(slope == 0, fraction).otherwise((F.sqrt(start * start + 2 * slope * area) - start) / F.when(slope != 0, slope))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    max_epochs: int = 2,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, positions) per row of (doc_id, source, text).

    size counts words; null text has none. Sources in code point order, null last, take the weights in turn.
    A document is taken whole, `copies` times; each source's sum of `taken` misses its target by at most half its
    document at the cut. `positions` holds one place in [0, 1] per copy. The order inside a source is a hash of doc_id
    and seed, so reruns agree; rows alike in doc_id, source and size are interchangeable. Other columns are
    ignored. An empty table gives no rows, and sources without words a target of 0.
    """
    order = _order(F.col("doc_id"), seed)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), order.alias("order")), "sized")
    per_source = targets(sized, weights, share, max_epochs)
    rank = F.col("rank")
    planned = per_source.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        _cycled(rank, [x[0] for x in schedules]).alias("start"),
        _cycled(rank, [x[1] for x in schedules]).alias("end"),
    )
    bucket = _bucket(F.col("order")).alias("bucket")
    sums = sized.groupBy("source", bucket).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    # One row per source and bucket: all a document needs to know of the others.
    plan = stage(offsets.join(planned.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t"), "plan")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(
        sized.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))), "placed"
    )
    met = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    at = F.col("offset") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = ((F.col("at") + F.col("size") / 2) <= F.col("rest")).cast("bigint")
    counted = (
        met.withColumn("at", at)
        .withColumn("whole", whole)
        .withColumn("rest", rest)
        .withColumn("copies", F.when(F.col("size") > 0, F.least(F.col("whole") + extra, F.lit(max_epochs))).otherwise(F.least(F.col("whole"), F.lit(1))).cast("int"))
    )
    reached = lambda copy: F.least(
        (copy * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.col("target"), F.lit(1.0)
    )
    positions = F.when(
        F.col("copies") > 0,
        F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda copy: _position(reached(copy), F.col("start"), F.col("end"))),
    ).otherwise(F.array().cast("array<double>"))
    return counted.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        positions.alias("positions"),
    )


def training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as `mixed` takes its id, range-sorted by place in the run.

    Rows of `docs` with the same id, or without one, take the same places.
    """
    places = stage(
        mixed.where("copies > 0")
        .groupBy("doc_id")
        .agg(F.max("positions").alias("positions"))
        .select(F.col("doc_id").alias("__id"), F.explode("positions").alias("__position")),
        "places",
    )
    joined = docs.join(places.hint("merge"), docs["doc_id"].eqNullSafe(places["__id"]))
    return joined.orderBy("__position", "__id").drop("__position", "__id")


ORACLE = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
                  ('0x' || substr(md5('0:' || doc_id), 1, 15))::bigint as place from documents),
z as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from z),
w as (select *, [3.0::double, 1.0::double, 2.0::double][rank % 3 + 1] as weight, source_size * 2.0::double as cap,
             [1.5::double, 1.0::double, 0.5::double][rank % 3 + 1] as a, [0.5::double, 1.0::double, 1.5::double][rank % 3 + 1] as b from r),
l as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
             / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from w),
f as (select *, level * weight >= cap as capped from l),
t as (select *, case when capped then cap else least(cap, weight * (select arg_min(level, (cap / weight, rank)) from f where not capped)) end as target from f),
o as (select d.*, source_size, target, a, b,
             coalesce(sum(size) over (partition by d.source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on t.source is not distinct from d.source),
c as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from o),
k as (select *, case when size > 0 then least(whole + (before + size / 2 <= target - whole * source_size)::bigint, 2) else least(whole, 1) end as copies from c),
p as (select *, least((before + size / 2) / target, 1.0::double) as reached from k)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies::int as copies,
       case when copies > 0 then case when a = b then reached else (sqrt(a * a + 2 * (b - a) * (reached * (a + b) / 2)) - a) / (b - a) end end as first_position
from p
"""
