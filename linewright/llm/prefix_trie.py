"""The trie of conversation prefixes, with a count-min screening before anything is grouped.

A prefix of d turns is known by 128 bits: the exclusive or of hashes of its turns and their places. A count-min table over
all prefixes never counts too little, so a prefix with an estimate of one belongs to one conversation, as does
all that follows it: those tails become nodes where they stand. Only the other prefixes are shuffled and grouped exactly.

What a node sums over its subtree is taken from the conversations: the smallest member of a node stands for it, and a
conversation stands for the nodes of its own path from some depth (`rise`) on. So each conversation adds what its nodes
hold to every shared prefix above its rise, and no level of the trie waits for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.numbering import dense_index
from ..staging import stage
from .cells import counted, table_size
from .fingerprints import mixed

GROUP = 5
MOST_BORROWED = 9
PROBES = 4
# Counters of the screening table: 16 a prefix up to 32 MB; beyond that more prefixes are grouped that need not be.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 25
# Turns, and ids of a node's ends, are handled in pieces of so many.
PIECE_BITS = 12
KEY = ["depth", "k1", "k2"]
_EMPTY = hashlib.sha256(b"").hexdigest()
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _grows(frame: DataFrame) -> DataFrame:
    """Marks the side of a join that grows with the corpus: it is never broadcast, so the plan is alike at every size."""
    return frame.hint("merge")


def _piece(place: Column) -> Column:
    return F.shiftright(place, PIECE_BITS)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, size): turns counted from 1 in each conversation, their 128-bit hashes and UTF-8 lengths.

    Texts are hashed where they are read. Turns of equal number stand in order of role and hash.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), role, text).alias("t2"),
        F.octet_length(text).cast("bigint").alias("size"),
        # Tells repeated rows apart, so that a range of equal ones can be cut.
        F.monotonically_increasing_id().alias("row"),
    )
    return dense_index(turns, ["conv_id", "turn", "role", "t1", "t2", "row"]).drop("turn", "role", "row")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turns) and their turns (conv_id, turns, depth, t1, t2, size) after taking over the group's opening."""
    spans = stage(turns.groupBy("conv_id").agg(F.min("index").alias("first"), F.count("*").alias("own")), "spans")
    head = F.col("conv_id") - F.col("conv_id") % GROUP
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED
    lengths = spans.select(F.col("conv_id").alias("head"), F.col("own").alias("there"))
    known = spans.withColumns({"head": head, "asked": asked}).join(_grows(lengths), "head", "left")
    taken = F.least(F.col("asked"), F.coalesce("there", F.lit(0)))
    count = taken + F.greatest(F.col("own") - F.col("asked"), F.lit(0))
    members = stage(known.withColumns({"taken": taken, "turns": count}).drop("there"), "members")
    place = F.col("index") - F.col("first") + 1
    own = turns.join(_grows(members), "conv_id").withColumn("place", place)
    kept = own.where("place > asked").select("conv_id", "turns", (F.col("place") - F.col("asked") + F.col("taken")).alias("depth"), "t1", "t2", "size")
    openings = own.where((F.col("place") < MOST_BORROWED) & (F.col("conv_id") == F.col("head"))).select("head", "place", "t1", "t2", "size")
    borrowed = members.select("conv_id", "turns", "head", "taken").join(_grows(openings), "head").where("place <= taken")
    borrowed = borrowed.select("conv_id", "turns", F.col("place").alias("depth"), "t1", "t2", "size")
    return members.select("conv_id", "turns"), kept.unionByName(borrowed)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, size, is_end): every prefix of one turn or more with its key and its parent's, in order.

    Keys are exclusive ors in two levels, over the turns of a piece and over pieces, so no task holds a conversation.
    """
    placed = turns.withColumn("piece", _piece(F.col("depth"))).withColumns(
        {k: F.xxhash64(F.lit(s), "depth", "t1", "t2") for k, s in (("e1", 3), ("e2", 4))}
    )
    later = placed.groupBy("conv_id", "piece").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = later.select("conv_id", "piece", *(F.bit_xor(x).over(before).alias(x) for x in ("x1", "x2"))).where("x1 is not null")
    within = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    chained = placed.select("conv_id", "turns", "piece", "depth", "e1", "e2", "size", *(F.bit_xor(e).over(within).alias(k) for e, k in (("e1", "k1"), ("e2", "k2"))))
    whole = chained.join(_grows(stage(carried, "carried")), ["conv_id", "piece"], "left").withColumns(
        {k: F.col(k).bitwiseXOR(F.coalesce(x, F.lit(0))) for k, x in (("k1", "x1"), ("k2", "x2"))}
    )
    parent = [F.col(k).bitwiseXOR(F.col(e)).alias(p) for k, e, p in (("k1", "e1", "p1"), ("k2", "e2", "p2"))]
    keyed = whole.select("conv_id", "depth", "k1", "k2", *parent, "size", (F.col("depth") == F.col("turns")).alias("is_end"))
    return keyed.sortWithinPartitions("conv_id", "depth")


def _cells(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The counter of every prefix in each row of the table, one row of cells per probe."""
    k1, k2 = (batch[k].to_numpy().view(np.uint64) for k in ("k1", "k2"))
    width = np.uint64(size // PROBES)
    return np.stack([mixed(k1 + (k2 | np.uint64(1)) * np.uint64(i + 1)) % width + np.uint64(i) * width for i in range(PROBES)]).astype(np.int64)


def _screen(table, size: int):
    """Adds `state` to rows that stand in order of (conv_id, depth): 2 if possibly shared, 1 the first that is not, 0 after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        last, single = None, False
        for batch in batches:
            alone = counts[_cells(batch, size)].min(0) < 2
            ids, depths = batch["conv_id"].to_numpy(), batch["depth"].to_numpy()
            state = np.full(len(ids), 2, np.int32)
            # Runs of one conversation; a run that goes on from the batch before keeps what was proven there.
            starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (depths[1:] != depths[:-1] + 1))))
            for a, b in zip(starts, np.append(starts[1:], len(ids))):
                goes_on = a == 0 and last == (ids[0], depths[0] - 1)
                if goes_on and single:
                    state[a:b] = 0
                    continue
                hit = np.flatnonzero(alone[a:b])
                single = bool(len(hit))
                if single:
                    state[a + hit[0]] = 1
                    state[a + hit[0] + 1 : b] = 0
            if len(ids):
                last = (ids[-1], depths[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state)], names=[*batch.schema.names, "state"])

    return run


def screened(found: DataFrame) -> DataFrame:
    """Prefixes with `state` (see _screen), by a count-min table over all of them."""
    size = table_size(found.count(), 4 * PROBES, LEAST_CELLS, MOST_CELLS)
    counts = counted(found.select("k1", "k2"), lambda batch: _cells(batch, size).reshape(-1), size, 2)
    table = found.sparkSession.sparkContext.broadcast(counts)
    return found.mapInArrow(_screen(table, size), found.withColumn("state", F.lit(0)).schema)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces of ids, read in order as a stream."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *now, ids in zip(*(batch[c].to_pylist() for c in [*KEY, "ids"])):
            if now != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])


def _ends(shared: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which a conversation ends; a node's ids come in pieces of at most 4096."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    pieces = shared.where("is_end").groupBy(*KEY, _piece(F.col("conv_id")).alias("piece")).agg(ids.alias("ids"))
    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return dealt.mapInArrow(_hashed_ends, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def _values(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, below): what the nodes from this one down its own conversation's path save.

    Suffix sums in two levels, over the nodes of a piece of depths and over pieces.
    """
    saved = nodes.select("conv_id", *KEY, ((F.col("n_convs") - 1) * F.col("size")).alias("saved")).withColumn("piece", _piece(F.col("depth")))
    pieces = saved.groupBy("conv_id", "piece").agg(F.sum("saved").alias("later"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = stage(pieces.select("conv_id", "piece", F.sum("later").over(after).alias("later")).where("later is not null"), "later")
    within = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = saved.withColumn("below", F.sum("saved").over(within)).join(_grows(carried), ["conv_id", "piece"], "left")
    return summed.select("conv_id", *KEY, (F.col("below") + F.coalesce("later", F.lit(0))).alias("below"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Takes (conv_id, turn, role, text); other columns are ignored. A conversation is rebuilt as the opening of its group's head
    (conv_id - conv_id % 5), crc32(conv_id) % 9 turns or all if there are fewer, and its own turns after as many. Turns go by
    `turn`, nulls first, equal ones by role and hash of the text; repeated rows all count. A null role or text is empty.
    Rows without a conv_id belong to no conversation and are left out. A conversation without turns is a member of the
    root alone. No conversations: no nodes.
    """
    convs, turns = rebuilt_turns(placed_turns(conversations))
    convs = stage(convs, "convs")
    state = stage(screened(stage(prefixes(turns), "prefixes")), "screened")
    root = convs.select(
        "conv_id", *(F.lit(0).cast("bigint").alias(c) for c in (*KEY, "p1", "p2", "size")), (F.col("turns") == 0).alias("is_end")
    )
    shared = state.where("state = 2").drop("state").unionByName(root)
    nodes = stage(
        shared.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("is_end").alias("n_ends"),
            *(F.min(c).alias(c) for c in ("p1", "p2", "size")),
        ),
        "nodes",
    )
    values = stage(_values(nodes), "values")
    # Per conversation: the depth from which it stands for its path, what its nodes save, whether its end is a leaf.
    standing = nodes.groupBy("conv_id").agg(F.min("depth").alias("rise"), F.max((F.col("n_convs") == F.col("n_ends")).cast("int")).alias("leaf"))
    first = values.groupBy("conv_id").agg(F.max_by("below", F.struct(-F.col("depth"))).alias("saved"))
    tails = state.where("state = 1").groupBy("conv_id").agg(F.min("depth").alias("tail"))
    per_conv = (
        convs.join(_grows(standing), "conv_id", "left").join(_grows(first), "conv_id", "left").join(_grows(tails), "conv_id", "left")
        .select(
            "conv_id", "turns", F.least("rise", "tail").alias("rise"), F.coalesce("saved", F.lit(0)).alias("saved"),
            F.when(F.col("tail").isNotNull(), 1).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf"),
        )
    )
    met = stage(shared.select("conv_id", *KEY), "shared").join(_grows(stage(per_conv, "per_conv")), "conv_id")
    stands = F.coalesce(F.col("rise") <= F.col("depth"), F.lit(False))
    child = (F.col("rise") == F.col("depth") + 1) | (stands & (F.col("turns") > F.col("depth")))
    sums = met.groupBy(*KEY).agg(
        F.count_if(child).alias("n_children"), F.sum("leaf").cast("bigint").alias("n_leaves"),
        F.sum(F.when(stands, 0).otherwise(F.col("saved"))).alias("others"),
    )
    own = values.select(*KEY, "below")
    grouped = (
        nodes.join(_grows(stage(sums, "sums")), KEY).join(_grows(own), KEY).join(_grows(stage(_ends(shared), "ends")), KEY, "left")
        .select(
            "conv_id", *KEY, "p1", "p2", "n_convs", "n_children", "n_leaves", (F.col("others") + F.col("below")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )
    alone = state.where("state < 2").select(
        "conv_id", *KEY, "p1", "p2", F.lit(1).cast("bigint").alias("n_convs"), (~F.col("is_end")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("is_end"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"), "state",
    )
    # Only nodes that may hang on a shared one look for their parent; a parent that was not grouped has the same members.
    hung = stage(grouped.withColumn("state", F.lit(2)).unionByName(alone.where("state = 1")), "hung")
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("over"))
    least = convs.agg(F.min("conv_id").alias("least")).first()["least"]
    deep = hung.where("depth > 1").join(_grows(over), ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("over", "conv_id"))
    top = hung.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).cast("bigint"))
    tail = alone.where("state = 0").withColumn("parent_conv_id", F.col("conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return deep.select(*columns).unionByName(top.select(*columns)).unionByName(tail.select(*columns))


# The checksum is taken bit by bit, as this SQL has no function for it; subtree sums meet each node with all its ancestors.
ORACLE = """
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as i
           from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as head, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
          string_split(conv_id::varchar, ''), lambda x: [256 + ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0, 0]))),
          lambda a, x: case when x >= 256 then xor(a, x - 256) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 9 as h
      from t group by conv_id),
r as (select c.conv_id, 0 as part, i, role, text from c join t on t.conv_id = c.head and i <= h
      union all select c.conv_id, 1, i, role, text from c join t on t.conv_id = c.conv_id and i > h),
s as (select conv_id, list(md5(role || chr(31) || text) order by part, i) as keys, list(strlen(text) order by part, i) as sizes from r group by conv_id),
w as (select c.conv_id, coalesce(keys, []) as keys, coalesce(sizes, []) as sizes from c left join s on s.conv_id = c.conv_id),
p as (select conv_id, unnest(range(0, len(keys) + 1)) as depth, keys, sizes from w),
k as (select conv_id, depth, md5(array_to_string(keys[1:depth], ',')) as k, md5(array_to_string(keys[1:depth - 1], ',')) as up,
             case when depth = 0 then 0 else sizes[depth] end as size, depth = len(keys) as is_end from p),
n as (select depth, k, min(conv_id) as conv_id, min(up) as up, count(*) as n_convs, (count(*) - 1) * min(size) as saved,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends_sha256,
             (count(*) = count(*) filter (is_end))::int as leaf from k group by depth, k),
b as (select a.depth, a.k, sum(x.leaf)::bigint as n_leaves, sum(x.saved)::bigint as saved_tokens, count(*) filter (x.depth = a.depth + 1) as n_children
      from n x join k a on a.conv_id = x.conv_id and a.depth <= x.depth group by all)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
from n join b on b.depth = n.depth and b.k = n.k left join n u on u.depth = n.depth - 1 and u.k = n.up
"""
