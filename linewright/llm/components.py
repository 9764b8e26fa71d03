"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..staging import stage, tasks_for


def _least(links: DataFrame, tasks: int) -> DataFrame:
    """(u, least): the least smaller neighbour of every node that has one; a table, so that joins with it can be split."""
    return stage(links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("least")), "least", tasks)


def _large_star(links: DataFrame, least: DataFrame, tasks: int) -> DataFrame:
    """Hang the larger neighbours of every node on the least of its neighbours and itself."""
    met = links.join(least.hint("merge"), F.col("b") == F.col("u"), "left")
    return stage(met.select("a", F.coalesce("least", "b").alias("b")).distinct(), "star", tasks)


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    """Hang every node and its smaller neighbours on the least of them."""
    least = _least(links, tasks)
    met = links.join(least.hint("merge"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("least").alias("b"))
    return stage(met.where("a <> b").unionByName(own).distinct(), "star", tasks)


def _state(links: DataFrame) -> tuple:
    one = links.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % (1 << 40)).cast("decimal(38,0)"))).first()
    return tuple(one)


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): the least node reachable over the links (a, b), for every node that has one.

    Links of a node with itself give nothing. Links are kept with a > b, so a node's least neighbour is its least b. Each
    round is two joins on the node, in which every link meets one row; the number of links
    never grows, and the number of rounds grows with the logarithm of a component's size. `most` bounds the number of links, if
    it is known; tables of few links are written by few tasks.
    """
    spark = links.sparkSession
    links = stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", most and tasks_for(spark, most)
    )
    now = _state(links)
    while now[0]:
        tasks = tasks_for(spark, now[0])
        least = _least(links, tasks)
        hung = _large_star(links, least, tasks)
        # Nothing moved and every node has one link: all hang on nodes that hang on none.
        if _state(hung) == now and least.count() == now[0]:
            break
        links = _small_star(hung, tasks)
        now = _state(links)
    pairs = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.unionByName(roots)
