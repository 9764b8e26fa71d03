"""Template keys, first-appearance group ids and template statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.signature import token_signature
from ..staging import stage
from .numbering import rank_by_first_index

# Method name -> template of a normalized line, in report order.
METHODS: dict[str, Callable[[Column], Column]] = {
    "normalized_identity": lambda normalized: normalized,
    "token_pattern": token_signature,
}

# The most frequent keys are joined by broadcast. A table of this many rows is bounded, and
# no key outside it can hold more than 1/_HOT_KEYS of all lines.
_HOT_KEYS = 1000


def template_counts(lines: DataFrame, template: str = "template", index: str = "index") -> DataFrame:
    """Lines and first index per template."""
    return lines.groupBy(template).agg(
        F.count("*").alias("lines"), F.min(index).alias("first_index")
    )


def group_name(rank: Column) -> Column:
    return F.concat(F.lit("group_"), F.lpad(rank.cast("string"), F.greatest(F.length(rank.cast("string")), F.lit(3)), F.lit("0")))


def template_key(template: Column) -> Column:
    """128 bits that stand for a template in joins and groups, however long its text."""
    return F.unhex(F.md5(template.cast("binary")))


def ranked_keys(lines: DataFrame, key: str = "_key", index: str = "index") -> DataFrame:
    """One row per template key with its size and its rank by first appearance; one pass over two narrow columns."""
    counts = stage(template_counts(lines.select(key, index), key, index), "templates")
    return rank_by_first_index(counts)


def assign_groups(lines: DataFrame, template: str = "predicted_template", index: str = "index") -> DataFrame:
    """Add `predicted_group_id`, numbered by first appearance of the template.

    Lines of the most frequent templates get their id from a broadcast table of fixed size (keys of 16
    bytes) and are never shuffled; the others, none of which is frequent, go through a join on the key.
    """
    keyed = lines.withColumn("_key", template_key(F.col(template)))
    ranked = ranked_keys(keyed)
    ids = ranked.select("_key", group_name(F.col("rank")).alias("predicted_group_id"))
    hot = ranked.orderBy(F.desc("lines"), "first_index").limit(_HOT_KEYS).select("_key", group_name(F.col("rank")).alias("predicted_group_id"))
    frequent = keyed.join(F.broadcast(hot), "_key")
    others = keyed.join(F.broadcast(hot.select("_key")), "_key", "left_anti").join(ids, "_key")
    return frequent.unionByName(others).drop("_key")


def name_groups(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Replace the template keys in `predicted_group_id` of a few rows by group ids.

    `cells` is the contingency table of one method, keyed the same way. `rows` are as few as the caller asked examples for.
    """
    firsts = cells.groupBy("predicted_group_id").agg(F.min("first_index").alias("first_index"))
    ranks = rank_by_first_index(firsts).select("predicted_group_id", group_name(F.col("rank")).alias("_name"))
    named = ranks.join(F.broadcast(rows.select("predicted_group_id").distinct()), "predicted_group_id")
    return rows.join(named, "predicted_group_id").drop("predicted_group_id").withColumnRenamed("_name", "predicted_group_id")


def with_templates(lines: DataFrame) -> DataFrame:
    """Add one template column per method to normalized lines."""
    return lines.select(
        "*", *[template(F.col("normalized_text")).alias(name) for name, template in METHODS.items()]
    )


def predict(lines: DataFrame, method: str) -> DataFrame:
    """Predictions of one method; `lines` carry a template column of that name."""
    named = lines.drop(*[m for m in METHODS if m != method]).withColumnRenamed(method, "predicted_template")
    return assign_groups(named).withColumn("method", F.lit(method))


def keyed_methods(lines: DataFrame) -> DataFrame:
    """Lines once per method with `predicted_template` and its key as `predicted_group_id`: all that scores need.

    Keys stand for groups one to one; nothing is joined or moved.
    """
    rest = [c for c in lines.columns if c not in METHODS]
    parts = [
        lines.select(
            F.lit(method).alias("method"), *rest, template_key(F.col(method)).alias("predicted_group_id"), F.col(method).alias("predicted_template")
        )
        for method in METHODS
    ]
    first, *others = parts
    for other in others:
        first = first.unionByName(other)
    return first


def predict_all(lines: DataFrame) -> DataFrame:
    """Predictions of every method, told apart by `method`."""
    first, *others = [predict(lines, method) for method in METHODS]
    for other in others:
        first = first.unionByName(other)
    return first
