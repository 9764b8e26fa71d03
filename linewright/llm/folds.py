"""Labelled samples of bounded size, without the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most `per_class` rows of each class of the learning folds, and the classes' true counts.

    Rows are taken in order of a hash of the id. Null labels, null ids and contradicting labels of one id are left out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    single = rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    counts = {r["label"]: r["n"] for r in single.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = [single.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return chosen[0].unionByName(chosen[1]), counts


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label): the texts of a sample, which is small enough to broadcast by its bound."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
