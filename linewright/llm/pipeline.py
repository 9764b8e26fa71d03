"""The stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import prepare
from ..staging import stage
from . import bpe
from .line_dedup import dedup_lines
from .mixing import mix, training_order
from .near_dedup import near_duplicates
from .quality_classifier import with_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


MIN_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least MIN_QUALITY; it learns from the table `labels`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return with_quality(docs, labels, out_col="__score").where(F.col("__score") >= MIN_QUALITY).drop("__score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document that loses all its lines goes."""
    left = dedup_lines(docs).where("not (n_removed > 0 and n_removed = n_lines)")
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        left = left.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return left.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates by five words and a similarity of 0.8: the document with the least id of a group stays.

    Of rows that share an id one stays, the least by a hash of all columns; rows without an id all stay.
    """
    kept = near_duplicates(docs, width=5).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    some = docs.join(kept.hint("merge"), docs["doc_id"] == kept["kept_id"], "left_semi")
    named = some.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("__row")).select("__row.*")
    return named.unionByName(docs.where(docs["doc_id"].isNull()))


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, sorted by their place in the run."""
    return training_order(docs, mix(docs)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to the very text."""
    encoded = bpe.encode(docs, out_col="token_ids")
    exact = F.col("__decoded") == F.coalesce("text", F.lit(""))
    checked = bpe.decode(encoded, out_col="__decoded").withColumn("round_trip", exact)
    named = [c for c in docs.columns if c not in ("text", "token_ids", "n_tokens", "round_trip")]
    return checked.select(*named, F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "round_trip")


def _prepared(apply: Stage) -> Stage:
    """The stage on a session with the library's settings, small Arrow batches among them."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return apply(prepare(spark), docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _prepared(good_documents)),
    ("line_dedup", _prepared(without_repeated_lines)),
    ("near_dedup", _prepared(one_of_each_group)),
    ("mixing", _prepared(in_training_order)),
    ("bpe", _prepared(encoded)),
]
# The classifier and the tokenizer have no SQL form.
ORACLE_SQL: str | None = None


def run_stages(spark: SparkSession, sf_dir: str, stages: Sequence[tuple[str, Stage]]) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in stages:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
