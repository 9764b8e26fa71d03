"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, collocations, embedding_dedup, line_dedup, lm_scoring, mixing, pii, prefix_trie, quality_classifier, quality_rules, topk, toxicity
from .near_dedup import ORACLE as NEAR_ORACLE
from .near_dedup import near_duplicates

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality_rules.clean_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.drop("text", "clean_text")


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _predicted(quality_classifier.score_quality(documents(spark, sf_dir), labels), 0.3)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _predicted(toxicity.score_toxicity(documents(spark, sf_dir), labels), 0.5)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    first = F.get("positions", F.lit(0)).alias("first_position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", first).orderBy("first_position", "doc_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    digested = encoded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "token_ids")
    return bpe.decode(digested).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select("vec_id", topk.integer_vectors(table, "embedding").alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_near_dedup": op3_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_top_k": op8_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
    "op11_collocations": op11_collocations,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_near_dedup": NEAR_ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_top_k": topk.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_embedding_dedup": embedding_dedup.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
