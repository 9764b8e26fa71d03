"""The corpus pipeline: stages that each apply one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linewright.llm.pipeline import ORACLE_SQL, STAGES, run_stages

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each written as Parquet and read again."""
    return run_stages(spark, sf_dir, STAGES)
