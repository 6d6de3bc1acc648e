"""Shared scratch space and lineage cuts for the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantaloom.scratch import free, materialize, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["free", "materialize", "shared_dir", "table"]
