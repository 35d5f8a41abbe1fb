"""Reading the driver tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir`` (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
