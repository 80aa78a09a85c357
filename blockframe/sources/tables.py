"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """{name: DataFrame} of the folder's Parquet tables, as assemble() takes them."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
