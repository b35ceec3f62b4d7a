"""Reading the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.workspace import ship_package


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """`base/name.parquet`, narrowed to `columns` if any are given (pruned in the scan). Ships the package to the workers."""
    ship_package(spark)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return df.select(*columns) if columns else df
