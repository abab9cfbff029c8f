"""Sinks and sources for matrices and run tables: headered CSV (the run
tables' exchange format) and views written once as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into a fresh folder under the shared
    checkpoint directory (``spark.checkpoint.dir``) and read it back.

    For a matrix view derived from a fact table, statistics jobs, bounded
    broadcast probes and the product itself then scan the written matrix
    instead of re-running the aggregation each time, and a lost executor
    re-reads files instead of recomputing the lineage."""
    from tessera.session import shared_dir
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
