"""Matrices written once, bucketed by their contraction index, and released.

A product of two stored matrices joins bucket with bucket: neither side is
shuffled on the contraction index again, however often the matrices are used.
A store owns what it writes: leaving its scope drops its tables and deletes
their folders, so a DataFrame that reads them must be used before that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.partitions import COO_ROW_BYTES, pinned_partitions
from tessera.session import shared_dir


class MatrixStore:
    """``with MatrixStore(spark) as s: a = s.put(df, "j"); ...``

    All matrices of a store have the same number of ``buckets``, by default
    the session's shuffle width, or more where ``cells`` cells need more."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, cells: int | None = None):
        self.spark = spark
        width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        # Fewer buckets than the shuffle width, and Spark would shuffle again.
        self.buckets = buckets or (max(width, pinned_partitions(spark, cells * COO_ROW_BYTES)) if cells else width)
        self.held: dict[str, str] = {}

    def put(self, df: DataFrame, key: str, name: str = "matrix") -> DataFrame:
        """``df`` written in buckets of ``key``, one file a bucket, sorted by it."""
        path = shared_dir(self.spark, name)
        table = f"{name}_{uuid.uuid4().hex}"
        self.held[table] = path
        (df.repartition(self.buckets, key).write.format("parquet").option("path", path)
           .bucketBy(self.buckets, key).sortBy(key).saveAsTable(table))
        return self.spark.table(table)

    def materialize(self, df: DataFrame, name: str = "view") -> DataFrame:
        """``df`` written once as it is, for as long as the store's scope."""
        path = shared_dir(self.spark, name)
        self.held[f"{name} {path}"] = path
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Drop the store's tables and delete the folders it wrote."""
        hadoop = self.spark._jsc.hadoopConfiguration()
        for table, path in list(self.held.items()):
            if " " not in table:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)
            del self.held[table]

    def __enter__(self) -> "MatrixStore":
        return self

    def __exit__(self, *error) -> None:
        self.release()
