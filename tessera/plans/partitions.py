"""Partition counts for repartitions pinned against AQE coalescing.

Compute-heavy joins (tile pairs, salted hot keys, row-partitioned products)
read little data for the work they do, so AQE's byte-based coalescing would
fold them into a few tasks; they repartition with an explicit count instead.
That count must cover both the cores (parallelism) and the data volume
(memory per task): at least four partitions per core and the session's shuffle
width, and at least one partition per ``spark.sql.adaptive.advisoryPartitionSizeInBytes``
of input, so a 10 TB side gets ~10^5 partitions, not one per core.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

DEFAULT_PARTITION_BYTES = 64 * 1024 * 1024
# Bytes of one coordinate row (i, j, v) in a shuffle, with row overhead.
COO_ROW_BYTES = 40


def _bytes_conf(spark: SparkSession, key: str, default: int) -> int:
    raw = spark.conf.get(key, None)
    if not raw:
        return default
    s = raw.strip().lower()
    for suffix, mult in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10),
                         ("m", 1 << 20), ("g", 1 << 30), ("b", 1)):
        if s.endswith(suffix):
            return int(float(s[: -len(suffix)]) * mult)
    return int(s)


def partition_bytes(spark: SparkSession) -> int:
    return _bytes_conf(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", DEFAULT_PARTITION_BYTES)


def pinned_partitions(spark: SparkSession, data_bytes: int | None = None) -> int:
    """Partitions for a pinned repartition of ``data_bytes`` (when known)."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    if data_bytes:
        n = max(n, math.ceil(data_bytes / partition_bytes(spark)))
    return n
