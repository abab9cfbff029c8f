"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# Documents, sets and vectors are long rows: an Arrow batch of so many is a
# few megabytes, where the default number would be a large part of a worker.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most BATCH_ROWS rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    n = int(conf.get(key, "10000"))
    if n <= 0 or n > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def hand_back() -> None:
    """Give the system back what earlier tasks of this Python worker freed:
    workers live on from task to task, and the allocators keep such memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # only glibc has it
    if trim is not None:
        trim(0)


def strings(column: pa.Array) -> list:
    """The texts of an Arrow column; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return [None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()]


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet folder below ``spark.checkpoint.dir``
    and read it back: cuts lineage, survives lost executors, and gives later
    joins a side whose size Spark knows."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def crc_of(c: Column) -> Column:
    """Unsigned crc32 of a value written as text (null for null)."""
    return F.crc32(c.cast("string").cast("binary"))


def gapless_rank(df: DataFrame, key: Sequence[str], order: Sequence[Column], out: str,
                 rows: int | None = None) -> DataFrame:
    """Number the rows of each ``key`` 0, 1, 2, ... without gaps, however few
    keys there are and however many rows one of them holds.

    Rows are dealt to buckets by a hash of ``order`` and ranked inside
    (key, bucket); the counts per (key, bucket), which are few, give each
    bucket's first number.  ``order`` must tell rows apart for a repeatable
    result; rows that are equal in it get the numbers in any order."""
    from pyspark.sql import Window as W
    n = df.count() if rows is None else rows
    buckets = max(1, math.isqrt(n))     # as many rows a bucket as buckets
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    at = [*key, "_b"]
    counts = b.groupBy(*at).agg(F.count("*").alias("_c"))
    first = counts.withColumn(
        "_first", F.sum("_c").over(W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    first = first.select(*at, F.coalesce("_first", F.lit(0)).alias("_first"))
    local = F.row_number().over(W.partitionBy(*at).orderBy(*order)) - 1
    cond = None
    f = first.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], "_first")
    for i, c in enumerate(at):
        e = F.col(c).eqNullSafe(F.col(f"_k{i}"))
        cond = e if cond is None else cond & e
    ranked = b.withColumn("_local", local)
    return (ranked.join(f, cond)
            .withColumn(out, (F.col("_local") + F.col("_first")).cast("long"))
            .select(*df.columns, out))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), the
    component being its smallest node.  Only nodes with an edge appear.

    Minimum labels spread over the edges, hook the roots of both ends and
    jump pointers, so the number of rounds grows with the logarithm of the
    longest path.  Labels are written each round; a hub's edges are summed
    up before the shuffle."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = durable(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    f = durable(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f")), "cc-labels")
    for _ in range(rounds):
        up = f.select(F.col("u").alias("r"), F.col("f").alias("g"))
        jumped = f.join(up, F.col("f") == F.col("r")).select("u", "f", "g")
        jumped = durable(jumped, "cc-jumped")
        near = (e.join(jumped.select(F.col("u").alias("n"), "g"), F.col("v") == F.col("n"))
                .groupBy("u").agg(F.min("g").alias("m")))
        seen = near.join(jumped, "u")
        offers = seen.select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.least("f", "g", "m").alias("f")),
            F.struct(F.col("f").alias("u"), F.least("m", "g").alias("f")))).alias("o")).select("o.u", "o.f")
        new = durable(offers.groupBy("u").agg(F.min("f").alias("f")), "cc-labels")
        moved = new.join(f.select("u", F.col("f").alias("was")), "u").where("f <> was").limit(1).count()
        f = new
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return f.select(F.col("u").alias("node"), F.col("f").alias("component"))
