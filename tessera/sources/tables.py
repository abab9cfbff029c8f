"""The provided parquet tables and the matrix views derived from them.

Every view is an ordinary aggregation over a base table, so Catalyst prunes
the scan to the columns used and the views grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_part_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP: supplier x part, total quantity shipped (whole numbers, double)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
              .agg(F.sum("l_quantity").alias("v")))


def supplier_part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC: supplier x part, number of order lines."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
              .agg(F.count(F.lit(1)).alias("v")))


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP before canonicalisation: one (supplier, part, quantity) cell per line,
    so coordinates repeat."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"),
                     F.col("l_quantity").alias("v"))


def part_month_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PM: part x ship month (1..12), revenue in integer cents."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (li.groupBy(F.col("l_partkey").alias("i"),
                       F.month("l_shipdate").cast("bigint").alias("j"))
              .agg(F.sum(cents).cast("bigint").alias("v")))


def part_day_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PD: part x day of the year (1..366) of shipping, number of order lines."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_partkey").alias("i"), F.dayofyear("l_shipdate").cast("bigint").alias("j"))
              .agg(F.count(F.lit(1)).alias("v")))


def _signed_cents() -> Column:
    """Cents of the lines with an even number less those with an odd one."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.sum(F.when(F.col("l_linenumber") % 2 == 0, cents).otherwise(-cents)).cast("double")


def signed_supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CA: supplier x part, signed cents times 1, 2^12 or 2^24 by part; every
    eleventh part has no value."""
    li = table(spark, sf_dir, "lineitem")
    v = _signed_cents() * F.expr("shiftleft(1, cast(12 * (l_partkey % 3) as int))")
    return (li.groupBy(F.col("l_suppkey"), F.col("l_partkey")).agg(v.alias("v"))
              .select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"),
                      F.when(F.col("l_partkey") % 11 != 0, F.col("v")).alias("v")))


def signed_part_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CB: part x ship month, signed cents, those of odd parts divided by 2^10."""
    li = table(spark, sf_dir, "lineitem")
    v = _signed_cents() / F.expr("shiftleft(1, cast(10 * (l_partkey % 2) as int))")
    return (li.groupBy(F.col("l_partkey"), F.month("l_shipdate").cast("bigint").alias("j")).agg(v.alias("v"))
              .select(F.col("l_partkey").alias("i"), "j", "v"))


def hour_day_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HD: hour of day x day of month, number of events."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.hour("ts").cast("bigint").alias("i"), F.dayofmonth("ts").cast("bigint").alias("j"))
              .agg(F.count(F.lit(1)).alias("v")))


def user_hour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UH: user x hour of day, number of events."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("i"), F.hour("ts").cast("bigint").alias("j"))
              .agg(F.count(F.lit(1)).alias("v")))


def quantised_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EQ in coordinate form: one cell per embedding component (dense, signed)."""
    emb = table(spark, sf_dir, "embeddings")
    return (emb.select("vec_id", F.posexplode("embedding").alias("p", "e"))
               .select(F.col("vec_id").alias("i"), F.col("p").cast("bigint").alias("j"),
                       F.floor(F.col("e").cast("double") * 1000).cast("bigint").alias("v")))


# Key column of each table that spans a matrix axis.
AXIS_KEYS = {"supplier": "s_suppkey", "part": "p_partkey", "embeddings": "vec_id"}


def dimension_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Length of a matrix axis: the table's largest key + 1, so keys with gaps
    still fall inside it."""
    return (table(spark, sf_dir, name).agg(F.max(AXIS_KEYS[name])).first()[0] or -1) + 1
