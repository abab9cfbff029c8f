"""Sums of products of whole numbers that may pass a bigint.

A sum of bigint products is a bigint, and Spark raises an error where it does
not fit.  :func:`may_overflow` bounds the sums from the two sides before any
product is made; where the bound passes 2^63 the products are summed as
decimal(38,0), and :func:`narrowed` gives the sums back as bigint if each of
them fits.  So v is a bigint wherever a bigint holds the result, and
decimal(38,0) where it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.files import materialize

LIMIT = 1 << 63
# Relative error that the bounds, sums of doubles, stay below.
SLACK = 1e-6
WHOLE = ("long", "integer", "short", "byte")


def _norm(side: DataFrame, row: str, key: str, v: str) -> float:
    """The largest Euclidean length of a row, repeated cells added up."""
    cells = side.groupBy(row, key).agg(F.sum(F.abs(F.col(v).cast("double"))).alias("s"))
    longest = cells.groupBy(row).agg(F.sum(F.col("s") * F.col("s")).alias("s")).agg(F.max("s")).first()[0]
    return (longest or 0.0) ** 0.5


def may_overflow(left: DataFrame, right: DataFrame, same: bool = False) -> bool:
    """Whether a sum over k of products of ``left`` (i, k, av) and ``right``
    (j, k, bv) may not fit a bigint.  ``same``: both are the same matrix.

    The sums of all values are tried first, in one pass over each side; then
    the longest rows (Cauchy-Schwarz), in a partial aggregation of each."""
    if not {left.schema["av"].dataType.typeName(), right.schema["bv"].dataType.typeName()} <= set(WHOLE):
        return False
    most = LIMIT * (1 - SLACK)

    def total(side: DataFrame, v: str) -> float:
        return side.agg(F.sum(F.abs(F.col(v).cast("double")))).first()[0] or 0.0
    a = total(left, "av")
    if a * (a if same else total(right, "bv")) < most:
        return False
    a = _norm(left, "i", "k", "av")
    return a * (a if same else _norm(right, "j", "k", "bv")) >= most


def product(a: Column, b: Column) -> Column:
    """a * b of whole numbers, as decimal(38,0)."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def narrowed(sums: DataFrame) -> DataFrame:
    """``sums`` written once, with v as bigint if every value fits."""
    sums = materialize(sums, "wide-sums")
    r = sums.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if r.lo is None or (-LIMIT <= r.lo and r.hi < LIMIT):
        return sums.withColumn("v", F.col("v").cast("bigint"))
    return sums
