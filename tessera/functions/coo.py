"""Coordinate (COO) matrices: ``(i long, j long, v)``, one row per stored cell.

Everything here is a projection, a filter, a keyed join or an aggregation, so
it stays inside whole-stage codegen and partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size thresholds (MB) above which the reference warns that a
# naive product or a broadcast is too large.
NAIVE_WARN_MB = 100
BROADCAST_WARN_MB = 500


def as_coo(df: DataFrame, i="i", j="j", v="v") -> DataFrame:
    """Project any table to the coordinate schema.  Whole numbers become
    bigint, floats double; decimals stay as they are."""
    kind = df.schema[v].dataType.typeName()
    wide = {"byte": "bigint", "short": "bigint", "integer": "bigint", "float": "double"}.get(kind)
    value = F.col(v).cast(wide) if wide else F.col(v)
    return df.select(F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j"), value.alias("v"))


def canonical(df: DataFrame) -> DataFrame:
    """One row per coordinate: repeated coordinates are summed (never last-wins)."""
    return df.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(df: DataFrame) -> DataFrame:
    return df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def prune(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """Keep cells with |v| > eps (drops explicit zeros with eps = 0)."""
    return df.where(F.abs("v") > F.lit(eps))


def mask_zero(df: DataFrame, keep: Column) -> DataFrame:
    """Zero every cell failing ``keep`` and store the result sparsely."""
    masked = df.withColumn("v", F.when(keep, F.col("v")).otherwise(F.lit(0).cast(df.schema["v"].dataType)))
    return masked.where(F.col("v") != 0)


def linear_index(df: DataFrame, ncols: int) -> DataFrame:
    """Row-major linear cell id and its inverse (``cell div ncols``, ``cell % ncols``)."""
    cell = F.col("i") * F.lit(ncols) + F.col("j")
    return (df.select(cell.alias("cell"), "v")
              .select("cell", F.expr(f"cell div {int(ncols)}").alias("i"),
                      F.pmod(F.col("cell"), F.lit(ncols)).alias("j"), "v"))


def stats(df: DataFrame) -> DataFrame:
    """One row: nrows, ncols (max index + 1), nnz, density, sum."""
    return df.agg(
        (F.coalesce(F.max("i"), F.lit(-1)) + 1).alias("nrows"),
        (F.coalesce(F.max("j"), F.lit(-1)) + 1).alias("ncols"),
        F.count(F.lit(1)).alias("nnz"),
        F.sum("v").alias("total"))


def density(df: DataFrame, requested: float) -> DataFrame:
    """nnz / (nrows * ncols), and the cells int(nrows * ncols * requested) that
    a generator asked for density ``requested`` would store."""
    s = stats(df)
    d = F.try_divide(F.col("nnz").cast("double"), (F.col("nrows") * F.col("ncols")).cast("double"))
    return s.select("nrows", "ncols", "nnz", d.alias("density"),
                    F.floor(F.col("nrows") * F.col("ncols") * F.lit(float(requested))).cast("bigint").alias("requested_nnz"))


def size_mb(df: DataFrame) -> DataFrame:
    """Estimated value bytes (8 per stored cell) in MiB and the size warnings."""
    mb = F.col("nnz").cast("double") * 8 / F.lit(1024 * 1024)
    return (df.agg(F.count(F.lit(1)).alias("nnz"))
              .select("nnz", mb.alias("size_mb"),
                      (mb > NAIVE_WARN_MB).alias("naive_warn"),
                      (mb > BROADCAST_WARN_MB).alias("broadcast_warn")))


def matrix_sum(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("v").alias("total"))


def nnz(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("nnz"))


def ewise_mul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hadamard product: cells stored in both inputs.  When both sides come out
    of aggregations keyed on (i, j) the join reuses that partitioning."""
    return (a.alias("a").join(b.alias("b"), ["i", "j"])
              .select("i", "j", (F.col("a.v") * F.col("b.v")).alias("v")))


def ewise_abs_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """sum(|A * B|) — the element-wise L1 total."""
    return ewise_mul(a, b).agg(F.sum(F.abs("v")).alias("total"))


def row_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse dot product of row i of A with row i of B over shared columns,
    for every row: sum_j A[i,j] * B[i,j]."""
    return ewise_mul(a, b).groupBy("i").agg(F.sum("v").alias("dot"),
                                            F.count(F.lit(1)).alias("shared"))
