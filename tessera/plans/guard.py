"""Size-checked broadcast.

A side is broadcast only after a count, or a bound the caller proves, shows
that it is under the byte budget; otherwise the plan keeps the shuffle join.
A count is a partial aggregate that moves one row per partition, and on a
written view it reads no columns at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BUDGET = 64 * 1024 * 1024
# Per-row overhead of an UnsafeRow (null bitset + header), bytes.
ROW_OVERHEAD = 16

_FIXED = {T.LongType: 8, T.DoubleType: 8, T.IntegerType: 4, T.FloatType: 4,
          T.ShortType: 2, T.ByteType: 1, T.BooleanType: 1, T.DateType: 4,
          T.TimestampType: 8, T.TimestampNTZType: 8}


def fixed_row_bytes(df: DataFrame) -> int | None:
    """Bytes per row when every column is fixed-width, else None."""
    total = ROW_OVERHEAD
    for f in df.schema.fields:
        w = _FIXED.get(type(f.dataType))
        if w is None:
            return None
        total += 8 if w < 8 else w
    return total


def fits(df: DataFrame, budget: int = DEFAULT_BUDGET) -> bool:
    """True when ``df`` provably fits in ``budget`` bytes."""
    width = fixed_row_bytes(df)
    if width is not None:
        return df.count() * width <= budget
    # Variable-width rows (tiles, arrays): sum the actual payload.
    size = F.lit(ROW_OVERHEAD)
    for f in df.schema.fields:
        w = _FIXED.get(type(f.dataType))
        if w is not None:
            size = size + F.lit(8)
        elif isinstance(f.dataType, (T.BinaryType, T.StringType)):
            size = size + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) + 8
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(F.col(f.name)), F.lit(0)) * 8 + 16
        else:
            size = size + 64
    total = df.agg(F.sum(size).alias("b")).first().b or 0
    return total <= budget


def count_at_most(df: DataFrame, limit: int) -> int | None:
    """Row count of ``df`` if it is <= limit, else None."""
    n = df.count()
    return n if n <= limit else None


def checked_broadcast(df: DataFrame, budget: int = DEFAULT_BUDGET,
                      upper_bound: int | None = None) -> tuple[DataFrame, bool]:
    """``(F.broadcast(df), True)`` if it fits the budget, else ``(df, False)``.

    ``upper_bound`` is a caller-proven byte bound (e.g. from the cell count of
    the coordinate input a tile or row table is built from); when it is within
    the budget the exact probe, which would build ``df`` once more, is skipped.
    """
    if (upper_bound is not None and upper_bound <= budget) or fits(df, budget):
        return F.broadcast(df), True
    return df, False
