"""tessera: matrices as Spark DataFrames.

A sparse matrix is a DataFrame ``(i long, j long, v)`` with one row per stored
cell.  Products, Gram matrices, element-wise products, pruning, checksums and
density statistics are joins and aggregations planned by Catalyst/AQE.  Dense
work goes through tiles: ``(bi, bj, nrows, ncols, idx, val)`` packed per block
and multiplied with NumPy inside Arrow-batched tasks.
"""

from tessera.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
