"""Column-level matrix functions: canonical form, transpose, pruning, statistics,
estimators and run-table analytics."""
