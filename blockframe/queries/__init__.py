"""Registered queries of the core engine with their DuckDB equivalents."""

from blockframe.queries import arrays, estimators, files, rows

QUERIES = {**rows.QUERIES, **arrays.QUERIES, **estimators.QUERIES, **files.QUERIES}
ORACLES = {**rows.ORACLES, **arrays.ORACLES, **estimators.ORACLES, **files.ORACLES}
