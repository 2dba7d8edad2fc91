"""Fitted models on streams.

Every ``transform`` and ``predict`` is a stateless map whose parameters are literals or closures, so a model fitted on a table applies to
an unbounded one as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from blockframe.dsarray import DsArray, from_rows


def apply_to_stream(stream: DataFrame, row_idx: str, features, n_cols: int, method) -> DataFrame:
    """(row_idx, features): ``method`` (such as ``scaler.transform``) of every row of a streaming DataFrame.

    ``row_idx`` labels rows and need not be dense here. Methods that aggregate over rows are refused by Structured Streaming.
    """
    out: DsArray = method(from_rows(stream, row_idx, features, n_rows=0, n_cols=n_cols))
    return out.df.select("row_idx", "features")
