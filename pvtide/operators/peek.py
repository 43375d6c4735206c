"""First and last rows in a given order.

Both are top-n reports: ``orderBy(...).limit(n)`` plans a per-partition
top-n and a final merge of n rows per partition, so no task sorts the
whole input. Ties are broken by every listed column; list enough columns
for a stable answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvtide.operators.indexing import with_row_index


def _cols(order_by) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def head(df: DataFrame, order_by: list, n: int = 5) -> DataFrame:
    """The first n rows in ``order_by`` (ascending, nulls first)."""
    return df.orderBy(*[c.asc_nulls_first() for c in _cols(order_by)]).limit(n)


def tail(df: DataFrame, order_by: list, n: int = 5) -> DataFrame:
    """The last n rows in ``order_by``, returned in ascending order."""
    last = df.orderBy(*[c.desc_nulls_last() for c in _cols(order_by)]).limit(n)
    return last.orderBy(*[c.asc_nulls_first() for c in _cols(order_by)])


def slice_rows(df: DataFrame, order_by: list, offset: int, length: int,
               top_rows: int = 100_000) -> DataFrame:
    """Rows ``offset .. offset+length-1`` in ``order_by``.

    A slice that ends within the first ``top_rows`` rows is a top-n report
    (each task keeps ``offset + length`` rows). A later one is read from the
    row index of a distributed sort, so no task holds the rows before it.
    """
    if offset + length > top_rows:
        indexed = with_row_index(df, [c.asc_nulls_first() for c in _cols(order_by)], "_pvt_index")
        within = F.col("_pvt_index").between(offset, offset + length - 1)
        return indexed.filter(within).drop("_pvt_index")
    ordered = df.orderBy(*[c.asc_nulls_first() for c in _cols(order_by)])
    return ordered.limit(offset + length).offset(offset)
