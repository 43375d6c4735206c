"""NaN rules of the reference: NaN and null are different missing values.

* dropping NaN keeps null rows (``~isnan(null)`` is true);
* ``max``/``min`` skip NaN (Spark would return NaN, which sorts last);
* mean skips null and propagates NaN, as Spark's ``avg`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def not_nan(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return ~F.isnan(col) | col.isNull()


def drop_nans(df: DataFrame, subset=None) -> DataFrame:
    """Remove rows with NaN in any float column (F20); nulls stay."""
    cols = subset or [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOATS)]
    cond = None
    for c in cols:
        cond = not_nan(c) if cond is None else cond & not_nan(c)
    return df if cond is None else df.filter(cond)


def nan_max(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.max(F.when(~F.isnan(col), col))

