"""Month calendars (X13-X15) derived from the data's time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvtide.schema import TS


def month_spine(readings: DataFrame, start=None, end=None) -> DataFrame:
    """One row per month from the first to the last reading (or the given
    dates): month start, the previous and the next month's start (as
    timestamps of the input's time type, comparable with ``datetime_GMT``),
    and the Hive keys.

    The bounds are one aggregate row; the spine has as many rows as months.
    """
    ts_type = dict(readings.dtypes)[TS]
    b = readings.agg(F.min(TS).alias("_lo"), F.max(TS).alias("_hi"))
    lo = F.lit(str(start)[:10]).cast("date") if start is not None else F.to_date("_lo")
    hi = F.lit(str(end)[:10]).cast("date") if end is not None else F.to_date("_hi")
    months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("INTERVAL 1 MONTH"))
    spine = b.select(F.explode(months).alias("month_start"))
    return spine.select(
        F.col("month_start").cast(ts_type).alias("month_start"),
        F.year("month_start").cast("smallint").alias("year"),
        F.month("month_start").cast("tinyint").alias("month"),
        F.add_months("month_start", -1).cast(ts_type).alias("prev_month_start"),
        F.add_months("month_start", 1).cast(ts_type).alias("next_month_start"))
