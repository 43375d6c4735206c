"""Scalar Column helpers (JVM-side expressions only)."""

from pvtide.functions.hexgrid import hex_cell
from pvtide.functions.nan import drop_nans, nan_max, not_nan
from pvtide.functions.timecols import (
    add_days,
    add_minutes,
    first_of_month,
    half_hours_between,
    lit_ts,
    micros_between,
    midnight_keep_minutes,
    month_dir_value,
    month_key,
    partition_month_start,
    right_closed_end,
    ts_literal,
    year_key,
)

__all__ = [
    "add_days", "add_minutes", "drop_nans", "first_of_month", "half_hours_between",
    "hex_cell", "lit_ts", "micros_between", "midnight_keep_minutes", "month_dir_value",
    "month_key", "nan_max", "not_nan", "partition_month_start",
    "right_closed_end", "ts_literal", "year_key",
]
