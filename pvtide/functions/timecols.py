"""Time expressions as JVM-side ``Column`` math (no UDFs).

Every helper works on ``timestamp`` and ``timestamp_ntz`` alike and keeps
the input's type.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _one_micro() -> Column:
    return F.expr("INTERVAL '0.000001' SECOND")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# For ``timestamp`` (instants) Spark adds day-time intervals and measures
# ``timestampdiff``/``end - start`` in wall-clock time of the session zone:
# across a DST change "7 days" is 7 days +- 1 hour. The reference adds and
# measures exact durations, so for instants the helpers below work on epoch
# microseconds (pass ``ts_type``). ``timestamp_ntz`` arithmetic is zone-free.

def _add_micros(ts, micros: Column, ts_type: str | None) -> Column:
    if ts_type == "timestamp":
        return F.timestamp_micros(F.unix_micros(_c(ts)) + micros)
    return _c(ts) + F.expr("INTERVAL '0.000001' SECOND") * micros


def add_minutes(ts, minutes, ts_type: str | None = None) -> Column:
    """``ts + minutes`` (X4/X11), an exact duration; ``minutes`` may be a column."""
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    if ts_type == "timestamp":
        return _add_micros(ts, m.cast("bigint") * F.lit(60_000_000), ts_type)
    return _c(ts) + F.expr("INTERVAL '1' MINUTE") * m.cast("bigint")


def add_days(ts, days, ts_type: str | None = None) -> Column:
    """``ts + days`` of 24 hours each."""
    d = days if isinstance(days, Column) else F.lit(days)
    if ts_type == "timestamp":
        return _add_micros(ts, d.cast("bigint") * F.lit(86_400_000_000), ts_type)
    return _c(ts) + F.expr("INTERVAL '1' DAY") * d.cast("bigint")


def right_closed_end(ts, every: str = "30 minutes") -> Column:
    """Label of the right-closed window ``(end - every, end]`` holding ts.

    Spark's ``window`` is left-closed; shifting by one microsecond (the
    timestamp resolution) turns ``[a, b)`` into ``(a, b]``.
    """
    return F.window(_c(ts) - _one_micro(), every).end


def midnight_keep_minutes(ts) -> Column:
    """Hour set to 0, minutes and seconds kept (X18, ``replace(hour=0)``)."""
    return _c(ts) - F.make_dt_interval(hours=F.hour(_c(ts)))


def first_of_month(d) -> Column:
    """First day of the month of a date or timestamp, as a date."""
    return F.trunc(F.to_date(_c(d)), "month")


def month_key(ts) -> Column:
    """Hive month key as a number (tinyint)."""
    return F.month(_c(ts)).cast("tinyint")


def year_key(ts) -> Column:
    return F.year(_c(ts)).cast("smallint")


def month_dir_value(ts) -> Column:
    """Zero-padded month for ``month=MM`` folder names."""
    return F.date_format(_c(ts), "MM")


def partition_month_start(year="year", month="month") -> Column:
    """``date(year, month, 1)`` of the Hive keys (X7); prunes partitions."""
    return F.make_date(_c(year).cast("int"), _c(month).cast("int"), F.lit(1))


def micros_between(start, end, ts_type: str | None = None) -> Column:
    """Exact duration from start to end in microseconds."""
    if ts_type == "timestamp":
        return F.unix_micros(_c(end)) - F.unix_micros(_c(start))
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def micros_since_epoch(ts, ts_type: str | None = None) -> Column:
    """Microseconds since 1970-01-01 00:00 (of the zone-less clock for ``timestamp_ntz``)."""
    if ts_type == "timestamp":
        return F.unix_micros(_c(ts))
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def half_hours_between(start, end, minutes: int = 30, ts_type: str | None = None) -> Column:
    """``int(duration / 30 min)`` for a non-negative duration."""
    return F.floor(micros_between(start, end, ts_type) / F.lit(60_000_000 * minutes)).cast("bigint")


def ts_literal(value, ts_type: str = "timestamp") -> Column:
    """A time literal of the given type (``timestamp`` or ``timestamp_ntz``)
    from a ``datetime``/``date``/ISO string, or a Column passed through.

    Built from the ISO text, so a zone-less value stays zone-less and a
    ``timestamp`` value is read in the session time zone; no Python-side
    time zone conversion is involved.
    """
    if isinstance(value, Column):
        return value.cast(ts_type)
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ") if value.tzinfo is None else value.isoformat()
    elif isinstance(value, dt.date):
        text = value.isoformat() + " 00:00:00"
    else:
        text = str(value)
    return F.lit(text).cast(ts_type)


def lit_ts(value, ntz: bool = False) -> Column:
    """A timestamp literal; ``ntz`` for zone-less data."""
    return ts_literal(value, "timestamp_ntz" if ntz else "timestamp")
