"""Wide half-hour extracts to tall readings (P1), unpivot (F7), dedup."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvtide.functions.timecols import add_minutes
from pvtide.schema import GEN, SS_ID, TS


def slot_columns(df: DataFrame, prefix: str = "t") -> list[str]:
    """Columns ``<prefix><n>`` (F6); stricter than a prefix match (``tilt``)."""
    pat = re.compile(re.escape(prefix) + r"\d+")
    return [c for c in df.columns if pat.fullmatch(c)]


def dedup(df: DataFrame, keys: list[str], order_by: list | None = None) -> DataFrame:
    """One row per key.

    ``order_by=None`` keeps any row of each key, as the reference's
    ``unique(subset=...)`` does. With ``order_by`` the row with the smallest
    ordering tuple is kept, deterministically. Both forms are hash
    aggregates with map-side partial aggregation, so a hot key is reduced
    in every map task before the shuffle instead of landing whole in one
    task.
    """
    if order_by is None:
        return df.dropDuplicates(keys)
    others = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    kept = df.groupBy(*keys).agg(F.min_by(_struct_of(others), F.struct(*order)).alias("_kept"))
    # One projection for all fields (wide inputs have dozens of columns).
    return kept.selectExpr(*[quote(k) for k in keys], *[f"_kept.{quote(c)} AS {quote(c)}" for c in others])


def quote(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def _struct_of(cols: list[str]):
    """``struct(c1, c2, ...)`` in one expression (one call into the JVM,
    however many columns)."""
    return F.expr("struct(" + ", ".join(quote(c) for c in cols) + ")")


def wide_halfhour_to_tall(wide: DataFrame, prefix: str = "t", minutes: int = 30,
                          deduplicate: bool = True, dedup_order: list | None = None,
                          day_aligned: bool = True) -> DataFrame:
    """Wide day rows with slot columns ``t1..tN`` to tall ``(ss_id, datetime_GMT, generation_Wh)``.

    Slot ``t<k>`` is the energy of the half hour ending ``k * minutes``
    after the row's ``datetime_GMT``: ``t48`` of a day lands on 00:00 of the
    next day (and so in the next month on a month's last day). Slot values
    are cast to one type before unpivoting; rows whose slot is empty keep a
    null reading, as the reference does. The unpivot is a generator in the
    scan's stage (no shuffle).

    Duplicate ``(datetime_GMT, ss_id)`` readings are removed. With
    ``day_aligned`` (the extract's format: ``datetime_GMT`` is a midnight)
    the readings of two different days can never share a time, so removing
    duplicate *wide* rows is exact and shuffles 1/48 of the tall rows; a
    row that is not at midnight fails the job. ``day_aligned=False``
    removes duplicates on the tall rows instead.
    """
    slots = slot_columns(wide, prefix)
    if not slots:
        raise ValueError(f"no slot columns {prefix}<n> in {wide.columns}")
    # Generated projections are SQL expression lists: one call into the JVM
    # each, instead of a few per slot and operator.
    typed = wide.selectExpr(quote(TS), quote(SS_ID),
                            *[f"CAST({quote(c)} AS DOUBLE) AS {quote(c)}" for c in slots])
    if deduplicate and day_aligned:
        ts_type = dict(typed.dtypes)[TS]
        midnight = F.to_date(F.col(TS)).cast(ts_type)
        # A filter that fails instead of dropping: the column itself is not
        # rewritten, so an upstream partitioning on it is reused.
        typed = typed.filter(F.when(F.col(TS) == midnight, F.lit(True)).when(F.col(TS).isNull(), F.lit(True))
                             .otherwise(F.raise_error(F.lit(
                                 "wide extract: datetime_GMT is not a midnight; use day_aligned=False"))
                                 .cast("boolean")))
        if dedup_order is None:
            # Any row of a day: kept whole in a struct, which Spark aggregates by sorting (in
            # the order of ``halfhour_slots_to_wide``), one wide row at a time.
            kept = typed.groupBy(TS, SS_ID).agg(F.first(_struct_of(slots)).alias("_kept"))
            typed = kept.selectExpr(quote(TS), quote(SS_ID), *[f"_kept.{quote(c)} AS {quote(c)}" for c in slots])
        else:
            typed = dedup(typed, [TS, SS_ID], dedup_order)
    # Unpivot with the slot number as a literal per slot (known from the
    # column names), so no row parses a column name.
    pairs = ", ".join(f"named_struct('_slot', {int(c[len(prefix):])}, '{GEN}', {quote(c)})" for c in slots)
    tall = typed.selectExpr(quote(TS), quote(SS_ID), f"inline(array({pairs}))")
    tall = tall.select(
        F.col(SS_ID).cast("int").alias(SS_ID),
        add_minutes(F.col(TS), F.col("_slot") * F.lit(minutes), dict(typed.dtypes)[TS]).alias(TS),
        F.col(GEN).cast("float").alias(GEN))
    if deduplicate and not day_aligned:
        tall = dedup(tall, [TS, SS_ID], dedup_order)
    return tall.select(SS_ID, TS, GEN)


def halfhour_slots_to_wide(readings: DataFrame, prefix: str = "t", minutes: int = 30,
                           value: str = GEN) -> DataFrame:
    """Inverse layout of P1: one row per (day, system), slot k = energy of the
    k-th ``minutes`` interval of that day (left-closed slot, labelled at its end).

    Used to build wide extracts from tall readings: one grouped aggregation
    with a conditional sum per slot, where a pivot would aggregate by slot
    first and shuffle twice. The one shuffle is of the narrow readings; a task
    sorts them and sums one wide row at a time, so its memory does not go
    with the wide rows of all its days and systems.
    """
    n_slots = (24 * 60) // minutes
    day = F.to_date(F.col(TS))
    ts_type = dict(readings.dtypes)[TS]
    slot = (F.floor((F.hour(TS) * 60 + F.minute(TS)) / F.lit(minutes)) + F.lit(1)).cast("int")
    keyed = readings.select(day.cast(ts_type).alias(TS), F.col(SS_ID), slot.alias("_slot"), F.col(value))
    sums = [F.expr(f"sum(CASE WHEN _slot = {k} THEN {quote(value)} END) AS {quote(prefix + str(k))}")
            for k in range(1, n_slots + 1)]
    # A struct among the aggregates lets Spark aggregate by sorting (a hash aggregate holds all
    # groups); it is never null, and the filter keeps it in the plan.
    grouped = keyed.repartition(TS, SS_ID).groupBy(TS, SS_ID).agg(*sums, F.first(F.struct(SS_ID)).alias("_group"))
    return grouped.filter(F.col("_group").isNotNull()).selectExpr(quote(TS), quote(SS_ID), *[quote(prefix + str(k)) for k in range(1, n_slots + 1)])


def unpivot_series(df: DataFrame, index: list[str], variable: str, value: str) -> DataFrame:
    """Unpivot every non-index column (F7); values cast to double first."""
    on = [c for c in df.columns if c not in index]
    typed = df.selectExpr(*[quote(c) for c in index], *[f"CAST({quote(c)} AS DOUBLE) AS {quote(c)}" for c in on])
    return typed.unpivot(index, on, variable, value)
