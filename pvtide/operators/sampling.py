"""Training-style access: many sampled time windows fetched in one job (P13),
and the readings around outliers (P15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvtide.functions.timecols import (
    add_days,
    add_minutes,
    first_of_month,
    half_hours_between,
    micros_between,
    micros_since_epoch,
    midnight_keep_minutes,
    partition_month_start,
    ts_literal,
)
from pvtide.operators.sizing import DEFAULT_BROADCAST_ROWS, reliable_checkpoint
from pvtide.schema import END, MONTH, SS_ID, START, TS, YEAR

_BUCKET = "_pvt_bucket"
W_START = "window_start"
W_END = "window_end"
DRAW = "draw"


def sample_systems(ids: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """``n`` systems without replacement, reproducible for a seed.

    The limit is the sampling itself; ``orderBy(...).limit(n)`` plans a
    per-partition top-n, so no task holds more than n ids. ``n=None`` keeps
    every system.
    """
    ids = ids.select(SS_ID).distinct()
    return ids if n is None else sample_rows(ids, n, seed)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = SS_ID) -> DataFrame:
    """``n`` whole rows of a frame with one row per ``key`` (for example one
    window per system), in the same seeded order as ``sample_systems``: the
    same systems are chosen, without a distinct or a join."""
    return df.orderBy(_draw(F.col(key), 0, seed), F.col(key)).limit(n)


def _draw(key: Column, draw, seed: int) -> Column:
    """A draw as 32 hexadecimal digits: MD5 of ``key:draw:seed``, so that
    other seeds and draws are unrelated and SQL can repeat it."""
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    return F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string"), F.lit(str(seed))).cast("binary"))


def _bound_columns(bounds, ts_type: str) -> tuple:
    """``(min, max)`` as typed literals. A one-row frame is evaluated once
    (one job, one row to the driver): referenced as a scalar subquery it
    would be re-planned at each of its four uses, and each copy can rescan
    the readings."""
    if isinstance(bounds, DataFrame):
        lo_name, hi_name = bounds.columns[:2]
        row = bounds.select(exact_time(F.col(lo_name).cast(ts_type), ts_type),
                            exact_time(F.col(hi_name).cast(ts_type), ts_type)).first()
        lo, hi = (None, None) if row is None else row
        if lo is None or hi is None:
            return F.lit(None).cast(ts_type), F.lit(None).cast(ts_type)
        return _exact_literal(lo, ts_type), _exact_literal(hi, ts_type)
    lo, hi = bounds
    return ts_literal(lo, ts_type), ts_literal(hi, ts_type)


def sample_windows(metadata: DataFrame, bounds, days: int = 7, seed: int = 42,
                   minutes: int = 30, full_only: bool = False, draws: int = 1,
                   n: int | None = None) -> DataFrame:
    """``draws`` random windows of ``days`` per system, or ``n`` of them in
    total, each starting on a ``minutes`` slot (P13).

    As the reference: systems must overlap the dataset bounds, their active
    span is clipped to them and must be longer than ``days``; the start is
    slot ``k`` of that span, ``k`` in ``[0, n)`` with ``n`` whole slots.
    ``k`` is 60 bits of the MD5 of system, draw and seed, modulo ``n``, so
    a run can be repeated (and checked by SQL). A window may run past the
    span's end, as in the reference; ``full_only`` keeps it inside. Column
    ``draw`` counts a system's windows from 0; ``n`` keeps the windows whose
    MD5 comes first (a top-n, as ``sample_rows``).

    ``bounds``: a one-row ``(min, max)`` frame (evaluated once; its one row
    comes to the driver as exact literals) or a ``(min, max)`` pair of
    Python values. Durations are exact for zone-aware timestamps too.
    """
    ts_type = dict(metadata.dtypes)[START]
    lo_c, hi_c = _bound_columns(bounds, ts_type)
    clipped = (metadata
               .filter((F.col(START) < hi_c) & (F.col(END) > lo_c))
               .select(F.col(SS_ID),
                       F.greatest(F.col(START), lo_c).alias("clipped_start"),
                       F.least(F.col(END), hi_c).alias("clipped_end")))
    long_enough = (micros_between("clipped_start", "clipped_end", ts_type)
                   > F.lit(days * 86_400_000_000))
    clipped = clipped.filter(long_enough)
    n_slots = half_hours_between("clipped_start", "clipped_end", minutes, ts_type)
    if full_only:
        n_slots = n_slots - F.lit(days * 24 * 60 // minutes) + F.lit(1)
    drawn = (clipped.withColumn("n_slots", n_slots).filter("n_slots > 0")
             .withColumn(DRAW, F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))))
    digest = _draw(F.col(SS_ID), F.col(DRAW), seed)
    if n is not None:
        drawn = drawn.orderBy(digest, SS_ID, DRAW).limit(n)
    k = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.col("n_slots"))
    start = add_minutes(F.col("clipped_start"), k * F.lit(minutes), ts_type)
    return (drawn.select(SS_ID, DRAW, start.alias(W_START))
            .withColumn(W_END, add_days(F.col(W_START), days, ts_type)))


# The most windows a caller may turn into literal predicates.
MAX_LITERAL_WINDOWS = 100
# Spark turns an IN filter of at most this many values into exact Parquet
# predicates (spark.sql.parquet.pushdown.inFilterThreshold); above it, a range.
SCAN_ID_LIST_MAX = 10


def exact_time(c, ts_type: str) -> Column:
    """A time column in a form that survives the trip to the driver exactly:
    epoch microseconds for ``timestamp`` (no zone or DST ambiguity), the
    zone-free text for ``timestamp_ntz``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col) if ts_type == "timestamp" else col.cast("string")


def _exact_literal(v, ts_type: str) -> Column:
    if ts_type == "timestamp":
        return F.timestamp_micros(F.lit(v))
    return ts_literal(v, ts_type)


def _window_stats(win: DataFrame, ts_type: str):
    """One job over the (materialised) windows: their count, overall time
    range, id range, distinct id count and longest duration."""
    return win.agg(F.count(F.lit(1)).alias("n"), F.min(exact_time(W_START, ts_type)),
                   F.max(exact_time(W_END, ts_type)), F.min(SS_ID), F.max(SS_ID),
                   F.countDistinct(SS_ID), F.max(micros_between(W_START, W_END, ts_type))).first()


def _scan_filter(win: DataFrame, stats, ts_type: str) -> Column:
    """Literal predicates for the readings scan from a bounded window set:
    their ids and overall time range. On files sorted by (ss_id, datetime_GMT)
    Parquet statistics then skip the row groups of every other system."""
    _, lo, hi, id_lo, id_hi, n_ids, _ = stats
    if lo is None:
        return F.lit(False)
    cond = F.col(TS).between(_exact_literal(lo, ts_type), _exact_literal(hi, ts_type))
    if n_ids <= SCAN_ID_LIST_MAX:
        ids = [r[0] for r in win.select(SS_ID).distinct().collect()]
        return cond & F.col(SS_ID).isin(ids)
    return cond & F.col(SS_ID).between(F.lit(id_lo), F.lit(id_hi))


def _sql_time(v, ts_type: str) -> str:
    """A collected exact time (see ``exact_time``) as an SQL literal."""
    if ts_type == "timestamp":
        return f"timestamp_micros({int(v)})"
    return f"TIMESTAMP_NTZ '{v}'"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def few_windows(windows: DataFrame, columns) -> list[tuple]:
    """The windows on the driver, as (id, exact start, exact end): at most
    MAX_LITERAL_WINDOWS. ``columns``: the readings' schema. A window with a
    null id or bound, or start after end, holds no reading and is left out."""
    ts_type = columns[TS].dataType.simpleString()
    base = windows.select(F.col(SS_ID).cast(columns[SS_ID].dataType).alias(SS_ID),
                          F.col(W_START).cast(ts_type).alias(W_START), F.col(W_END).cast(ts_type).alias(W_END))
    base = base.filter(F.col(SS_ID).isNotNull() & (F.col(W_START) <= F.col(W_END)))
    first = base.select(SS_ID, exact_time(W_START, ts_type), exact_time(W_END, ts_type)).limit(MAX_LITERAL_WINDOWS + 1)
    rows = [tuple(r) for r in first.collect()]
    if len(rows) > MAX_LITERAL_WINDOWS:
        raise ValueError(f"more than {MAX_LITERAL_WINDOWS} windows: fetch them by the join")
    return rows


def fetch_few(readings: DataFrame, rows: list[tuple]) -> DataFrame:
    """Readings of the windows of ``few_windows``, from a frame without month keys."""
    return _fetch_few(readings, rows, dict(readings.dtypes)[TS], False)


def _fetch_few(readings: DataFrame, rows, ts_type: str, partitioned: bool) -> DataFrame:
    """A few windows as literal predicates on the readings scan: ids,
    overall time range and (on the month layout) the months spanned are
    plain conjuncts that reach the Parquet reader and the partition pruner;
    each reading then takes the windows it falls in (a generator, so a
    reading in two overlapping windows appears twice, as in a join).

    Predicate and generator are each one SQL expression: built from Column
    objects they would cost a few calls into the JVM per window and term,
    which is most of the latency of a small fetch.
    """
    out = [c for c in readings.columns if c not in (YEAR, MONTH)]
    if not rows:
        return readings.filter(F.lit(False)).select(*out, F.lit(None).cast(ts_type).alias(W_START),
                                                     F.lit(None).cast(ts_type).alias(W_END))
    sid, ts = _q(SS_ID), _q(TS)
    wins = [(int(i), _sql_time(st, ts_type), _sql_time(en, ts_type)) for i, st, en in rows]
    lo = _sql_time(min(st for _, st, _ in rows), ts_type)
    hi = _sql_time(max(en for _, _, en in rows), ts_type)
    ids = ", ".join(str(i) for i in sorted({i for i, _, _ in wins}))
    cond = f"{sid} IN ({ids}) AND {ts} BETWEEN {lo} AND {hi}"
    if partitioned:
        month = f"make_date(CAST({_q(YEAR)} AS INT), CAST({_q(MONTH)} AS INT), 1)"
        spans = " OR ".join(f"{month} BETWEEN trunc(to_date({st}), 'MM') AND trunc(to_date({en}), 'MM')"
                            for _, st, en in wins)
        cond += f" AND ({spans})"
    each = ", ".join(f"CASE WHEN {sid} = {i} AND {ts} BETWEEN {st} AND {en} "
                     f"THEN named_struct('{W_START}', {st}, '{W_END}', {en}) END" for i, st, en in wins)
    gen = f"inline(filter(array({each}), w -> w IS NOT NULL))"
    return readings.where(cond).selectExpr(*[_q(c) for c in out], gen)


def fetch_windows(readings: DataFrame, windows: DataFrame,
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, materialize: bool = True,
                  scan_filter: bool = True, literal_windows: bool = False) -> DataFrame:
    """All readings of each ``(ss_id, window_start, window_end)``, closed range.

    One job instead of one query per window: a join, whose windows side is
    broadcast after a row-count check; beyond the bound the join shuffles
    (AQE splits skewed systems). Time is part of the join key, so a reading
    meets only windows near it. When the readings carry the Hive month
    keys, each window is exploded to the months it spans and the keys join
    too, so dynamic partition pruning reads only those months (the windows
    side is filtered, which the pruning rule needs). Otherwise the key is a
    time bucket as long as the longest window; a window lies in two at most.
    A caller who has a handful of windows (the reference's run: 8) may ask
    for ``literal_windows``: they become predicates of one pruned scan, at
    most MAX_LITERAL_WINDOWS of them. Windows derived from
    the readings themselves are materialised once (``materialize``) so the
    size check does not rescan the readings; windows from a stored table
    need not be. When the windows fit the broadcast bound, ``scan_filter``
    also gives the readings scan literal predicates (their ids and time
    range) that Parquet statistics use to skip row groups.
    """
    ts_type = dict(readings.dtypes)[TS]
    id_type = dict(readings.dtypes)[SS_ID]
    partitioned = YEAR in readings.columns and MONTH in readings.columns
    base = windows.select(F.col(SS_ID).cast(id_type).alias(SS_ID),
                          F.col(W_START).cast(ts_type).alias(W_START),
                          F.col(W_END).cast(ts_type).alias(W_END))
    if materialize:
        base = reliable_checkpoint(base)
    # A window with a null id or bound, or start after end, holds no reading.
    base = base.filter(F.col(SS_ID).isNotNull() & (F.col(W_START) <= F.col(W_END)))
    if literal_windows:
        return _fetch_few(readings, few_windows(base, readings.schema), ts_type, partitioned)

    win = base
    keys = [SS_ID]
    if partitioned:
        months = F.sequence(first_of_month(W_START), first_of_month(W_END), F.expr("INTERVAL 1 MONTH"))
        win = (win.withColumn("_m", F.explode(months))
               .select(SS_ID, W_START, W_END,
                       F.year("_m").cast("smallint").alias(YEAR),
                       F.month("_m").cast("tinyint").alias(MONTH)))
        keys = [SS_ID, YEAR, MONTH]
    # One pass over the windows (never the readings) gives the size check
    # and the scan predicates.
    stats = _window_stats(win, ts_type)
    small = stats[0] <= max_broadcast_rows
    if small:
        win = F.broadcast(win)
    out = [c for c in readings.columns if c not in (YEAR, MONTH)] + [W_START, W_END]
    if small and scan_filter:
        readings = readings.filter(_scan_filter(win, stats, ts_type))
    if not partitioned:
        # A bucket is as long as the longest window (and one microsecond, for
        # windows of no length), so a window spans two buckets at most.
        length = (stats[-1] or 0) + 1
        bucket = lambda c: F.floor(micros_since_epoch(c, ts_type) / F.lit(length)).cast("bigint")
        win = win.withColumn(_BUCKET, F.explode(F.sequence(bucket(W_START), bucket(W_END))))
        win = F.broadcast(win) if small else win
        readings = readings.withColumn(_BUCKET, bucket(TS))
        keys = [SS_ID, _BUCKET]
    joined = readings.join(win, keys, "inner").filter(F.col(TS).between(F.col(W_START), F.col(W_END)))
    return joined.select(*out)


def with_month_pruning(df: DataFrame, start, end) -> DataFrame:
    """Closed time range plus the matching Hive-key predicate.

    Spark does not derive partition filters from ``datetime_GMT``; the
    extra ``make_date(year, month, 1)`` range prunes whole month folders.
    """
    ts_type = dict(df.dtypes)[TS]
    s, e = ts_literal(start, ts_type), ts_literal(end, ts_type)
    return df.filter(partition_month_start().between(first_of_month(s), first_of_month(e))
                     & F.col(TS).between(s, e))


def outlier_context(readings: DataFrame, outliers: DataFrame, before_days: int = 100,
                    length_days: int = 200) -> DataFrame:
    """Readings around the first outlier of every system.

    Window start: the outlier's time with the hour set to 0 (minutes kept),
    minus ``before_days``; length ``length_days``. The reference draws this
    for one chosen system; here every system with an outlier gets its
    window, fetched in one job.
    """
    ts_type = dict(outliers.dtypes)[TS]
    first = outliers.groupBy(SS_ID).agg(F.min(TS).alias("_first"))
    win = first.select(SS_ID, add_days(midnight_keep_minutes(F.col("_first")), -before_days, ts_type)
                       .alias(W_START))
    win = win.withColumn(W_END, add_days(F.col(W_START), length_days, ts_type))
    return fetch_windows(readings, win)
