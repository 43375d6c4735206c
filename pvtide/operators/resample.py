"""Right-closed resampling (W2/A4) and the three-resolution comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvtide.functions.nan import not_nan
from pvtide.functions.timecols import lit_ts, right_closed_end
from pvtide.schema import GEN, SS_ID, TS

# Names of the three compared series.
SOURCE_FINE = "5 minutely"
SOURCE_RESAMPLED = "5 minutely resampled to 30 minutes"
SOURCE_COARSE = "30 minutely"


def resample_right_closed(df: DataFrame, every: str = "30 minutes", value: str = GEN,
                          factor: float = 1.0, out: str | None = None,
                          keys: tuple = (SS_ID,)) -> DataFrame:
    """Mean of ``value * factor`` per system and right-closed window ``(end-every, end]``,
    labelled by the window end (``group_by_dynamic(closed="right", label="right")``).

    Mean skips nulls and propagates NaN, as the reference's mean does.
    One hash aggregate with partial aggregation: a busy system is combined
    map-side before the shuffle.
    """
    out = out or value
    return (df.groupBy(*keys, right_closed_end(F.col(TS), every).alias(TS))
            .agg(F.avg(F.col(value) * F.lit(factor)).alias(out)))


def _ts_type(df: DataFrame) -> str:
    return dict(df.dtypes)[TS]


def _only(mine: Column, value: Column) -> Column:
    """The one value of a series at a time; a second one fails the job."""
    return F.when(F.count(F.when(mine, 1)) > 1,
                  F.raise_error(F.lit("duplicate (datetime_GMT, ss_id) in a compared series")).cast("double")
                  ).otherwise(F.max(F.when(mine, value)))


# The reference compares the hours from 5 to 21.
COMPARED_HOURS = (5, 21)


def compare_resolutions(fine: DataFrame, coarse: DataFrame, day: dt.date | None = None,
                        hours: tuple[int, int] = COMPARED_HOURS, fine_minutes: int = 5,
                        coarse_minutes: int = 30, value: str = GEN) -> DataFrame:
    """Power of one series at three resolutions, aligned on time, long form.

    * fine energy as power: ``value * 60/fine_minutes``;
    * the same resampled to right-closed ``coarse_minutes`` means;
    * coarse energy as power: ``value * 60/coarse_minutes``.

    Every system is compared (the reference looks at one system and day;
    ``day`` narrows to one date). Alignment is a full outer match on
    ``(ss_id, datetime_GMT)``: a time present in any series yields a row per
    series, null where that series lacks it. It is computed as one grouped
    aggregation over the union of the three inputs (one shuffle) instead of
    two full outer joins (three); the fine series is scanned once for both
    of its forms. NaN rows are dropped, nulls kept. A second reading of one
    system and time in a series fails the job: remove duplicates first
    (``reshape.dedup``).
    """
    f_fine = 60.0 / fine_minutes
    f_coarse = 60.0 / coarse_minutes
    every = f"{coarse_minutes} minutes"
    ntz = _ts_type(fine) == "timestamp_ntz"

    fine_sel = fine.select(SS_ID, TS, value)
    coarse_sel = coarse.select(SS_ID, TS, value)
    if day is not None:
        # Superset on raw time, so the scans prune; the exact rule is below.
        margin = dt.timedelta(minutes=coarse_minutes)
        lo = lit_ts(dt.datetime.combine(day, dt.time()) - margin, ntz)
        hi = lit_ts(dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1) + margin, ntz)
        fine_sel = fine_sel.filter(F.col(TS).between(lo, hi))
        coarse_sel = coarse_sel.filter(F.col(TS).between(lo, hi))

    # The fine series is read once: each reading yields its own label and
    # its right-closed window label (a generator, no second scan).
    fine_twice = fine_sel.select(SS_ID, value, F.inline(F.array(
        F.struct(F.col(TS).alias("_label"), F.lit(0).alias("_src")),
        F.struct(right_closed_end(F.col(TS), every).alias("_label"), F.lit(1).alias("_src")))))
    tagged = (fine_twice.select(SS_ID, "_label", "_src", value)
              .unionByName(coarse_sel.select(SS_ID, F.col(TS).alias("_label"),
                                             F.lit(2).alias("_src"), value)))
    v = F.col(value).cast("double")
    aligned = (tagged.groupBy(SS_ID, F.col("_label").alias(TS))
               .agg(_only(F.col("_src") == 0, v * F.lit(f_fine)).alias(SOURCE_FINE),
                    F.avg(F.when(F.col("_src") == 1, v * F.lit(f_fine))).alias(SOURCE_RESAMPLED),
                    _only(F.col("_src") == 2, v * F.lit(f_coarse)).alias(SOURCE_COARSE)))
    cond = F.hour(F.col(TS)).between(hours[0], hours[1])
    if day is not None:
        cond = cond & (F.to_date(F.col(TS)) == F.lit(day))
    aligned = aligned.filter(cond)
    long = aligned.unpivot([SS_ID, TS], [SOURCE_FINE, SOURCE_RESAMPLED, SOURCE_COARSE],
                           "source", "power_W")
    return long.filter(not_nan("power_W"))
