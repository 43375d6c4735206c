"""Size checks before broadcasting, and lineage cuts.

A side is broadcast only after counting it: the count stops at
``max_rows + 1`` so a large side is never fully counted. Beyond the bound
the plain frame is returned and Spark plans a shuffle join (with AQE skew
splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvtide.session import ensure_checkpoint_dir

# Default bound for a broadcast side: one row per system or window is a few
# dozen bytes, so two million rows stay well under 100 MB per executor.
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Return ``(broadcast(df), True)`` when df has at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df in the session's shared checkpoint folder.

    Used where a result is read by more than one job and must be identical
    each time (row numbering), or where recomputation would rescan the data.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
