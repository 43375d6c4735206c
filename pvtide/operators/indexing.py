"""Row index after a global sort (W1, ``with_row_index``) and positional access.

``row_number()`` over an unpartitioned window moves every row into one task.
Here the sort stays range-partitioned and its result is written as Parquet
once, columnar: one file per range, in order. The reader knows each row's
position in its file; the files' row counts (one row per file, so a proven
bound for the broadcast) turn that into the global 0-based index. Later
reads are pruned like those of any Parquet table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.session import ensure_checkpoint_dir

_FILE = "_pvt_file"
_POS = "_pvt_pos"
_TIE = "_pvt_tie"


def with_row_index(df: DataFrame, order_by: list, name: str = "index", path: str | None = None) -> DataFrame:
    """Sort by ``order_by`` and prepend a 0-based ``bigint`` row index.

    The sort ends with a tie-breaker taken before the shuffle, so range
    partitioning can split rows that tie on every ``order_by`` column (a
    third of all rows being copies of one reading). The tie-breaker is the
    row's position after a local sort on all of its columns: it depends only
    on which rows an input partition holds, not on the order they arrive in,
    so a task re-run after an executor loss routes every row as before. Tied
    rows are equal in the ordering columns, so their order among themselves
    does not change the result.

    ``path``: a new folder for the sorted table (default: one below the
    session's shared checkpoint folder); the result reads it.
    """
    orderable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    keyed = df.sortWithinPartitions(*orderable).withColumn(_TIE, F.monotonically_increasing_id())
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/row-index-{uuid.uuid4().hex}"
    keyed.orderBy(*order_by, F.col(_TIE)).drop(_TIE).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path).select(
        *df.columns, F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_POS))
    # File names begin with the number of the range, zero-padded.
    counts = stored.groupBy(_FILE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(_FILE, F.coalesce(
        F.sum("_n").over(Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return (stored.join(F.broadcast(offsets), _FILE)
            .select((F.col("_offset") + F.col(_POS)).cast("bigint").alias(name), *df.columns))


def nth(df_indexed: DataFrame, i: int, name: str = "index") -> DataFrame:
    """Row at position i of an indexed frame (``series[i]``)."""
    return df_indexed.filter(F.col(name) == F.lit(i))
