"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.session import ensure_checkpoint_dir

# Words are maximal runs of bytes other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    Cuts lineage where a result is read by several jobs: every later job,
    and every task re-run after a lost executor, reads the same rows.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of df under internal names, so that extra
    columns, whatever they are called, cannot clash with computed ones."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def orderable_columns(df: DataFrame) -> list[str]:
    """Names of the columns that Spark can order by."""
    return [f.name for f in df.schema.fields
            if not any(word in f.dataType.simpleString() for word in ("map<", "variant", "void"))]


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def default_parallelism(spark: SparkSession) -> int:
    """Tasks to plan for when the data gives no better number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def repeat_rows(df: DataFrame, times: str, block: int = 4096) -> DataFrame:
    """Each row ``times`` times (0 drops it), with a 0-based ``copy_no``.

    Two generators, so that no array is longer than ``block`` or
    ``times / block``, whatever the multiplicity.
    """
    n = F.col(times)
    return (df.filter(n > 0)
            .withColumn("copy_block", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"),
                                                           F.lit(block).cast("long"))))
            .withColumn("copy_no", F.explode(F.sequence(
                F.col("copy_block"), F.least(F.col("copy_block") + (block - 1), (n - 1).cast("long")))))
            .drop("copy_block"))
