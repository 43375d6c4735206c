"""Incremental relayout of a raw tree whose paths tell year and month.

A ledger lists the raw files (path, size, time) that a version of the
snapshot table was made from. A refresh compares it with the tree: months all
of whose files are as before are not read; a month with a new, changed or
vanished file is read anew from all of its files and replaced. The ledger is
written before its version is published and under the version's name, so both
become visible together, and a refresh that fails, or that is run again,
changes nothing but what the tree asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvtide.operators.layout import RAW_PATH, relayout_by_path
from pvtide.operators.snapshots import Snapshot, open_snapshot, write_snapshot
from pvtide.schema import GEN, MONTH, SS_ID, TS, YEAR

LEDGER = "path string, length bigint, modified timestamp, year smallint, month tinyint"


def list_files(spark: SparkSession, path_glob: str, pattern: str = RAW_PATH) -> DataFrame:
    """``path, length, modified, year, month`` of the tree's files; their
    contents are not read. Files whose path has no year and month are left out."""
    part = lambda group, kind: F.regexp_extract("path", pattern, group).try_cast(kind)
    found = spark.read.format("binaryFile").load(path_glob)
    return (found.select("path", "length", F.col("modificationTime").alias("modified"),
                         part(1, "smallint").alias(YEAR), part(2, "tinyint").alias(MONTH))
            .filter(F.col(YEAR).isNotNull() & F.col(MONTH).isNotNull()))


def ledger_of(table: Snapshot) -> DataFrame | None:
    """The raw files that the version was made from; None if it was written
    by other means."""
    if not table.has_beside("ledger"):
        return None
    return table.spark.read.schema(LEDGER).parquet(table.beside("ledger"))


def _differs() -> Column:
    return ~(F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified")))


def changed_months(files: DataFrame, ledger: DataFrame | None) -> list[tuple[int, int]]:
    """Months with a file that the ledger does not have as it is, or that the
    tree no longer has (one row per month comes to the driver)."""
    if ledger is None:
        changed = files
    else:
        old = ledger.withColumnsRenamed({"length": "old_length", "modified": "old_modified"})
        changed = files.join(old, ["path", YEAR, MONTH], "full").filter(_differs())
    return [tuple(r) for r in changed.select(YEAR, MONTH).distinct().orderBy(YEAR, MONTH).collect()]


def refresh(spark: SparkSession, root: str, path_glob: str, pattern: str = RAW_PATH, columns=(SS_ID, TS, GEN),
            **options) -> Snapshot:
    """Bring the snapshot table at ``root`` up to date with the raw tree;
    returns its newest version, which is the one before if nothing changed.
    Rows are filed under their path's month. ``options`` as for ``write_snapshot``."""
    before = open_snapshot(spark, root)
    files = list_files(spark, path_glob, pattern)
    months = changed_months(files, None if before is None else ledger_of(before))
    if before is not None and not months:
        return before
    in_months = F.struct(YEAR, MONTH).isin([F.struct(F.lit(y).cast("smallint"), F.lit(m).cast("tinyint")) for y, m in months])
    # The paths to read, no more than a scan of these months lists anyway.
    paths = [r[0] for r in files.filter(in_months).select("path").orderBy("path").collect()] if months else []
    if paths:
        raw = relayout_by_path(spark, paths, pattern, columns)
    elif before is not None:
        raw = before.scan([])
    else:
        raise ValueError(f"no files at {path_glob}")

    def keep_ledger(path: str) -> None:
        files.write.parquet(path)

    return write_snapshot(raw, root, months=months, keep_keys=True, beside={"ledger": keep_ledger}, **options)
