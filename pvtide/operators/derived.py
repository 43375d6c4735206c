"""Aggregates kept beside a versioned table, from new month folders only.

A month folder of a snapshot table never changes once written. So what an
aggregate needs to know of it, a mergeable state, is computed once and stored
under the folder's name; a version's aggregate merges the states of its
folders. ``update`` scans the folders that have no states yet: new months, and
months that were rewritten. Late or corrected readings rewrite their month, so
the result is that of a full run whatever order they come in.

Kinds of states:

* ``ID_BITMAPS`` (A6-A8, U4, U5): exact bitmaps of ids, merged by OR;
* ``activity`` (A2, P8): first and last reading of every system;
* ``resample_sums`` (A4, W2): sum and count of every right-closed window, also
  of those that two months share. Null and NaN rules are the mean's;
* ``value_sketches`` (A11, P12): mergeable quantile sketches of the values.

Layout: ``derived/<name>/states/batch=<id>/`` and, written last as a single
file, ``derived/<name>/folders/<id>/`` with the folders of that batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.functions.timecols import right_closed_end
from pvtide.operators.snapshots import WRITE, Snapshot
from pvtide.operators.spatial import value_sketch
from pvtide.schema import END, GEN, MONTH, SS_ID, START, TS, YEAR

BATCH = "batch"
BUCKET, BITMAP = "id_bucket", "id_bitmap"
FOLDER = [WRITE, YEAR, MONTH]
_FOLDERS = T.StructType([T.StructField(WRITE, T.StringType()), T.StructField(YEAR, T.ShortType()),
                         T.StructField(MONTH, T.ByteType()), T.StructField(BATCH, T.StringType())])


@dataclass(frozen=True)
class Kind:
    """A name (part of the stored path), the state columns of readings that
    carry their folder, and the merge of states that are read back."""

    name: str
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


# --- states -----------------------------------------------------------------

def id_bitmaps(df: DataFrame, keys=()) -> DataFrame:
    """Exact bitmaps of the ids, 32,768 per row; null ids are in none."""
    ids = F.col(SS_ID).cast("bigint")
    return (df.filter(F.col(SS_ID).isNotNull()).groupBy(*keys, F.bitmap_bucket_number(ids).alias(BUCKET))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(ids)).alias(BITMAP)))


def _merged_bitmaps(states: DataFrame) -> DataFrame:
    return states.groupBy(BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


ID_BITMAPS = Kind("id-bitmaps", lambda df: id_bitmaps(df, FOLDER), _merged_bitmaps)

ACTIVITY = Kind(
    "activity",
    lambda df: df.groupBy(*FOLDER, SS_ID).agg(F.min(TS).alias(START), F.max(TS).alias(END)),
    lambda states: states.groupBy(SS_ID).agg(F.min(START).alias(START), F.max(END).alias(END)))


def resample_sums(every: str = "30 minutes", value: str = GEN, factor: float = 1.0, out: str | None = None) -> Kind:
    """States of ``resample.resample_right_closed`` with these parameters."""
    out = out or value

    def partial(df: DataFrame) -> DataFrame:
        return (df.groupBy(*FOLDER, SS_ID, right_closed_end(F.col(TS), every).alias(TS))
                .agg(F.sum(F.col(value).cast("double") * F.lit(factor)).alias("total"), F.count(value).alias("n")))

    def merge(states: DataFrame) -> DataFrame:
        n = F.sum("n")
        return states.groupBy(SS_ID, TS).agg(F.when(n > 0, F.sum("total") / n).alias(out))

    return Kind(f"resample-{every.replace(' ', '-')}-{value}-{factor}", partial, merge)


def value_sketches(value: str = GEN, k: int = 200) -> Kind:
    """Quantile sketches of the values of every month folder (A11), merged to
    one; ``spatial.edges_of`` takes its quantiles."""
    return Kind(f"sketch-{value}-{k}", lambda df: df.groupBy(*FOLDER).agg(value_sketch(value, k).alias("sketch")),
                lambda states: states.agg(F.kll_merge_agg_double("sketch", k).alias("sketch")))


# --- keeping them -----------------------------------------------------------

def _root(table: Snapshot, kind: Kind) -> str:
    return f"{table.root}/derived/{kind.name}"


def _taken(table: Snapshot, kind: Kind) -> DataFrame:
    """Folders that have states, with the batch that holds them. If two
    updates met, one batch counts."""
    try:
        found = table.spark.read.schema(_FOLDERS).json(f"{_root(table, kind)}/folders/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = table.spark.createDataFrame([], _FOLDERS)
    return found.groupBy(*FOLDER).agg(F.min(BATCH).alias(BATCH))


def update(table: Snapshot, kind: Kind) -> list[str]:
    """Compute the states of the version's folders that have none yet; returns
    these folders. A failed update leaves no states behind that are read."""
    live = table.zones().select(*FOLDER).distinct()
    new = live.join(_taken(table, kind), FOLDER, "left_anti").orderBy(*FOLDER).collect()  # one row per month at most
    if not new:
        return []
    folders = [f"data/{WRITE}={r[0]}/{YEAR}={r[1]}/{MONTH}={r[2]:02d}" for r in new]
    batch = uuid.uuid4().hex
    kind.partial(table.scan(folders, keep_write=True)).write.parquet(f"{_root(table, kind)}/states/{BATCH}={batch}")
    ledger = table.spark.createDataFrame([(*r, batch) for r in new], _FOLDERS)
    ledger.coalesce(1).write.json(f"{_root(table, kind)}/folders/{batch}")
    return folders


def states(table: Snapshot, kind: Kind) -> DataFrame:
    """The stored states of the version's folders; all of them must be there."""
    live = table.zones().select(*FOLDER).distinct()
    taken = live.join(_taken(table, kind), FOLDER, "left").collect()  # one row per month
    missing = [tuple(r) for r in taken if r[BATCH] is None]
    if missing:
        raise ValueError(f"{kind.name} has no states of {len(missing)} month folders; run update() first")
    schema = kind.partial(table.scan([], keep_write=True)).schema
    if not taken:
        return table.spark.createDataFrame([], schema)
    paths = [f"{_root(table, kind)}/states/{BATCH}={b}" for b in sorted({r[BATCH] for r in taken})]
    found = (table.spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())]))
             .option("basePath", f"{_root(table, kind)}/states").parquet(*paths))
    wanted = table.spark.createDataFrame([tuple(r) for r in taken], _FOLDERS)
    return found.join(F.broadcast(wanted), [*FOLDER, BATCH], "left_semi").drop(BATCH)


def merged(table: Snapshot, kind: Kind) -> DataFrame:
    """The version's aggregate, from stored states."""
    return kind.merge(states(table, kind))


# --- questions to the id bitmaps --------------------------------------------

def id_counts_by_month(table: Snapshot) -> DataFrame:
    """``year, month, n_ids``: distinct systems of every month."""
    per_bucket = (states(table, ID_BITMAPS).groupBy(YEAR, MONTH, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP)))
    return per_bucket.groupBy(YEAR, MONTH).agg(F.sum(F.bitmap_count(BITMAP)).alias("n_ids"))


def common_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """The intersection of two sets of bitmaps (one row per bucket each)."""
    both = left.select(BUCKET, BITMAP).union(right.select(BUCKET, BITMAP))
    return (both.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg(BITMAP).alias(BITMAP))
            .filter("n = 2").drop("n"))


def id_overlap_counts(table: Snapshot, metadata: DataFrame) -> DataFrame:
    """As ``quality.id_overlap_counts``, from stored bitmaps of the readings."""
    own = merged(table, ID_BITMAPS)
    n, none = F.bitmap_count(BITMAP), F.lit(0).cast("bigint")
    counts = own.select(n.alias("read"), none.alias("known")).union(
        common_ids(own, id_bitmaps(metadata)).select(none, n))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(total("read").alias("n_ids_with_readings"), total("known").alias("n_ids_in_metadata"))


def ids_of(bitmaps: DataFrame) -> DataFrame:
    """The ids in bitmaps, one row each."""
    byte = F.expr(f"conv(hex(substring({BITMAP}, byte_no + 1, 1)), 16, 10)").cast("int")
    bytes_ = bitmaps.select(BUCKET, BITMAP, F.explode(F.sequence(F.lit(0), F.octet_length(BITMAP) - 1)).alias("byte_no"))
    bits = (bytes_.select(BUCKET, "byte_no", byte.alias("byte")).filter("byte > 0")
            .select(BUCKET, "byte_no", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
            .filter(F.col("byte").bitwiseAND(F.expr("shiftleft(1, bit)")) > 0))
    # Bucket 1 begins with id 1, bucket 2 with 32,769; bucket 0 goes down from 0, bucket -1 from -32,768.
    place = F.col("byte_no") * 8 + F.col("bit")
    up, down = (F.col(BUCKET) - 1) * 32_768 + place + 1, F.col(BUCKET) * 32_768 - place
    return bits.select(F.when(F.col(BUCKET) > 0, up).otherwise(down).cast("bigint").alias(SS_ID))
