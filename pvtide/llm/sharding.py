"""Global shuffle of a corpus into shards: a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash of the whole record and, for a record that repeats, of the repeat's
number, so that repeats spread like any other records. Pass 2 takes each
bucket into memory in blocks, Fisher-Yates shuffles every block (Spark's
``shuffle`` function is the inside-out Fisher-Yates algorithm) and lays the
blocks out one after the other. The buckets' running row counts turn
positions inside buckets into positions in one global random order, which is
cut into shards whose row counts differ by at most one.

Only DataFrame functions; a text moves in one shuffle (a repeated record
once more, after map-side counting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvtide.llm.common import default_parallelism, orderable_columns, repeat_rows, stored

# A bucket holds about this much text, a block of it is shuffled in memory.
BUCKET_BYTES = 128 << 20
BLOCK_BYTES = 4 << 20
# Hashes of repeated records and starts of buckets are broadcast up to this many rows (16 bytes each).
BROADCAST_ROWS = 1_000_000
# Buckets whose row counts one task adds up.
BUCKET_GROUP = 4096


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id",
                        text_col: str = "text", bucket_bytes: int = BUCKET_BYTES,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` in a random order over ``shards`` shards.

    Returns ``shard`` (int), ``slot`` (long, gapless from 0 in each shard)
    and ``record``, a struct of all columns of the input, so no input column
    can clash. Law ``rows``: shard sizes are at most one row apart.

    Defined cases: null ids and texts hash as nulls and are placed like any
    other record; rows equal in all columns are separate records, numbered,
    with separate slots all over the shards (which of two equal records gets
    which slot cannot be told apart); with fewer rows than shards the last
    shards are empty; an empty table gives an empty result. A text longer
    than ``block_bytes`` forms a block of its own.

    The order depends on the records and ``seed`` alone, given the number of
    buckets, which follows the input's size, and the number of tasks.
    """
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long") + 1
    plain = orderable_columns(docs)
    odd = [c for c in docs.columns if c not in plain]
    # Columns that cannot be compared count by their JSON form.
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in odd])) if odd else F.lit("")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), rest.alias("rest"),
                        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in plain], rest).alias("record_hash"),
                        size.alias("size"))

    # Rows and bytes per record hash: a few bytes a row, combined in the map tasks.
    hashes = stored(keyed.groupBy("record_hash").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")),
                    "shard-hashes")
    total_rows, total_bytes = hashes.select(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    keyed = _numbered(keyed, hashes.filter("n > 1").select("record_hash"), plain, odd)
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), "record_hash", "copy_no"))
    tasks = max(-(-total_bytes // bucket_bytes), default_parallelism(spark))
    buckets = 8 * tasks
    keyed = keyed.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))

    scattered = keyed.repartition(tasks, "bucket")
    in_bucket = Window.partitionBy("bucket").orderBy("h", "size")
    running = in_bucket.rowsBetween(Window.unboundedPreceding, 0)
    blocks = (scattered
              .withColumns({"row": F.row_number().over(in_bucket),
                            "block": F.floor((F.sum("size").over(running) - F.col("size")) / F.lit(block_bytes))})
              .groupBy("bucket", "block")
              .agg(F.min("row").alias("first_row"), F.collect_list(F.struct("row", "record")).alias("records"))
              # collect_list promises no order: the rows' own order is put back before they are shuffled.
              .withColumn("records", F.transform(
                  F.array_sort("records", lambda a, b: a["row"] - b["row"]), lambda x: x["record"]))
              # The generator behind shuffle() is seeded per partition and runs on
              # from row to row: a fixed order of blocks makes re-runs agree.
              .sortWithinPartitions("bucket", "block")
              .withColumn("records", F.shuffle("records", seed)))
    starts = _bucket_starts(keyed)
    # One row per bucket; beyond the bound the small side is shuffled to the buckets.
    starts = F.broadcast(starts) if buckets <= BROADCAST_ROWS else starts.hint("shuffle_hash")
    placed = (blocks.join(starts, "bucket")
              .select((F.col("start") + F.col("first_row") - 1).alias("base"), F.posexplode("records"))
              .select((F.col("base") + F.col("pos")).alias("position"), F.col("col").alias("record")))
    return _cut(placed, total_rows, shards).select("shard", "slot", "record")


def _numbered(keyed: DataFrame, repeated: DataFrame, plain: list[str], odd: list[str]) -> DataFrame:
    """``keyed`` with ``copy_no``, which numbers rows equal in all columns from 0.

    Rows whose hash is not in ``repeated`` are alone and go straight on; the
    others are counted as whole records (combined in the map tasks, so a
    record on a third of all rows is one row per task) and unfolded again.
    With more repeated hashes than can be broadcast all rows are counted.
    """
    known = repeated.limit(BROADCAST_ROWS + 1).count()
    if known == 0:
        return keyed.drop("rest").withColumn("copy_no", F.lit(0).cast("long"))
    alone, several = None, keyed
    if known <= BROADCAST_ROWS:
        alone = keyed.join(F.broadcast(repeated), "record_hash", "left_anti").drop("rest")
        several = keyed.join(F.broadcast(repeated), "record_hash", "left_semi")
    # Internal names, so that no column of the record clashes.
    fields = {c: f"c{i}" for i, c in enumerate([*plain, *odd])}
    cells = several.select("record_hash", "size", "rest",
                           *[F.col("record").getField(c).alias(name) for c, name in fields.items()])
    counted = cells.groupBy("record_hash", "size", "rest", *[fields[c] for c in plain]).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(fields[c]).alias(fields[c]) for c in odd])
    schema = keyed.schema["record"].dataType
    whole = F.struct(*[F.col(fields[f.name]).alias(f.name) for f in schema.fields])
    several = repeat_rows(counted.select(whole.alias("record"), "record_hash", "size", "n"), "n").drop("n")
    if alone is None:
        return several
    return alone.withColumn("copy_no", F.lit(0).cast("long")).unionByName(several)


def _bucket_starts(keyed: DataFrame) -> DataFrame:
    """``bucket, start``: the rows in all buckets before. Counts are added up
    in groups of buckets, then over the groups, so no task sees them all."""
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("part", F.floor(F.col("bucket") / F.lit(BUCKET_GROUP)).cast("int")), "shard-buckets")
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return (counts.withColumn("through", F.sum("n").over(inside)).join(parts, "part")
            .select("bucket", (F.col("part_start") + F.col("through") - F.col("n")).alias("start")))


def _cut(placed: DataFrame, total_rows: int, shards: int) -> DataFrame:
    """Positions 0 .. total_rows-1 as contiguous shards at most one row apart."""
    small, larger = divmod(total_rows, shards)
    split = larger * (small + 1)  # positions below it lie in the larger shards
    p = F.col("position")
    shard = (F.when(p < split, F.floor(p / F.lit(small + 1)))
             .otherwise(F.lit(larger) + F.floor((p - split) / F.lit(max(small, 1))))).cast("int")
    start = F.col("shard") * F.lit(small) + F.least(F.col("shard"), F.lit(larger))
    return placed.withColumn("shard", shard).withColumn("slot", (p - start).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, mode: str = "errorifexists",
                 **options) -> None:
    """Shuffle ``docs`` and write them as ``path/shard=N/part-*.parquet``.

    A shard is a run of consecutive buckets, so each task writes to one or
    two shards; rows are in slot order within each file.
    """
    placed = shuffle_into_shards(docs, shards, seed, **options)
    (placed.sortWithinPartitions("shard", "slot")
     .write.mode(mode).partitionBy("shard").parquet(path))
