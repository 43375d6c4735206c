"""Mixing sources to target weights.

Every source gets a target number of words; its documents are put in a
seeded random order, and the first ``target`` words of that order are cut
into blocks (a second pass over the source begins where the target exceeds
its words). A multivariate-hypergeometric splitting tree then deals each
source's exact number of blocks out to the output shards: at every node of a
binary tree the pool of blocks is split in half as if the blocks had been
drawn without replacement, so each shard's composition is random, the totals
per source stay exact, and no data moves for it. A shard takes disjoint,
consecutive runs of the permuted blocks and is shuffled locally.

Only DataFrame functions on the way. Rows that move are ids, sizes and
hashes; texts are read to count words and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvtide.llm.common import repeat_rows, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 4096
# A source's random order is cut into buckets of this many rows on average, if
# all rows were its own; there are at least MIN_BUCKETS, for parallel work.
ROWS_PER_BUCKET = 20_000
MIN_BUCKETS = 512


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets per source: ``source, source_size -> + weight, target``.

    Sources in code point order, null last, take the weights in turn. They
    share ``share`` times the sum of all sizes; a target stops at
    ``max_repeat`` times its source's size and the excess goes to the others
    by weight until none is above (water filling). With sources ordered by
    cap / weight, the filled ones are a prefix, so one running sum gives the
    level. One row per source passes through a single task.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(turn) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns({
        "filled": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open_weight": F.sum("weight").over(rest),
        "budget": F.sum("source_size").over(everything) * F.lit(share)})
    # The level if this source and all after it stay below their caps; it is
    # highest where that holds, so the maximum is the level of the solution.
    t = t.withColumn("level", F.max((F.col("budget") - F.col("filled")) / F.col("open_weight")).over(everything))
    return t.select("source", "source_size", "weight",
                    F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _bind(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(pool: Column, good: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric variate (good blocks among ``draws`` out of ``pool``)
    by inversion of the uniform ``u``.

    The probabilities follow from each other by their ratio, from twelve
    standard deviations below the mean to twelve above it (or the ends of
    the support); two folds give their total and the inverse.
    """
    pool, good, draws = (c.cast("double") for c in (pool, good, draws))
    mean = draws * good / F.greatest(pool, F.lit(1.0))
    spread = 12 * F.sqrt(mean + 1) + 4
    args = F.struct(pool.alias("n"), good.alias("g"), draws.alias("d"), u.alias("u"),
                    F.greatest(F.lit(0.0), draws + good - pool, F.floor(mean - spread)).alias("lo"),
                    F.least(good, draws, F.ceil(mean + spread)).alias("hi"))

    def invert(v):
        ks = F.sequence(v["lo"].cast("long"), F.greatest(v["lo"], v["hi"]).cast("long"))
        ratio = lambda k: ((v["g"] - k) * (v["d"] - k)) / ((k + 1.0) * (v["n"] - v["g"] - v["d"] + k + 1.0))
        total = F.aggregate(ks, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("t")), lambda a, k: F.struct(
            (a["p"] * ratio(k)).alias("p"), (a["t"] + a["p"]).alias("t")))["t"]
        # The number of values whose cumulated probability stays below u.
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("k"))
        below = lambda t: F.aggregate(ks, start, lambda a, k: F.struct(
            (a["p"] * ratio(k)).alias("p"), (a["c"] + a["p"]).alias("c"),
            (a["k"] + F.when(a["c"] + a["p"] < t, 1).otherwise(0)).alias("k")))["k"]
        return F.least(v["lo"] + _bind(total * v["u"], below), v["hi"]).cast("long")

    return _bind(args, invert)


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Deal each source's number of blocks out to ``shards`` shards.

    ``quotas``: ``skey, quota``. Returns ``skey, bounds``: ``bounds[j]`` is
    the number of the source's blocks in shards 0 .. j, so shard j holds the
    blocks from ``bounds[j-1]`` to before ``bounds[j]``. A node of the tree is
    a row with one quota per source; a level halves every node's shards and
    draws the left half's blocks, source after source, without replacement.
    """
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("skey", "quota"))).alias("s"))
    nodes = root.select(F.lit(0).alias("lo"), F.lit(shards).alias("n"), F.col("s.skey").alias("skeys"),
                        F.col("s.quota").alias("quotas"))
    for _ in range(max(shards - 1, 0).bit_length()):
        left_n = F.floor(F.col("n") / 2).cast("int")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        nodes = nodes.withColumns({"left_n": left_n, "total": total})
        nodes = nodes.withColumn("draws", F.floor(F.col("total") * F.col("left_n") / F.col("n")).cast("long"))
        start = F.struct(F.col("total").alias("pool"), F.col("draws").alias("draws"),
                         F.expr("cast(array() as array<bigint>)").alias("taken"))

        def draw(a, q):
            u = (F.pmod(F.xxhash64(F.lit(seed), F.col("lo"), F.col("n"), F.size(a["taken"])),
                        F.lit(1 << 52)) + 0.5) / float(1 << 52)
            x = hypergeometric(a["pool"], q, a["draws"], u)
            return _bind(x, lambda v: F.struct(
                (a["pool"] - q).alias("pool"), (a["draws"] - v).alias("draws"),
                F.concat(a["taken"], F.array(v)).alias("taken")))

        nodes = nodes.withColumn("left", F.aggregate("quotas", start, draw)["taken"])
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("left_n").alias("n"), F.col("left").alias("quotas")),
            F.struct((F.col("lo") + F.col("left_n")).alias("lo"), (F.col("n") - F.col("left_n")).alias("n"),
                     F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))
        nodes = (nodes.select("skeys", F.explode(halves).alias("half")).filter(F.col("half.n") > 0)
                 .select("half.lo", "half.n", "skeys", "half.quotas"))
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("skeys", "quotas")).alias("s"))
    by_source = (leaves.groupBy(F.col("s.skeys").alias("skey"))
                 .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "s.quotas"))),
                                  lambda x: x["quotas"]).alias("q")))
    bounds = F.transform("q", lambda _, i: F.aggregate(F.slice("q", 1, i + 1), F.lit(0).cast("long"),
                                                       lambda a, x: a + x))
    return by_source.select("skey", bounds.alias("bounds"))


def plan_mix(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", carry=None, weights=WEIGHTS,
             share: float = SHARE, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Returns one row per input row: ``record`` (a struct of the columns in
    ``carry``, by default all), ``size``, ``source``, ``source_size``,
    ``target``, ``words`` (how many words the mix takes, repeats counted),
    ``copies`` (whole documents instead: 0 .. ``max_repeat``) and ``shards``
    (the output shard of each copy). Blocks are cut at words, so the last
    block may end inside a document: a source's ``words`` add up to its
    target, rounded down. ``copies`` rounds that document up or down, so
    whole documents differ from the target by half a document at most.
    Re-runs agree: the order depends on the rows and ``seed`` only.

    Defined cases: a null text has size 0; null is a source of its own,
    last in order; a source without words takes nothing; equal rows are
    separate rows; an empty table gives an empty result.

    A source's random order is held in buckets of ``ROWS_PER_BUCKET`` rows on
    average, ordered inside by hash, so a source with a third of all rows is
    spread over tasks like any other.
    """
    carry = list(docs.columns) if carry is None else list(carry)
    n_buckets = max(MIN_BUCKETS, -(-docs.count() // ROWS_PER_BUCKET))
    source = F.col(f"`{source_col}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("record"), source.alias("source"),
        F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)).alias("skey"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), source, F.col(f"`{text_col}`")).alias("h"))
    # The high bits choose the bucket, so hash order inside it stays random.
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 32), F.lit(n_buckets)).cast("int"))

    # Two small written tables: words per (source, bucket), and per source its
    # target and the shard bounds. Documents are read once for each.
    sums = stored(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"),
                                                     F.first("source").alias("source")), "mix-buckets")
    sizes = sums.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, weights, share, max_repeat).withColumn(
        "skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
    quotas = targets.select("skey", F.ceil(F.col("target") / F.lit(block_words)).cast("long").alias("quota"))
    targets = stored(targets.drop("source", "weight").join(split_quotas(quotas, shards, seed), "skey"),
                     "mix-targets")
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (sums.select("skey", "bucket", (F.sum("words").over(before) - F.col("words")).alias("offset"))
               .join(targets, "skey"))

    running = (Window.partitionBy("skey", "bucket").orderBy("h", "size")
               .rowsBetween(Window.unboundedPreceding, 0))
    placed = (rows.withColumn("inner", F.sum("size").over(running) - F.col("size"))
              .join(offsets, ["skey", "bucket"])
              .withColumn("start", F.col("offset") + F.col("inner")))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - passes * F.col("source_size")
    copies = (passes + F.when(F.col("start") + F.col("size") / 2 < rest, 1).otherwise(0)).cast("long")
    last = F.greatest(F.least(F.floor(rest) - F.col("start"), F.col("size")), F.lit(0))
    placed = placed.withColumns({"copies": copies, "words": (passes * F.col("size") + last).cast("long")})
    block = lambda p: F.floor((F.col("start") + p * F.col("source_size")) / F.lit(block_words))
    shard = lambda p: F.least(F.size(F.filter("bounds", lambda b: b <= block(p))), F.lit(shards - 1))
    at = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.col("copies") - 1, F.lit(0).cast("long"))), shard)).otherwise(F.expr("cast(array() as array<int>)"))
    return placed.select("record", "size", "source", "source_size", "target", "words", "copies",
                         at.alias("shards"))


def mix_documents(docs: DataFrame, shards: int = 16, seed: int = 0, **options) -> DataFrame:
    """The mix in whole documents: one row per taken copy, with ``record``, ``copy_no``,
    ``shard`` (int) and ``mix_key``, the random key of the local shuffle:
    inside a shard, rows are ordered by it (see ``write_mix``)."""
    taken = repeat_rows(plan_mix(docs, shards, seed, **options), "copies")
    return taken.select("record", "copy_no", F.element_at("shards", (F.col("copy_no") + 1).cast("int")).alias("shard"),
                        F.xxhash64(F.lit(seed + 1), "record", "copy_no").alias("mix_key"))


def write_mix(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, mode: str = "errorifexists",
              **options) -> None:
    """Write the mix as ``path/shard=N/part-*.parquet``, each shard in the
    order of its local shuffle; a shard is split over tasks by that order."""
    mixed = mix_documents(docs, shards, seed, **options)
    (mixed.repartitionByRange("shard", "mix_key").sortWithinPartitions("shard", "mix_key")
     .select("shard", "record.*").write.mode(mode).partitionBy("shard").parquet(path))
