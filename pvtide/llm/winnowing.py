"""Document fingerprints by winnowing.

The k-grams of a text are its runs of K words, where a run without blanks
that is no word (longer than LONGEST_WORD, or in a script written without
blanks) counts as many words of one code point. A k-gram's hash is a rolling
cyclic polynomial (buzhash) over word hashes: moving on by a word rotates
the value, drops the oldest word and takes in the next. Of every window of
WINDOW consecutive k-grams the smallest hash is chosen, the rightmost one on
ties, and kept with its position. Two texts that share a run of at least
``K + WINDOW - 1`` words share a fingerprint inside it.

All array work is done with DataFrame functions on one row at a time; the
texts of a neighbouring pair meet by one shuffle into blocks of the id order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvtide.llm.common import default_parallelism

K = 5
WINDOW = 8
# Runs without blanks of more code points than this are broken into code points ...
LONGEST_WORD = 24
# ... and so is, whatever its length, a run with a letter of a script written without blanks.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
BLOCK_BYTES = 32 << 20

# Selection compares the upper 33 bits of a hash; the position fills the rest.
_POS_BITS = 30
_POS_MASK = (1 << _POS_BITS) - 1


def _rotate(x: Column, bits: int) -> Column:
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _broken(text: Column, words: Column, longest_word: int) -> Column:
    """``words`` with every run that is no word broken into code points."""
    # One look at the text spares ordinary prose the look at each word.
    any_run = text.rlike(rf"{UNSPACED}|[^\x20\x09-\x0D]{{{longest_word + 1}}}")
    parts = F.transform(words, lambda w: F.when((F.char_length(w) > longest_word) | w.rlike(UNSPACED), F.split(w, ""))
                        .otherwise(F.array(w)))
    return F.when(any_run, F.flatten(parts)).otherwise(words)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW,
                     longest_word: int | None = LONGEST_WORD) -> DataFrame:
    """``df`` with column ``out``: the fingerprint of column ``text``, an
    array of ``struct<pos: long, hash: long>`` in order of position.
    ``longest_word`` None leaves every run without blanks whole, as one word.

    A text of fewer than k words has one k-gram of all its words; fewer
    k-grams than a window form one window; a text without words (null, empty
    or blank) has an empty fingerprint.
    """
    t = f"__{out}"  # working columns, dropped again
    words, grams, packed = f"{t}_words", f"{t}_grams", f"{t}_packed"
    none = F.expr("cast(array() as array<bigint>)")
    full = F.coalesce(F.col(text), F.lit(""))
    split = F.filter(F.split(full, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    if longest_word is not None:
        df = df.withColumn(words, split)
        split = _broken(full, F.col(words), longest_word)
    df = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w))).withColumn(f"{t}_n", F.size(words))
    n = F.col(f"{t}_n")
    # Word hashes followed by k - 1 zeros, for texts of fewer than k words.
    df = df.withColumn(words, F.when(n < k, F.concat(words, F.array_repeat(F.lit(0).cast("long"), k - 1)))
                       .otherwise(F.col(words)))

    def gram(i):
        value = _rotate(F.get(F.col(words), i), k - 1)
        for j in range(1, k):
            value = value.bitwiseXOR(_rotate(F.get(F.col(words), i + j), k - 1 - j))
        return value

    df = df.withColumn(grams, F.when(n == 0, none).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram)))
    df = df.withColumn(packed, F.transform(grams, lambda g, i: F.shiftleft(
        F.shiftrightunsigned(g, 64 - 33), _POS_BITS).bitwiseOR(F.lit(_POS_MASK) - i)))
    m = F.size(packed)
    lowest = F.transform(F.sequence(F.lit(1), F.greatest(m - window, F.lit(0)) + 1),
                         lambda s: F.array_min(F.slice(F.col(packed), s, window)))
    chosen = F.array_distinct(F.when(m == 0, none).otherwise(lowest))

    def entry(c):
        pos = F.lit(_POS_MASK) - c.bitwiseAND(F.lit(_POS_MASK))
        return F.struct(pos.alias("pos"), F.get(F.col(grams), pos.cast("int")).alias("hash"))

    return df.withColumn(out, F.transform(chosen, entry)).drop(words, f"{t}_n", grams, packed)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def digest(fingerprint: Column) -> Column:
    """A fingerprint (hashes and positions) as a 128-bit hexadecimal string."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), fingerprint)), 16, "0") for s in (1, 2)]))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` for every row: the operator on its own."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "fingerprint")
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint")


def with_neighbour(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows beside the text of the next row in descending order of id.

    Returns rows ``id, text, next_text, is_head, ...`` and the window they
    are in, so that more of the next row can be looked up without a shuffle;
    rows with ``is_head`` only stand for the first row of the following
    block and are to be dropped at the end.

    The id order is cut at quantiles into blocks; every block's last row
    also needs the following block's first row, of which a copy is sent
    along (after the last block: the first block's). One shuffle of the texts.
    """
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(key.alias("id"), text.alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))

    total = rows.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = max(default_parallelism(spark), -(-total // (4 * BLOCK_BYTES)))
    blocks = 4 * tasks
    cuts = rows.select(F.percentile_approx("id", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    cuts = sorted(set(cuts or []))

    # Null ids come last, in order of their text's hash, in blocks of their own.
    width = (1 << 64) // blocks
    null_block = F.floor((F.lit((1 << 63) - 1) / width) - F.col("h") / F.lit(width)).cast("int")
    rows = rows.withColumns({
        "v": F.coalesce("id", "h"),
        "block": F.when(F.col("id").isNotNull(), F.lit(len(cuts)) - _position(F.col("id"), cuts))
                  .otherwise(F.lit(len(cuts) + 2) + null_block)})

    first = rows.groupBy("block").agg(F.max("v").alias("v"))  # at most two rows per block number
    order = Window.orderBy("block")
    around = first.withColumn("before", F.lag("block").over(order)).withColumn(
        "before", F.coalesce("before", F.max("block").over(Window.partitionBy())))
    heads = (rows.join(F.broadcast(around), ["block", "v"])
             .groupBy(F.col("before").alias("block")).agg(F.max_by("text", F.struct("h", "text")).alias("text")))
    heads = heads.select(F.lit(None).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("h"),
                         F.lit(0).cast("long").alias("v"), "block", F.lit(True).alias("is_head"))
    both = rows.select("id", "text", "h", "v", "block", F.lit(False).alias("is_head")).unionByName(heads)
    window = Window.partitionBy("block").orderBy("is_head", F.desc("v"), F.desc("h"))
    placed = both.repartition(tasks, "block").withColumn("next_text", F.lead("text").over(window))
    return placed, window


def _position(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` lie below value: found in two steps
    of about sqrt(len(cuts)) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    arr = lambda xs: F.expr(f"array({','.join(f'{x}L' for x in xs)})")
    coarse = F.size(F.filter(arr([c[0] for c in chunks]), lambda b: b < value))
    fine = F.expr("array(" + ",".join(f"array({','.join(f'{x}L' for x in c)})" for c in chunks) + ")")
    inside = F.size(F.filter(F.get(fine, coarse - 1), lambda b: b < value))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * F.lit(step) + inside)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      longest_word: int | None = None) -> DataFrame:
    """Every text's fingerprint beside that of its edited text and of the
    next document.

    The edited text is the text with its last ``floor(n_chars / 2)`` code
    points replaced by the first as many (or all) of the next document's in
    descending order of id; after the last comes the first. ``longest_word``:
    as in ``with_fingerprint`` (query op9 gives LONGEST_WORD). Returns
    ``doc_id, n_chars, edited_text, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    Defined cases: a null text is empty; null ids come last, ordered by
    their texts' hash; rows of equal id are ordered by their texts' hash; a
    single document is its own next; two empty fingerprints have likeness 1;
    an empty table gives an empty result; other columns are ignored.
    """
    placed, window = with_neighbour(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    placed = placed.withColumn("n_chars", n).withColumn("edited_text", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    placed = placed.drop("next_text")
    placed = with_fingerprint(placed, "text", "fingerprint", longest_word=longest_word)
    placed = with_fingerprint(placed.drop("text"), "edited_text", "edited_fingerprint", longest_word=longest_word)
    placed = placed.withColumn("next_hashes", F.lead("fingerprint.hash").over(window))
    return placed.filter(~F.col("is_head")).select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_text",
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint.hash"), F.col("edited_fingerprint.hash")).alias("near_edited"),
        likeness(F.col("fingerprint.hash"), F.col("next_hashes")).alias("near_next"))
