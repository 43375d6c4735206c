"""Small frames that hold every awkward case the operators promise to handle."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])
# Extra columns named like what operators compute.
CLASHES = ["h", "id", "n", "record", "shard", "slot", "kept", "keep_id", "size", "bucket", "block", "rule",
           "score", "lang_pred", "copies", "class_id", "digest", "words", "ids", "start", "target", "skey",
           "col", "pos", "k", "d", "v", "is_head", "host", "path", "label", "features", "lines", "text_md5"]


def frame(spark, rows, clash=False):
    """Documents from (doc_id, text[, lang, source]) tuples."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
             None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clash:
        df = df.selectExpr("*", *[f"doc_id as `{c}`" for c in CLASHES])
    return df


def words(n, seed=0, vocabulary=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, share, seed=0):
    """The text with about ``share`` of its words replaced."""
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in text.split(" "))


#: nulls in every column, empty and blank texts, one very long text, ties, repeated rows
AWKWARD = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "fr", None),
    (3, None, "en", "a"), (4, "", None, "b"), (5, " \t\n ", "en", "b"),
    (None, "no id at all here", "en", "a"), (None, None, None, None),
    (6, words(30_000, 5), "de", "c"), (7, "x" * 100_000, "de", "c"),
    (8, "Ünï çödé 漢字 🙂 é", "es", "ü"), (8, "Ünï çödé 漢字 🙂 é", "es", "ü"),
    (9, "one two", "en", ""), (10, "12345 !!! ###", "en", "a"), (11, "a\u0000b\r\nc", "en", "d"),
]
