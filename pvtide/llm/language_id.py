"""Language identification by rank-order profiles.

A profile is the list of a text's or a language's most frequent character
n-grams (one to three letters, words padded by one blank), most frequent
first. A document belongs to the language whose profile its own is closest
to by out-of-place distance: the sum, over the document's n-grams, of how
many places each lies off in the language's profile; an n-gram that is not
there costs a full profile length.

Counting and scoring run inside tasks, on code point arrays. Counts of all
training texts are combined per partition, then per language by Spark.
"""

from __future__ import annotations

import functools
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pvtide.llm.textkernels import freed

PROFILE_LENGTH = 400
MAX_N = 3
UNKNOWN = "und"
# Distinct n-grams a task holds per language before it passes its counts on.
FLUSH_GRAMS = 200_000
# Letters a document is ranked by at a time (a text of any length is read whole).
PIECE_CHARS = 1 << 20
# Held-out texts (and as many shuffled ones) that a cut between their scores takes.
MIN_HELD_OUT = 100


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, 0 for anything else (one-to-one
    lower cases only, so that a text maps character by character)."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams of letters with their counts.

    An n-gram is a number: 21 bits a character, blanks (word ends) as 1.
    Single blanks and n-grams that are blank inside are not n-grams.
    """
    grams, counts = [], []
    for start in range(0, len(text), PIECE_CHARS):
        # Two characters of overlap on the left would count twice; the blank
        # put between pieces costs at most two n-grams a million characters.
        piece = text[start:start + PIECE_CHARS].encode("utf-32-le", "surrogatepass")
        codes = _letters()[np.frombuffer(piece, np.uint32)]
        letter = codes > 0
        if not letter.any():
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank after each word
        c = np.concatenate([[1], np.where(letter, codes, 1)[keep], [1]])
        blank = c == 1
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        found = np.concatenate([c[~blank], two[~(blank[:-1] & blank[1:])], three[~blank[1:-1]]])
        found.sort()
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        grams.append(found[first])
        counts.append(np.diff(np.append(first, len(found))))
    if not grams:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(grams) == 1:
        return grams[0], counts[0]
    all_grams, where = np.unique(np.concatenate(grams), return_inverse=True)
    return all_grams, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def top_grams(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, ties by n-gram."""
    return grams[np.lexsort((grams, -counts))[:length]]


def _count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                names=["lang", "gram", "n"])
        held.clear()

    for batch in freed(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams, counts = ngram_counts(text.as_py())
            if not len(grams):
                continue
            parts = held.setdefault(lang, [])
            parts.append((grams, counts))
            size += len(grams)
            if size > 8 * FLUSH_GRAMS:
                for own in held.values():
                    g, where = np.unique(np.concatenate([x for x, _ in own]), return_inverse=True)
                    own[:] = [(g, np.bincount(where, weights=np.concatenate([c for _, c in own])).astype(np.int64))]
                size = sum(len(own[0][0]) for own in held.values())
                if size > FLUSH_GRAMS:
                    yield from flush()
                    size = 0
    yield from flush()


def train_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   length: int = PROFILE_LENGTH) -> dict[str, np.ndarray]:
    """One profile per language from all rows with a text and a label.

    Only the profiles (``length`` n-grams a language) come to the driver:
    the number of languages is that of the label set, not of the data. Of
    each language's counts, every task ranks its own share first.
    """
    rows = (labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
            .filter("lang is not null and text is not null"))
    counts = (rows.mapInArrow(_count_partition, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked = counts.withColumn("rank", rank).filter(F.col("rank") <= length)
    profiles: dict[str, list] = {}
    for row in ranked.select("lang", "gram", "rank").collect():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return {lang: np.array([g for _, g in sorted(own)], np.int64) for lang, own in sorted(profiles.items())}


class Scorer:
    """Out-of-place distances of documents to a set of profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = PROFILE_LENGTH):
        self.langs, self.length = sorted(profiles), length
        self.vocabulary = np.unique(np.concatenate([profiles[x] for x in self.langs])) \
            if self.langs else np.zeros(0, np.int64)
        #: places[language, n-gram of the vocabulary]; ``2 * length`` where it is missing
        self.places = np.full((len(self.langs), len(self.vocabulary) + 1), 2 * length, np.int64)
        for i, lang in enumerate(self.langs):
            self.places[i, np.searchsorted(self.vocabulary, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The closest language (ties: the first by name) and a score: 1 is
        the language's own order, 0 shares no n-gram with its profile."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """``predict`` and the number of n-grams the text was ranked by."""
        grams, counts = ngram_counts(text) if text else (np.zeros(0, np.int64),) * 2
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0, 0
        top = top_grams(grams, counts, self.length)
        at = np.minimum(np.searchsorted(self.vocabulary, top), len(self.vocabulary) - 1)
        at[self.vocabulary[at] != top] = len(self.vocabulary)
        off = np.abs(self.places[:, at] - np.arange(len(top)))
        distance = np.minimum(off, self.length).sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.length * len(top)), len(top)


def predict_languages(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text",
                      length: int = PROFILE_LENGTH, keep=()) -> DataFrame:
    """``kept`` (a struct of the ``keep`` columns), ``lang_pred``, ``score``
    and ``n_grams`` (how many n-grams were ranked) for every row of ``docs``.

    Defined cases: a null, empty or letterless text is ``und`` with score 0,
    as is any text if there are no profiles; ties go to the first language
    by name; repeated rows are scored alike; an empty table gives an empty
    result; texts are read whole, whatever their length. Only ``keep`` and
    the text are read, and inside a struct, so extra columns cannot clash.
    """
    scorer = Scorer(profiles, length)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            found = [scorer.judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _, _ in found], pa.string()),
                 pa.array([x for _, x, _ in found], pa.float64()), pa.array([x for _, _, x in found], pa.int32())],
                names=["kept", "lang_pred", "score", "n_grams"])

    schema = T.StructType([kept.schema["kept"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.IntegerType())])
    return kept.mapInArrow(run, schema)


def shuffled(text: str) -> str:
    """The text with its letters in another order (always the same one): as
    many of each, and as long words, but no language."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _letters()[codes] > 0
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    codes[letter] = rng.permutation(codes[letter])
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def size_class(n_grams: Column) -> Column:
    """Texts ranked by 1, 2 to 3, 4 to 7, ... n-grams; short ones score higher, noise too."""
    return F.length(F.bin(n_grams.cast("long")))


def score_cuts(unseen: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang",
               length: int = PROFILE_LENGTH) -> dict[tuple[str, int], float]:
    """The lowest score of a text that has a language, by language found and
    size class, from all labelled rows of ``unseen`` (not trained on).

    Every text is scored as it is and with its letters shuffled. The cut is
    the score that 99 % of the shuffled ones stay below or, where that comes
    near the texts as they are, half way between the shuffled ones' median
    and what 0.1 % of the others stay below. A language with fewer than
    MIN_HELD_OUT of either in a class takes the cut of all languages
    together; a class with fewer than that, the lowest cut of the others.
    Empty if there is none. One row per group comes to the driver.
    """
    rows = (unseen.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
            .filter("lang is not null and text is not null").select("text"))
    scorer = Scorer(profiles, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            texts = [t.as_py() for t in batch.column(0)]
            for noise in (False, True):
                found = [scorer.judge(shuffled(t) if noise else t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()),
                     pa.array([x for _, _, x in found], pa.int32()), pa.array([noise] * len(found), pa.bool_())],
                    names=["lang", "score", "n_grams", "noise"])

    scored = rows.mapInArrow(run, "lang string, score double, n_grams int, noise boolean").filter("n_grams > 0")
    scored = scored.withColumn("size", size_class(F.col("n_grams")))
    # Maps combine to one row per language, class and kind; grouping sets add all languages together.
    figures = scored.groupingSets([["lang", "size", "noise"], ["size", "noise"]], "lang", "size", "noise").agg(
        F.count("*").alias("n"), F.percentile_approx("score", [0.001, 0.5, 0.99], 10_000).alias("q"))
    groups = {(r["lang"], r["size"], r["noise"]): r["q"] for r in figures.collect() if r["n"] >= MIN_HELD_OUT}
    own = {}
    for (lang, size, noise), (_, median, high) in groups.items():
        if noise and (lang, size, False) in groups:
            own[lang, size] = min(high, (median + groups[lang, size, False][0]) / 2)
    if not own:
        return {}
    lowest = min(own.values())
    return {(lang, size): own.get((lang, size), own.get((None, size), lowest))
            for lang in profiles for size in range(1, length.bit_length() + 1)}


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is held out of training, by the CRC of its id
    (false for a null id, whose documents are not trained on either)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def held_out_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that ``training_rows`` leaves out by their id."""
    return docs.filter(held_out(F.col(f"`{id_col}`")))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that may be learnt from: those not held out."""
    key = F.col(f"`{id_col}`")
    return docs.filter(key.isNotNull() & ~held_out(key))
