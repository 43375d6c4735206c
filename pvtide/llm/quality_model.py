"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. The
label model (two classes; every labeller has its own accuracy on either)
is fitted by expectation-maximisation on the counts of vote patterns over
all documents: at most 3 ** len(LABELLERS) rows, so the whole corpus takes
part and only the counts come to the driver. The posterior of a document's
pattern is its probabilistic label, on which a linear scorer over hashed
features is trained.

Text statistics and hashed features come from array kernels in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.llm.common import shared_folder
from pvtide.llm.textkernels import freed, mix64, utf8_pieces, word_hashes

HASH_BITS = 16
# Documents that the scorer learns from at most, on average (chosen by hash of the text).
MAX_TRAINING_ROWS = 20_000
EM_ROUNDS = 200

# Frequent function words of the languages served.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on by this are be at from or an which "
    "der die das und in den von zu mit sich des ist nicht ein eine als auch für "
    "le la les de des et en un une du que qui est pour dans par au sur ce "
    "el los las y que un una por con para del se es su al lo como"
).split()
_HARD_SYMBOLS = b"#$%&*|!<>{}[]^~=+_\\/@`"

GOOD, BAD, ABSTAIN = 1, 0, -1
#: name, index of the statistic, bad below, good from, good up to, bad above (None: no such bound)
LABELLERS = (
    ("symbols", "symbol_ratio", None, 0.0, 0.015, 0.05),
    ("noisy_tokens", "noisy_ratio", None, 0.0, 0.03, 0.1),
    ("symbol_runs", "run_ratio", None, 0.0, 0.005, 0.02),
    ("loose_symbols", "loose_ratio", None, 0.0, 0.01, 0.05),
    ("capitals", "capital_ratio", None, 0.0, 0.15, 0.5),
    ("echoes", "echo_ratio", None, 0.0, 0.03, 0.15),
    ("variety", "variety", 0.15, 0.45, 1.0, None),
    ("repeated_lines", "repeated_line_ratio", None, 0.0, 0.05, 0.3),
    ("function_words", "function_ratio", 0.02, 0.08, 1.0, None),
    ("length", "n_words", 5, 40, None, None),
)
#: statistic -> its factor when cut into twentieths for the scorer
STATISTICS = {"symbol_ratio": 4.0, "noisy_ratio": 1.0, "run_ratio": 4.0, "loose_ratio": 2.0, "capital_ratio": 1.0,
              "echo_ratio": 2.0, "variety": 1.0, "repeated_line_ratio": 1.0, "function_ratio": 1.0,
              "word_length": 1 / 16, "n_words": 0.0}


def _table(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_SYMBOL = _table(_HARD_SYMBOLS)
_CAPITAL = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 0xC0)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Words of the statistics are runs of letters and digits; every other ASCII byte separates.
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LINE_END = _table(b"\n\r")
_BLANK = _table(b" \t\n\v\f\r")


def _hash_words(words) -> np.ndarray:
    joined = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(joined), np.uint8)
    return np.unique(word_hashes(data, np.array([0, len(data)]), _BETWEEN)[0])


_FUNCTION_HASHES = _hash_words(FUNCTION_WORDS)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _same_as_before(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    same = np.zeros(len(items), bool)
    same[1:] = items[1:] == items[:-1]
    same[bounds[:-1][bounds[:-1] < len(items)]] = False
    return same


def _token_shares(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's tokens between white space: the share that holds a hard
    symbol, and the share that holds neither letter nor digit."""
    rows = len(offsets) - 1
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[row_starts] = inside[row_starts]
    token = np.cumsum(begins) - 1
    n = int(token[-1]) + 1 if len(data) else 0
    noisy, filled = np.zeros(n, bool), np.zeros(n, bool)
    noisy[token[_SYMBOL[data]]] = True
    filled[token[~_BETWEEN[data]]] = True
    bounds = np.searchsorted(np.flatnonzero(begins), offsets) if n else np.zeros(rows + 1, np.int64)
    count = np.maximum(np.diff(bounds), 1)
    return _per_row(noisy, bounds) / count, _per_row(~filled, bounds) / count


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(statistics [row, k], word hashes, word bounds)`` of a piece of texts."""
    low = _LOWER[data]
    words, bounds = word_hashes(low, offsets, _BETWEEN)
    lines, line_bounds = word_hashes(data, offsets, _LINE_END)
    n_words = np.diff(bounds)
    n_lines = np.diff(line_bounds)
    filled = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(_per_row(_LETTER[data], offsets), 1)
    repeated = np.array([n - len(np.unique(lines[a:b])) for n, a, b in
                         zip(n_lines, line_bounds[:-1], line_bounds[1:], strict=True)])
    # Variety over the first words up to 200 and likewise over every further 200, so that
    # long texts, which repeat common words, compare with short ones.
    variety = np.array([_variety(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    alnum = _per_row(~_BETWEEN[data] & ((data < 0x80) | (data >= 0xC0)), offsets)
    symbol = _SYMBOL[data]
    noisy, loose = _token_shares(data, offsets)
    columns = {
        "symbol_ratio": _per_row(symbol, offsets) / filled,
        "noisy_ratio": noisy,
        "run_ratio": _per_row(symbol & _same_as_before(data, offsets), offsets) / filled,
        "loose_ratio": loose,
        "capital_ratio": _per_row(_CAPITAL[data], offsets) / letters,
        "echo_ratio": _per_row(_same_as_before(words, bounds), bounds) / np.maximum(n_words, 1),
        "variety": variety,
        "repeated_line_ratio": repeated / np.maximum(n_lines, 1),
        "function_ratio": _per_row(np.isin(words, _FUNCTION_HASHES), bounds) / np.maximum(n_words, 1),
        "word_length": alnum / np.maximum(n_words, 1),
        "n_words": n_words,
    }
    return np.stack([np.asarray(columns[name], np.float64) for name in STATISTICS], axis=1), words, bounds


def _variety(words: np.ndarray, window: int = 200) -> float:
    if not len(words):
        return 0.0
    parts = [words[i:i + window] for i in range(0, len(words), window)]
    return float(sum(len(np.unique(p)) for p in parts)) / len(words)


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes [row, labeller] on rows of statistics."""
    out = np.full((len(stats), len(LABELLERS)), ABSTAIN, np.int8)
    index = {name: i for i, name in enumerate(STATISTICS)}
    for j, (_, name, bad_below, good_from, good_to, bad_above) in enumerate(LABELLERS):
        x = stats[:, index[name]]
        good = x >= good_from
        if good_to is not None:
            good &= x <= good_to
        out[good, j] = GOOD
        if bad_below is not None:
            out[x < bad_below, j] = BAD
        if bad_above is not None:
            out[x > bad_above, j] = BAD
    out[stats[:, index["n_words"]] == 0] = BAD
    return out


def pattern_numbers(v: np.ndarray) -> np.ndarray:
    """Every row of votes as one number in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(len(LABELLERS), dtype=np.int64))


def pattern_votes(numbers: np.ndarray) -> np.ndarray:
    return (numbers[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def fit_label_model(numbers: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> dict:
    """Expectation-maximisation over vote patterns with their counts.

    Labellers are independent given the class. Each looks for another kind
    of fault, so a bad text seldom has more than one or two bad votes; the
    start therefore takes a text with any bad vote for bad, at odds that fall
    with the number of good votes against it. Counts of one half keep the
    estimates off 0 and 1. Returns
    the class prior, ``accuracy[class, labeller]`` (share of right votes
    among the votes cast) and the posterior of good for every pattern.
    """
    v = pattern_votes(numbers)
    cast = v != ABSTAIN
    good_votes = v == GOOD
    weight = counts.astype(np.float64)
    share = (good_votes.sum(1) + 0.5) / (cast.sum(1) + 1.0)
    posterior = np.where((v == BAD).any(1), 0.2 * share, share)
    for _ in range(rounds):
        g, b = weight * posterior, weight * (1 - posterior)
        prior = (g.sum() + 0.5) / (weight.sum() + 1.0)
        right_good = (g @ good_votes + 0.5) / (g @ cast + 1.0)
        right_bad = (b @ (v == BAD) + 0.5) / (b @ cast + 1.0)
        log_good = np.log(prior) + good_votes @ np.log(right_good) + (v == BAD) @ np.log(1 - right_good)
        log_bad = np.log(1 - prior) + good_votes @ np.log(1 - right_bad) + (v == BAD) @ np.log(right_bad)
        new = 1.0 / (1.0 + np.exp(np.clip(log_bad - log_good, -500, 500)))
        done = np.abs(new - posterior).max(initial=0.0) < 1e-9
        posterior = new
        if done:
            break
    return {"prior": float(prior) if len(weight) else 0.5, "posterior": posterior,
            "accuracy": np.stack([right_good, right_bad]) if len(weight) else np.zeros((2, len(LABELLERS)))}


# --- hashed features ------------------------------------------------------------

SHAPE_STEPS = 20


def hashed_features(stats: np.ndarray, words: np.ndarray, bounds: np.ndarray
                    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row, sorted feature numbers below ``2 ** HASH_BITS`` and values: words,
    as a vector of length 1, and one feature of value 1 per statistic and twentieth."""
    mask = np.uint64((1 << HASH_BITS) - 1)
    scale = np.array(list(STATISTICS.values()))
    steps = np.clip(stats * scale * SHAPE_STEPS, 0, SHAPE_STEPS).astype(np.int64)
    steps[:, -1] = np.minimum(np.log2(stats[:, -1] + 1), SHAPE_STEPS).astype(np.int64)
    shape = mix64((np.arange(stats.shape[1]) * 64 + steps + 1).astype(np.uint64)) & mask
    buckets = words & mask
    for i in range(len(stats)):
        own, n = np.unique(buckets[bounds[i]:bounds[i + 1]], return_counts=True)
        value = n / np.sqrt(np.square(n, dtype=np.float64).sum()) if len(n) else n.astype(np.float64)
        at = np.concatenate([own, shape[i]]).astype(np.int64)
        numbers, where = np.unique(at, return_inverse=True)
        yield numbers, np.bincount(where, weights=np.concatenate([value, np.ones(len(shape[i]))]))


def _with_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in freed(batches):
        for first, data, offsets in utf8_pieces(batch.column(1)):
            stats, _, _ = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(stats)), pa.array(pattern_numbers(votes(stats)))],
                names=["kept", "pattern"])


_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())),
                     ("values", pa.list_(pa.float64()))])


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns and features; a sparse vector in the layout Spark stores it in."""
    for batch in freed(batches):
        for _, data, offsets in utf8_pieces(batch.column(0)):
            stats, words, bounds = statistics(data, offsets)
            vectors = [{"type": 0, "size": 1 << HASH_BITS, "indices": i.astype(np.int32), "values": v}
                       for i, v in hashed_features(stats, words, bounds)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pattern_numbers(votes(stats))), pa.array(vectors, _SPARSE)], names=["pattern", "features"])


def train_scorer(docs: DataFrame, posterior: dict[int, float]) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic scorer trained on posteriors.

    Every chosen text is there twice, as good and as bad, weighted by its
    posterior. At most about MAX_TRAINING_ROWS texts, chosen by their hash.
    """
    n = docs.count()
    if not n or not posterior:
        return np.zeros(1 << HASH_BITS), 0.0
    share = min(1.0, MAX_TRAINING_ROWS / n)
    chosen = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    path = shared_folder(docs.sparkSession, "quality-training")
    layout = VectorUDT.sqlType().simpleString()
    chosen.mapInArrow(_training_rows, f"pattern long, features {layout}").write.parquet(path)
    schema = T.StructType([T.StructField("pattern", T.LongType()), T.StructField("features", VectorUDT())])
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    good = F.create_map(*[F.lit(x) for item in posterior.items() for x in item])[F.col("pattern")]
    both = rows.withColumn("p", good).select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))).alias("x"))
    both = both.select("features", "x.label", "x.w")
    model = LogisticRegression(weightCol="w", regParam=1e-2, maxIter=30).fit(both)
    return model.coefficients.toArray(), float(model.intercept)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
                    ) -> DataFrame:
    """Quality of every row of ``docs``.

    Returns ``doc_id``, ``quality`` (the scorer's probability of good, 0 to
    1), ``weak_label`` (posterior of the document's votes), ``votes`` (one
    character per labeller: ``+``, ``-`` or ``.``) and ``keep`` (quality at
    least ``threshold``).

    Defined cases: a null or empty text has no words, gets bad votes from
    all labellers and is never kept (quality 0); repeated rows are scored
    alike; an empty table gives an empty result; texts are read whole; other
    columns are ignored.
    """
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("doc_id")).alias("kept"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    counts = (rows.mapInArrow(_with_patterns, f"kept {kept_type}, pattern long")
              .groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 3 ** 8 rows
    counts = sorted((r["pattern"], r["n"]) for r in counts)
    numbers = np.array([p for p, _ in counts], np.int64)
    model = fit_label_model(numbers, np.array([n for _, n in counts], np.int64))
    posterior = {int(p): float(x) for p, x in zip(numbers, model["posterior"], strict=True)}
    weights, intercept = train_scorer(rows, posterior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {ABSTAIN: ".", GOOD: "+", BAD: "-"}
        for batch in freed(batches):
            for first, data, offsets in utf8_pieces(batch.column(1)):
                stats, words, bounds = statistics(data, offsets)
                v = votes(stats)
                raw = np.array([weights[i] @ x for i, x in hashed_features(stats, words, bounds)]) + intercept
                quality = np.where(stats[:, -1] > 0, 1.0 / (1.0 + np.exp(np.clip(-raw, -500, 500))), 0.0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(stats)), pa.array(quality),
                    pa.array([posterior.get(int(p), 0.5) for p in pattern_numbers(v)], pa.float64()),
                    pa.array(["".join(names[int(x)] for x in own) for own in v], pa.string()),
                    pa.array(quality >= threshold)],
                    names=["kept", "quality", "weak_label", "votes", "keep"])

    schema = f"kept {kept_type}, quality double, weak_label double, votes string, keep boolean"
    return rows.mapInArrow(run, schema).select("kept.*", "quality", "weak_label", "votes", "keep")
