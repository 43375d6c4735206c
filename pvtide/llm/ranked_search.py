"""Ranked lexical search: the best documents of each query item, exact.

1. Texts are read once per block of items: a document becomes its length and
   the items' terms it holds, with their counts, in a table of the shared
   folder. Counts over all rows of that table give N, L and every df.
2. Documents are searched in segments of bounded size. A segment holds a
   posting list per term (documents in ascending id, their integer impacts)
   and, over the lists, a sparse table of range maxima, so the largest impact
   of a term in any interval of documents takes two look-ups.
3. An item starts with one interval, the segment, bounded by the sum of its
   terms' maxima. The intervals of highest bound are opened first: one is
   split at the document of its largest impact, which is scored, and the two
   sides get bounds of their own. Short intervals are scored whole. It ends
   when no bound reaches the item's last place; a task keeps an item's best
   documents from segment to segment, so later ones start with that bar.
4. Tasks return their best documents per item; two steps of ranking (by hash
   of the document, then whole) leave the best of all.

All items of a segment go forward together, a few intervals each in a round,
so the work is done on arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pvtide.llm.common import stored
from pvtide.llm.textkernels import freed, utf8_bytes

PLACES = 50
# Terms are runs of other characters than these; A-Z count as a-z.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Terms, counted per item, that one pass over the texts looks for.
BLOCK_TERMS = 200_000
# A segment's documents and postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 1 << 20
# Texts are split into terms in groups of about this many bytes.
GROUP_BYTES = 4 << 20
# Intervals of up to so many documents are scored whole.
LEAF = 64
# Intervals of an item opened in a round, and items that go forward together
# (as the product of their number and of their most terms).
WIDTH, ROUND_CELLS = 8, 1 << 13
# Steps of the final ranking: hash groups of the first.
RANK_GROUPS = 32
NO_ID = np.iinfo(np.int64).max

_BETWEEN = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BETWEEN[_a:_b + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def weight(n_docs: int, df: int) -> int:
    """A term's weight, of N and its document frequency."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score."""
    if 50 * n_docs * int(length.max(initial=0)) < 1 << 63:
        m = 50 + 50 * length * n_docs // total
    else:
        m = np.array([50 + 50 * int(n) * n_docs // total for n in length], np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * m))


# --- terms inside tasks -----------------------------------------------------

def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts one after the other, and where each row's begin and end."""
    data, offsets = utf8_bytes(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    inside = ~_BETWEEN[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[row_starts] = inside[row_starts]  # terms end with their text
    starts = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(inside)])  # place among the bytes of terms
    ends = np.append(kept[starts], kept[-1]).astype(np.int64)
    letters = _FOLD[data[inside]]
    return (pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]),
            np.searchsorted(starts, offsets))


def _postings(vocabulary: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.large_binary())
        for batch in freed(batches):
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + GROUP_BYTES, side="right")) - 1)
                rows = min(last, batch.num_rows) - first
                terms, bounds = terms_of(batch.column(1).slice(first, rows))
                number = pc.index_in(terms, value_set=wanted)
                found = number.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rows), np.diff(bounds))[found]
                key = row * max(1, len(vocabulary)) + number.drop_null().to_numpy()
                key, times = np.unique(key, return_counts=True)
                ends = np.searchsorted(key, np.arange(rows + 1) * max(1, len(vocabulary))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))
                         for v in (key % max(1, len(vocabulary)), times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(np.diff(bounds)), *lists],
                                                 names=["id", "n", "terms", "tfs"])
                first += rows
    return run


# --- search inside tasks ----------------------------------------------------

class Segment:
    """Posting lists and range maxima of some documents.

    ``ids`` ascending; a posting is (term, document's place, impact)."""

    def __init__(self, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        self.ids, self.n_docs = ids, len(ids)
        some = impact > 0
        key = term[some].astype(np.int64) * self.n_docs + doc[some]
        order = np.argsort(key, kind="stable")
        self.key, self.impact = key[order], impact[some][order]
        self.doc = (self.key % max(1, self.n_docs)).astype(np.int32)
        self.starts = np.searchsorted(self.key, np.arange(n_terms + 1) * self.n_docs)
        longest = int(np.diff(self.starts).max(initial=0))
        # Level k has, for each posting, the place of the largest impact among
        # it and the 2^k - 1 after it. Lists lie one after the other; entries
        # that reach into the next list are never looked up.
        levels, at = [np.arange(len(self.key), dtype=np.int32)], 1
        while 2 * at <= longest:
            a, b = levels[-1][:-at], levels[-1][at:]
            levels.append(np.where(self.impact[b] > self.impact[a], b, a))
            at *= 2
        self.level_starts = np.cumsum([0] + [len(x) for x in levels])[:-1]
        self.table = np.concatenate(levels)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of the largest impacts of posting ranges, none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        base = self.level_starts[level]
        a, b = self.table[base + low], self.table[base + high - (1 << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of posting ranges (interval, term): the sum of the maxima, and the
        document of the largest."""
        some = high > low
        best = np.zeros(low.shape, np.int64)
        place = np.zeros(low.shape, np.int64)
        place[some] = self.largest(low[some], high[some])
        best[some] = self.impact[place[some]]
        top = best.argmax(axis=1)
        at = np.arange(len(low))
        return best.sum(axis=1), np.where(some[at, top], self.doc[place[at, top]], 0) if len(self.doc) else np.zeros(len(low), np.int64)


class Best:
    """The best (score, id) of each item so far, at most ``places``."""

    def __init__(self, items: int, places: int):
        self.score = np.zeros((items, places), np.int64)
        self.id = np.full((items, places), NO_ID)

    def may_enter(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
        """Whether a document with such a score (or less) and id (or higher) can still get a place."""
        last = self.score[item, -1]
        return (score > last) | ((score == last) & (score > 0) & (id_ < self.id[item, -1]))

    def add(self, item: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        good = self.may_enter(item, score, id_)
        item, score, id_ = item[good], score[good], id_[good]
        if not len(item):
            return
        touched = np.unique(item)
        places = self.score.shape[1]
        item = np.concatenate([item, np.repeat(touched, places)])
        score = np.concatenate([score, self.score[touched].ravel()])
        id_ = np.concatenate([id_, self.id[touched].ravel()])
        order = np.lexsort((id_, -score, item))
        item, score, id_ = item[order], score[order], id_[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < places
        self.score[item[kept], rank[kept]] = score[kept]
        self.id[item[kept], rank[kept]] = id_[kept]


def search(segment: Segment, items: np.ndarray, terms: np.ndarray, best: Best) -> int:
    """Bring the segment's documents into ``best`` for some items, whose terms
    are the rows of ``terms`` (-1: none). Returns how many documents were scored."""
    n_docs, scored = segment.n_docs, 0
    given = terms >= 0
    low = np.where(given, segment.starts[np.where(given, terms, 0)], 0)
    high = np.where(given, segment.starts[np.where(given, terms, 0) + 1], 0)
    bound, split = segment.bounds(low, high)
    # An interval: its item's row, documents [first, end), a range of each posting list.
    state = [np.arange(len(items)), np.zeros(len(items), np.int64), np.full(len(items), n_docs), low, high, bound, split]
    while True:
        row, first, end, low, high, bound, split = state
        on = (end > first) & (bound > 0)
        on[on] = best.may_enter(items[row[on]], bound[on], segment.ids[first[on]])
        row, first, end, low, high, bound, split = state = [x[on] for x in state]
        if not len(row):
            return scored
        order = np.lexsort((-bound, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        chosen = np.zeros(len(row), bool)
        chosen[order[rank < WIDTH]] = True
        rest = [x[~chosen] for x in state]
        short = end - first <= LEAF
        whole = np.flatnonzero(chosen & short)
        opened = np.flatnonzero(chosen & ~short)
        if len(whole):
            lows, counts = low[whole].ravel(), (high[whole] - low[whole]).ravel()
            upto = np.cumsum(counts)
            at = np.arange(upto[-1]) + np.repeat(lows - (upto - counts), counts)
            place = np.repeat(np.repeat(np.arange(len(whole)) * LEAF - first[whole], low.shape[1]), counts) + segment.doc[at]
            # Sums stay far below 2^53, so they are exact.
            score = np.bincount(place, segment.impact[at], len(whole) * LEAF).astype(np.int64)
            hit = np.flatnonzero(score)
            own = hit // LEAF
            best.add(items[row[whole][own]], score[hit], segment.ids[first[whole][own] + hit % LEAF])
            scored += int((end - first)[whole].sum())
        parts = [rest]
        if len(opened):
            row, first, end, low, high, split = (x[opened] for x in (row, first, end, low, high, split))
            cut = np.searchsorted(segment.key, np.where(given[row], terms[row], 0) * n_docs + split[:, None])
            cut = np.clip(cut, low, high)
            inside = cut < high
            there = np.zeros(cut.shape, bool)
            there[inside] = segment.doc[cut[inside]] == np.broadcast_to(split[:, None], cut.shape)[inside]
            score = np.zeros(cut.shape, np.int64)
            score[there] = segment.impact[cut[there]]
            best.add(items[row], score.sum(axis=1), segment.ids[split])
            scored += len(row)
            for a, b, lows, highs in ((first, split, low, cut), (split + 1, end, cut + there, high)):
                bound, next_split = segment.bounds(lows, highs)
                parts.append([row, a, b, lows, highs, bound, next_split])
        state = [np.concatenate(x) for x in zip(*parts, strict=True)]


@dataclass(frozen=True)
class Query:
    """A block of items: their numbers, terms (places in the vocabulary) by
    row with -1 behind the last, and what the corpus says of the terms."""

    numbers: np.ndarray
    terms: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    total: int

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items of similar numbers of terms, as ``(items, padded terms)``."""
        by_size = sorted(range(len(self.terms)), key=lambda i: len(self.terms[i]))
        start = 0
        while start < len(by_size):
            end = start + 1
            while end < len(by_size) and (end + 1 - start) * len(self.terms[by_size[end]]) <= ROUND_CELLS:
                end += 1
            own = by_size[start:end]
            padded = np.full((len(own), max(1, len(self.terms[own[-1]]))), -1, np.int64)
            for r, i in enumerate(own):
                padded[r, :len(self.terms[i])] = self.terms[i]
            yield np.array(own), padded
            start = end


def _segments(batch: pa.RecordBatch, query: Query) -> Iterator[Segment]:
    """The batch's documents in segments of bounded size, each by ascending id."""
    ids = batch.column(0).fill_null(NO_ID).to_numpy()
    length = batch.column(1).to_numpy()
    bounds = batch.column(2).offsets.to_numpy()[:batch.num_rows + 1]
    term, tf = (batch.column(c).values.to_numpy() for c in (2, 3))
    first = 0
    while first < len(ids):
        last = int(np.searchsorted(bounds, bounds[first] + SEGMENT_POSTINGS, side="right")) - 1
        last = min(max(last, first + 1), first + SEGMENT_DOCS, len(ids))
        order = np.argsort(ids[first:last], kind="stable")
        place = np.empty(last - first, np.int64)
        place[order] = np.arange(last - first)
        own = slice(bounds[first], bounds[last])
        doc = np.repeat(np.arange(last - first), np.diff(bounds[first:last + 1]))
        value = impacts(query.weights[term[own]], tf[own].astype(np.int64), length[first:last][doc], query.n_docs, query.total)
        yield Segment(ids[first:last][order], term[own], place[doc], value, len(query.weights))
        first = last


def _search(query: Query, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, groups = Best(len(query.terms), places), list(query.groups())
        for batch in freed(batches):
            for segment in _segments(batch, query):
                for items, terms in groups:
                    search(segment, items, terms, best)
        item, place = np.nonzero(best.score)
        ids = best.id[item, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.numbers[item]), pa.array(ids, mask=ids == NO_ID), pa.array(best.score[item, place])],
            names=["number", "id", "score"])
    return run


# --- on Spark ---------------------------------------------------------------

def terms_column(text: Column) -> Column:
    """The distinct terms of a text (null: none)."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({TERM_PATTERN})"), F.lit(1)))


def _ranked(found: DataFrame, keys: list, places: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= places)


def rank_documents(items: DataFrame, docs: DataFrame, places: int = PLACES, item_id: str = "item_id",
                   item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``places`` best documents of each
    item: score above 0, highest first, ties by ascending id.

    Items are taken in blocks of about BLOCK_TERMS terms; each costs one pass
    over the texts. Defined cases: null and empty texts have no terms, such
    an item has no rows and such a document counts for nothing; each row of
    ``items`` is an item of its own and each row of ``docs`` a document, also
    if ids or whole rows repeat; null document ids come last among equal
    scores; texts are read whole; empty tables give an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    asked = stored(items.select(F.col(f"`{item_id}`").alias("item_id"), terms_column(F.col(f"`{item_text}`")).alias("terms"))
                   .filter(F.size("terms") > 0).withColumn("number", F.monotonically_increasing_id()), "search-items")
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-n_terms // BLOCK_TERMS))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    results = [_rank_block(texts, asked.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block), places)
               for block in range(blocks)]
    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    some = _ranked(found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(RANK_GROUPS))), ["number", "part"], places)
    best = _ranked(some.select("number", "id", "score"), ["number"], places)
    return (best.join(asked.select("number", "item_id"), "number")
            .select("item_id", "rank", F.col("id").alias("doc_id"), "score"))


def _rank_block(texts: DataFrame, asked: DataFrame, places: int) -> DataFrame:
    rows = asked.select("number", "terms").collect()
    vocabulary = sorted({t for r in rows for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    held = stored(texts.mapInArrow(_postings([t.encode() for t in vocabulary]),
                                   "id long, n long, terms array<int>, tfs array<int>"), "search-postings")
    n_docs, total = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.collect():  # at most a row per term of the block
        weights[r.term] = weight(n_docs, r.df)
    query = Query(np.array([r.number for r in rows], np.int64), [np.array([place[t] for t in r.terms]) for r in rows],
                  weights, n_docs, max(1, total))
    return held.mapInArrow(_search(query, places), "number long, id long, score long")


def oracle_sql(places: int = PLACES) -> str:
    """The same ranking in DuckDB SQL, every document scored."""
    terms = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}')) as term"
    return f"""
        with words as (select doc_id, {terms} from documents),
        lengths as (select doc_id, count(*) as n from words group by doc_id),
        corpus as (select count(*) as docs, sum(n)::bigint as total from lengths),
        tfs as (select doc_id, term, count(*) as tf from words group by doc_id, term),
        weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w
                    from tfs, corpus group by term),
        measures as (select doc_id, 50 + (50 * n * docs) // total as m from lengths, corpus),
        asked as (select distinct item_id, {terms} from benchmark),
        scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
                   from asked join tfs using (term) join weights using (term) join measures using (doc_id)
                   group by item_id, doc_id),
        ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank,
                          doc_id, score from scores where score > 0)
        select item_id, rank, doc_id, score from ranked where rank <= {places}"""
