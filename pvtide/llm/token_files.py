"""Token ids of a corpus in files, Simple-8b coded, in ascending id order.

1. Rows are range-partitioned and sorted by document id: one shuffle of the
   texts. Rows that tie on the id are ordered by their text, and the ranges
   end with a row's place in its input, so a third of all rows with one id
   is still split over tasks.
2. A task encodes its range with the tokenizers library and writes segments:
   rows of a Parquet table with the documents' ids and lengths and one
   Simple-8b payload (``simple8b``). A segment holds whole documents, about
   SEGMENT_IDS ids of them; a longer document is a segment of its own, whose
   block table still gives access to any part. Spark's committer publishes
   the table whole, so a task that is run again leaves nothing behind.
3. Reading needs only the segments: a document begins after the ids of all
   parts before its own (one row per part, summed in order), of the segments
   before, and of the documents before it in the segment.

Encoding: a byte-level tokenizer's pattern never joins white space to a
visible character before it, nor a punctuation mark to a letter or digit
before it. So texts may be cut in such places without changing their ids
(``_cuts``), and each distinct piece is encoded once per worker (a bounded
cache). Other tokenizers get whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pvtide.llm import simple8b
from pvtide.llm.textkernels import freed, utf8_bytes

SEGMENT_IDS = 1 << 18
# Texts are encoded in groups of about this many bytes.
GROUP_BYTES = 4 << 20
# Pieces a worker remembers; it forgets all of them when there are more.
CACHED_PIECES = 1_500_000
# Threads of the library in a task, unless RAYON_NUM_THREADS says otherwise.
THREADS = "2"
MAX_TOKENIZER_BYTES = 64 << 20
# Pieces that may be encoded as lines of one text (at most a blank, then
# visible ASCII and Latin letters), and lines in such a text.
PLAIN = "^ ?[!-~\u00c0-\u024f]+$"
LINES = 512

SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType())])


def load_tokenizer(path: str) -> str:
    """The tokenizer's JSON; refuses files too large to ship with tasks."""
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


# --- inside tasks ---------------------------------------------------------

def _takes_pieces(description: dict) -> bool:
    """Whether texts may be cut as ``_cuts`` does: a plain byte-level pattern
    and nothing before it."""
    before = description.get("pre_tokenizer") or {}
    return (description.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True))


def _bytes_where(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low:high + 1] = True
    return table


_SPACE = _bytes_where((0x09, 0x0D), (0x20, 0x20))
_MARK = _bytes_where((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_BREAK = _SPACE | _MARK
# First bytes of characters that are never white space (two-byte ones from
# U+00C0 on, most of the others), and of those that are always letters here.
_VISIBLE = _bytes_where((0x21, 0x7E), (0xC3, 0xDF), (0xE0, 0xE0), (0xE4, 0xED), (0xF0, 0xF4))
_LETTER = _bytes_where((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xD0, 0xD1))


def _cuts(data: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 bytes, rows' beginnings included:

    - in front of ASCII white space that follows a visible character;
    - in front of an ASCII mark that follows an ASCII letter or digit, a
      Cyrillic letter, or a Latin letter of U+00C0 to U+00FF;
    - behind a line feed between two visible characters.
    """
    cut = np.zeros(len(data) + 1, bool)
    at = np.flatnonzero(_BREAK[data])
    at = at[at > 0]
    lead = data[at - 1].copy()
    latin = np.zeros(len(at), bool)
    far = np.flatnonzero(lead >= 0x80)  # the character in front has several bytes: find its first
    first = at[far] - 1
    for _ in range(3):
        first = first - ((data[first] & 0xC0 == 0x80) & (first > 0))
    lead[far] = data[first]
    second = data[first + 1]
    latin[far] = (data[first] == 0xC3) & (second != 0x97) & (second != 0xB7)  # not the signs for times and divided by
    space = _SPACE[data[at]]
    cut[at] = np.where(space, _VISIBLE[lead], _LETTER[lead] | latin)
    line = at[space & (data[at] == 0x0A) & cut[at]] + 1
    line = line[line < len(data)]
    cut[line[_VISIBLE[data[line]]]] = True
    cut[row_starts] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Ids of texts, each distinct piece encoded once."""

    def __init__(self, description: str):
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(description)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.in_pieces = _takes_pieces(json.loads(description))
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ends, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of texts that are encoded one by one."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(texts), 1 << 15):
            found = [e.ids for e in self.library.encode_batch_fast(texts[start:start + (1 << 15)],
                                                                   add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode_lines(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain pieces, as lines of longer texts: a line feed in
        front of them, or behind, changes no ids and has an id of its own."""
        strings = pieces.to_pylist()
        lines = ["\n".join(strings[i:i + LINES]) for i in range(0, len(strings), LINES)]
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for found in self.library.encode_batch_fast(lines, add_special_tokens=False):
            own = np.array(found.ids, np.uint32)
            feeds = np.flatnonzero(own == self.feed)
            lengths.append(np.diff(np.concatenate([[-1], feeds, [len(own)]])) - 1)
            ids.append(own[own != self.feed])
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        return (ids, lengths) if len(lengths) == len(pieces) else self._encode(strings)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The places of distinct pieces among those known; new ones are added."""
        found = pc.index_in(pieces, value_set=self.known)
        if found.null_count:
            new = pieces.filter(found.is_null())
            if len(self.known) and len(self.known) + len(new) > CACHED_PIECES:
                self._forget()
                return self._numbers(pieces)
            plain = pc.match_substring_regex(new, PLAIN) if self.feed is not None else pa.array(np.zeros(len(new), bool))
            parts = [(new.filter(plain), self._encode_lines), (new.filter(pc.invert(plain)), lambda x: self._encode(x.to_pylist()))]
            for some, encode in parts:
                ids, lengths = encode(some)
                self.known = pa.concat_arrays([self.known, some])
                self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
                self.flat = np.concatenate([self.flat, ids])
            is_new, plain = found.is_null().to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False)
            numbers = np.empty(len(new), np.int64)
            numbers[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = \
                np.arange(len(self.known) - len(new), len(self.known))
            out = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out[is_new] = numbers
            return out
        return found.to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), and the number of each text's."""
        if not self.in_pieces:
            return self._encode(texts.to_pylist())
        data, offsets = utf8_bytes(texts)
        starts = _cuts(data, offsets[:-1][np.diff(offsets) > 0]) if len(data) else np.zeros(0, np.int64)
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary)
        begins, lengths = self.ends[number], self.ends[number + 1] - self.ends[number]
        codes = coded.indices.to_numpy()
        counts = lengths[codes]
        upto = np.concatenate([[0], np.cumsum(counts)])
        kind = np.int32 if max(upto[-1], len(self.flat)) < 1 << 31 else np.int64
        at = np.repeat((begins[codes] - upto[:-1]).astype(kind), counts)
        at += np.arange(upto[-1], dtype=kind)
        return self.flat[at], np.diff(upto[np.searchsorted(starts, offsets)])


@functools.lru_cache(maxsize=2)
def _encoder(description: str) -> Encoder:
    return Encoder(description)


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``most``; a larger row is a run of its own."""
    upto, start = np.concatenate([[0], np.cumsum(sizes)]), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, side="right")) - 1)
        yield start, end
        start = end


def _segments(description: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(description), TaskContext.get().partitionId()
        segment = first = 0
        for batch in freed(batches):
            texts = batch.column(1).fill_null("")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for low, high in _groups(sizes, GROUP_BYTES):
                ids, lengths = encoder(texts.slice(low, high - low))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), end_id)
                    lengths = lengths + 1
                upto = np.concatenate([[0], np.cumsum(lengths)])
                for a, b in _groups(lengths, SEGMENT_IDS):
                    own = ids[upto[a]:upto[b]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first]),
                         pa.array([len(own)]),
                         pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(low + a, b - a)),
                         pa.array([lengths[a:b]], pa.list_(pa.int64())), pa.array([simple8b.encode(own)], pa.binary())],
                        names=SEGMENTS.names)
                    segment, first = segment + 1, first + len(own)
    return run


def _documents(with_ids: bool):
    """Rows of the documents in segments; ``start`` counts inside the part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for i in range(batch.num_rows):
                part, first, doc_ids, lengths, payload = (batch.column(c)[i] for c in range(5))
                doc_ids, lengths = doc_ids.values, lengths.values.to_numpy()
                ids = simple8b.decode(payload.as_buffer())
                upto = np.concatenate([[0], np.cumsum(lengths)])
                if upto[-1] != len(ids):
                    raise ValueError("a segment's ids and documents do not agree")
                columns = [pa.array(np.full(len(lengths), part.as_py(), np.int32)), doc_ids,
                           pa.array(first.as_py() + upto[:-1]), pa.array(lengths)]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(pa.array(upto), pa.array(ids.view(np.int64)))
                                   .cast(pa.list_(pa.int64())))
                else:
                    data = ids.astype("<u4").tobytes()
                    columns.append(pa.array([zlib.crc32(data[4 * a:4 * b])
                                             for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)],
                                            pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "content"])
    return run


# --- on Spark ---------------------------------------------------------------

def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 0) -> None:
    """Write the ids of all texts to the new folder ``path``, in ascending
    order of the document ids; ``end_id`` follows each document's ids (None:
    nothing does). ``tokenizer`` is the JSON of a tokenizers file.

    Defined cases: a null text counts as empty; an empty text has only the
    end id; null ids come first; rows of one id follow each other ordered by
    their text's hash, then text, so reruns agree; repeated rows are written
    as often as they occur; a text is encoded whole, however long; special
    tokens' strings are ordinary text; an empty table gives an empty file
    set; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    arranged = (rows.repartitionByRange("id", "hash", "place").sortWithinPartitions("id", "hash", "text")
                .select("id", "text"))
    arranged.mapInArrow(_segments(tokenizer, end_id), SEGMENTS).write.parquet(path)


def _placed(spark: SparkSession, path: str, with_ids: bool, kind: str) -> DataFrame:
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, that is per task of the write: bounded by spark.sql.shuffle.partitions.
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = (segments.select("part", "first", "doc_ids", "lengths", "payload")
            .mapInArrow(_documents(with_ids), f"part int, doc_id long, start long, n_tokens long, content {kind}"))
    return (rows.join(F.broadcast(bases), "part")
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "content"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files;
    ``start`` counts the ids of all documents before it."""
    return _placed(spark, path, True, "array<bigint>").withColumnRenamed("content", "ids")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from its
    decoded ids: their unsigned CRC-32 as little-endian 32-bit numbers."""
    return _placed(spark, path, False, "bigint").withColumnRenamed("content", "ids_crc32")
