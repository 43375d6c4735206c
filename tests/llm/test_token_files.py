import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from pvtide.llm import queries, simple8b, token_files
from pvtide.llm.common import shared_folder

tokenizers = pytest.importorskip("tokenizers")
TRICKY = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "x\u00a0 y", "x\u3000 y z", "\u200b a", "don't they're 12 3",
          "tab\t x", "end.  ", "<|endoftext|> a <|endoftext|>", "漢字 かな 🙂 👩‍👩‍👧", "a\u0000 b", "\u180e x", "\x1c y\x85 z", "word " * 900]


@pytest.fixture(scope="module")
def description():
    return token_files.load_tokenizer(queries.TOKENIZER)


@pytest.fixture(scope="module")
def library(description):
    found = tokenizers.Tokenizer.from_str(description)
    found.encode_special_tokens = True
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2 ** 16), st.integers(0, 2 ** 64 - 1), st.just(0)), max_size=400),
       st.integers(1, 90), st.data())
def test_coding_round_trip_and_ranges(ids, block, data):
    payload = simple8b.encode(np.array(ids, np.uint64), block)
    assert simple8b.decode(payload).tolist() == ids and simple8b.count(payload) == len(ids)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(0, len(ids) + 5))
    assert simple8b.decode(payload, a, b).tolist() == ids[a:b]


def test_words_take_the_widest_selector():
    """Word by word against a plain greedy coder."""
    rng = random.Random(3)
    ids = [rng.randrange(2 ** rng.choice([0, 1, 4, 9, 15, 16, 33, 60, 64])) for _ in range(3000)] + [0] * 700
    payload = simple8b.encode(np.array(ids, np.uint64), 256)
    expected = []
    for start in range(0, len(ids), 256):
        block, at = ids[start:start + 256], 0
        while at < len(block):
            chosen = next((s for s, (n, w) in enumerate(simple8b.CODES)
                           if at + n <= len(block) and all(i < 2 ** w for i in block[at:at + n])), simple8b.ESCAPE)
            expected.append(chosen)
            at += simple8b.COUNTS[chosen]
    n_blocks = -(-len(ids) // 256)
    found = np.frombuffer(payload, "<u8", len(expected), 32 + 16 * n_blocks) >> np.uint64(60)
    assert found.tolist() == expected
    assert len(simple8b.encode(np.zeros(120_000, np.uint64), 1200)) < 120_000 / 8


def test_pieces_give_the_ids_of_whole_texts(description, library, monkeypatch):
    encoder = token_files.Encoder(description)
    assert encoder.in_pieces
    rng = random.Random(5)
    alphabet = ["Ж", "×", "À", "÷", "…", "¿", ",", "ab", "\n", "\n\n", "2", "_", "-", "\u2028", "a", "B", " ", "  ", "\n", "\t", "é", "漢", "1", ".", "'s", "\u00a0", "\u200b", "🙂", "\x85", "\r\n", "'"]
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    monkeypatch.setattr(token_files, "CACHED_PIECES", 3000)
    for group in itertools.batched(texts, 700):
        ids, lengths = encoder(pa.array(group))
        found = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert found == [e.ids for e in library.encode_batch(list(group), add_special_tokens=False)]


def brute(rows, library):
    """(doc_id, start, n_tokens, crc) of the rows in order of id."""
    out, start = [], 0
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force_on_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op13_token_files"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got.collect())) == brute(rows, library)


def test_awkward_rows_round_trip(spark, description, library, monkeypatch):
    rows = [r for r in AWKWARD if r[0] is not None] + [(100 + i, t) for i, t in enumerate(TRICKY)] \
        + [(500, "same")] * 40 + [(-3, words(900, 1)), (2 ** 62, "far")]
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(frame(spark, rows, clash=True).repartition(5), path, description)
    got = token_files.read_tokens(spark, path).collect()
    found = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got)
    # Rows of one id may follow each other in either order; here they are equal.
    assert found == brute(rows, library)
    index = token_files.token_index(spark, path).collect()
    assert sorted(map(tuple, index)) == found


def test_null_ids_come_first_and_empty_tables_give_nothing(spark, description, library):
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(frame(spark, [(4, "b"), (None, "no id"), (1, None)]), path, description, end_id=None)
    got = token_files.read_tokens(spark, path).collect()
    assert sorted(((r.start, r.doc_id, r.n_tokens) for r in got), key=lambda r: (r[0], r[2])) == [
        (0, None, 2), (2, 1, 0), (2, 4, 1)]
    empty = shared_folder(spark, "tokens")
    token_files.write_tokens(frame(spark, []), empty, description)
    assert token_files.token_index(spark, empty).count() == 0


def test_a_hot_id_is_split_over_files(spark, description):
    rows = [(7, "the same row") for _ in range(4000)] + [(i, f"row {i}") for i in range(4000)]
    path = shared_folder(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table's ranges are merged
    try:
        token_files.write_tokens(frame(spark, rows).repartition(4), path, description)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    segments = spark.read.parquet(path)
    sizes = [r[0] for r in segments.groupBy("part").agg({"n_ids": "sum"}).select("sum(n_ids)").collect()]
    assert len(sizes) > 2 and max(sizes) < 0.5 * sum(sizes)
    got = token_files.token_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(got))


def test_many_segments(spark, description, library, monkeypatch):
    texts = [words(300, i) for i in range(12)]
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    monkeypatch.setattr(token_files, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("X", (), {"partitionId": lambda s: 3})())}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts)], names=["id", "text"])
    out = list(token_files._segments(description, 0)(iter([batch])))
    assert len(out) > 8 and [b.column(1)[0].as_py() for b in out] == list(range(len(out)))
    docs = [r for b in token_files._documents(True)(iter([b.select([0, 2, 4, 5, 6]) for b in out])) for r in b.to_pylist()]
    assert [r["content"] for r in docs] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [r["start"] for r in docs] == [0, *np.cumsum([r["n_tokens"] for r in docs])[:-1].tolist()]
