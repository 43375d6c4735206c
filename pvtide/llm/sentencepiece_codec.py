"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message. It is read with a small wire-format
reader, and from its parts an equivalent tokenizer is rebuilt: the
normaliser (the precompiled character map if there is one, the dummy prefix,
the white-space rules), the metaspace marker, the pieces with their scores
(a unigram lattice, or the merges that the scores of a BPE model rank) and
byte fallback. Texts are then encoded and decoded in batches inside tasks,
with the library's threads. ``parity_report`` compares the rebuilt tokenizer
with the sentencepiece library id by id.

Tokenizers are never trained here. The path of the model is a parameter; its
bytes (checked to be below MAX_MODEL_BYTES) travel with the task's closure,
so that executors need no file of the driver's.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.llm.textkernels import freed

DEFAULT_MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MAX_MODEL_BYTES = 64 << 20
# Texts are handed to the library in groups of about this many characters.
GROUP_CHARS = 1 << 19
# Their ids are decoded in smaller groups: the decoder holds a string for every token.
DECODE_CHARS = 1 << 17
# Threads of the library in a task, unless RAYON_NUM_THREADS says otherwise.
THREADS = "2"

# Field and enum numbers of the public SentencePiece model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
METASPACE = "▁"


# --- the model file ---------------------------------------------------------

def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """``(field number, wire type, value)`` of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < end:
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, wire, varint()
        elif wire == 1:
            at += 8
            yield number, wire, data[at - 8:at]
        elif wire == 2:
            n = varint()
            at += n
            yield number, wire, data[at - n:at]
        elif wire == 5:
            at += 4
            yield number, wire, struct.unpack("<f", data[at - 4:at])[0]
        else:
            raise ValueError(f"wire type {wire} at byte {at}: not a SentencePiece model")


@dataclass
class PieceModel:
    """What a SentencePiece model file says, as far as encoding goes."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    split_by_whitespace: bool = True
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False

    @property
    def unk_id(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 22:
                    model.split_by_whitespace = bool(v)
                elif n == 24:
                    model.whitespace_as_suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.whitespace_as_suffix:
        raise ValueError("models with white space as suffix are not supported")
    return model


# --- the rebuilt tokenizer ----------------------------------------------------

def ranked_merges(model: PieceModel) -> list[tuple[str, str]]:
    """The merges of a BPE model: every way to join two pieces to a third, best score
    of the result first (a BPE model joins the pair whose result scores best)."""
    known = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    order = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    merges = []
    for piece, score, kind in model.pieces:
        if kind != NORMAL:
            continue
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in known and right in known:
                merges.append((-score, order[piece], order[left], order[right], left, right))
    merges.sort(key=lambda m: m[:4])
    return [(left, right) for *_, left, right in merges]


def words_are_independent(model: PieceModel) -> bool:
    """Whether no piece goes on behind a marker that follows another character:
    then splitting before each run of markers changes no result."""
    return all(METASPACE not in p.lstrip(METASPACE) for p, _, kind in model.pieces if kind == NORMAL)


def build_tokenizer(model: PieceModel):
    """A ``tokenizers.Tokenizer`` that encodes like the model."""
    # A few threads per task: every core of an executor has a task of its own.
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, ranked_merges(model), unk_token=model.pieces[model.unk_id][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(METASPACE))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", METASPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.split_by_whitespace and words_are_independent(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(
            Regex(f"{METASPACE}+[^{METASPACE}]*|[^{METASPACE}]+"), "isolated")
    special = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if special:
        tokenizer.add_tokens(special)
    tail = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    # Metaspace puts a blank for every marker of a piece, as Replace does with a regular expression.
    tokenizer.decoder = decoders.Sequence(
        [decoders.Metaspace(METASPACE, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


@functools.lru_cache(maxsize=2)
def _tokenizer(data: bytes):
    return build_tokenizer(parse_model(data))


def load_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes; refuses files that are too large to ship with tasks."""
    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} exceeds {MAX_MODEL_BYTES} bytes")
    return data


# --- inside tasks ---------------------------------------------------------------

def _groups(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _token_batch(kept: pa.Array, ids: list[list[int]], extra: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.fromiter((x for own in ids for x in own), np.int32, int(lengths.sum()))
    tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.RecordBatch.from_arrays([kept, tokens, *[a for _, a in extra]],
                                      names=["kept", "ids", *[n for n, _ in extra]])


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep=(), check: bool = True) -> DataFrame:
    """``keep`` columns + ``ids`` (array of int), ``n_tokens`` (int) and, with
    ``check``, what decoding the ids of each row gives: ``round_trip``,
    whether that is the text up to the model's normaliser (to which the space
    marker itself is a blank), and ``round_trip_exact``, whether it is the
    text itself, character by character.

    Defined cases: a null text has null ``ids``, no tokens and null
    round trips; an empty text has empty ``ids``; special tokens are
    neither added nor recognised in texts (a text that spells a control
    symbol is ordinary text); repeated rows are encoded alike; an empty
    table gives an empty result. Texts are encoded whole.
    """
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(model)
        normal = _normaliser(model)
        for batch in freed(batches):
            texts = batch.column(1).to_pylist()
            for start, end in _groups([t or "" for t in texts], GROUP_CHARS):
                own = texts[start:end]
                # An empty text gets no dummy prefix.
                full = [t for t in own if t]
                encoded = iter([e.ids for e in tokenizer.encode_batch_fast(full, add_special_tokens=False)])
                ids = [next(encoded) if t else [] for t in own]
                extra = [("n_tokens", pa.array([len(x) for x in ids], pa.int32()))]
                if check:
                    back = _decoded(tokenizer, own, ids)
                    up_to, exact = (
                        [None if t is None else b == form(t) for t, b in zip(own, back, strict=True)]
                        for form in (normal, str))
                    extra += [("round_trip", pa.array(up_to, pa.bool_())),
                              ("round_trip_exact", pa.array(exact, pa.bool_()))]
                out = _token_batch(batch.column(0).slice(start, end - start), ids, extra)
                null = pa.array([t is None for t in own], pa.bool_())
                tokens = pa.compute.if_else(null, pa.scalar(None, out.column(1).type), out.column(1))
                yield out.set_column(1, "ids", tokens)

    fields = "ids array<int>, n_tokens int" + (", round_trip boolean, round_trip_exact boolean" if check else "")
    schema = T.StructType([source.schema["kept"], *T.StructType.fromDDL(fields).fields])
    columns = ["ids", "n_tokens"] + (["round_trip", "round_trip_exact"] if check else [])
    return source.mapInArrow(run, schema).select("kept.*", *columns)


def _decoded(tokenizer, texts: list[str | None], ids: list[list[int]]) -> list[str]:
    """What the decoder makes of the ids of the texts, group by group."""
    back = []
    for start, end in _groups([t or "" for t in texts], DECODE_CHARS):
        back += tokenizer.decode_batch(ids[start:end], skip_special_tokens=False)
    return back


def _normaliser(data: bytes):
    """A function from a text to its normal form, as decoding gives it: blanks
    for markers, no dummy prefix (empty for an empty text)."""
    model = parse_model(data)
    if not (model.charsmap or model.remove_extra_whitespaces) and model.escape_whitespaces:
        return lambda text: text.replace(METASPACE, " ")
    normalizer, prefix = _tokenizer(data).normalizer, int(model.add_dummy_prefix)
    return lambda text: normalizer.normalize_str(text).replace(METASPACE, " ")[prefix:] if text else ""


def decode(tokens: DataFrame, model: bytes, ids_col: str = "ids", keep=()) -> DataFrame:
    """``keep`` columns + ``text``: the texts that the ids stand for (null for null)."""
    source = tokens.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(model)
        for batch in freed(batches):
            ids = batch.column(1).to_pylist()
            back = tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if x is None else b for x, b in zip(ids, back, strict=True)],
                                           pa.string())], names=["kept", "text"])

    schema = T.StructType([source.schema["kept"], T.StructField("text", T.StringType())])
    return source.mapInArrow(run, schema).select("kept.*", "text")


def ids_crc32(ids: list[int]) -> int:
    """CRC-32 of ids as little-endian 32-bit numbers."""
    return zlib.crc32(np.asarray(ids, "<i4").tobytes())


def parity_report(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                  one_in: int = 1) -> DataFrame:
    """``doc_id, equal``: whether the rebuilt tokenizer and the sentencepiece
    library give a document the same ids. ``one_in`` checks the documents
    whose text's hash is divisible by it (1: all)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        tokenizer = _tokenizer(model)
        other = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in freed(batches):
            texts = batch.column(1).to_pylist()
            mine = [e.ids if t else [] for t, e in zip(
                texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            theirs = other.encode(texts, num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a == b for a, b in zip(mine, theirs, strict=True)], pa.bool_())],
                names=["doc_id", "equal"])

    return rows.mapInArrow(run, "doc_id long, equal boolean")
