"""PCA whitening of embeddings from an exact, bit-sliced scatter matrix.

Entries become integers, ``x = floor(1024 * c) + 100000``. A task takes its
rows in blocks. Within a block each dimension is shifted by its least value,
and bit b of the shifted values of all rows is packed into 64-bit words, a bit
plane. The cross-product of two dimensions is then a sum over pairs of planes:
the popcount of their AND, times 2 to the power of the two bits' places. The
shift is taken back with the sums, so blocks need not agree on it, and one
pass over the data gives count, sums and cross-products, all of them exact:
Python integers in the tasks, limbs of 31 bits in Spark's sums.

The driver gets one row per pair of dimensions (their number is a property of
the model, not of the data), centres as integers, ``n * sum(x y) - sum(x) *
sum(y)``, and only then goes to doubles, for ``eigh``. A second pass measures
the covariance of the whitened rows, a third returns them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvtide.llm.textkernels import freed

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Rows whose planes are packed together: 64 per word.
BLOCK_ROWS = 1 << 13
# A component of less than this share of the variance has none beyond rounding.
LEAST_SHARE = 1e-12
# Sums travel as limbs of 31 bits, of which the last has the sign.
LIMB_BITS, LIMBS = 31, 6


# --- inside tasks ---------------------------------------------------------

def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows that are used, their x)`` of list values. A row is used if the
    list and all entries are there and finite, and it is not empty."""
    if len(vectors) == 0:
        return np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
    lists = vectors.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    entries = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    bad = ~np.isfinite(entries.fill_null(math.nan).to_numpy(zero_copy_only=False))
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    upto = np.concatenate([[0], np.cumsum(bad)])
    good = (sizes > 0) & (upto[offsets[1:]] == upto[offsets[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
    used = np.flatnonzero(good)
    if not len(used):
        return used, np.zeros((0, 0), np.int64)
    width = sizes[used[0]]
    if (sizes[used] != width).any():
        raise ValueError("vectors have different numbers of entries")
    flat = entries.to_numpy(zero_copy_only=False)[offsets[used][:, None] + np.arange(width)]
    scaled = np.floor(SCALE * flat)
    if (np.abs(scaled) >= 2.0 ** 62).any():
        raise ValueError("an entry is too large to become a 64-bit integer")
    return used, scaled.astype(np.int64) + SHIFT


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(planes, dimension, bit)``: a row of 64-bit words for every bit that
    a dimension's non-negative values have, bit i of word w for row 64 w + i."""
    rows, width = shifted.shape
    padded = np.zeros((width, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = shifted.T
    tops = [int(v).bit_length() for v in shifted.max(axis=0)]
    dimension = np.repeat(np.arange(width), tops)
    bit = np.concatenate([np.arange(t) for t in tops]).astype(np.int64)
    planes = [np.packbits((padded[d] >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
              for d, b in zip(dimension.tolist(), bit.tolist(), strict=True)]
    return np.array(planes, np.uint64).reshape(len(planes), padded.shape[1] // 64), dimension, bit


def plane_products(shifted: np.ndarray) -> np.ndarray:
    """Sums of y_i * y_j over rows, for i <= j (else 0), as Python integers."""
    width = shifted.shape[1]
    planes, dimension, bit = bit_planes(shifted)
    firsts = np.searchsorted(dimension, np.arange(width + 1))
    total = np.zeros((width, width), object)
    low, high = (np.where(bit < 32, 1 << (bit % 32), 0), np.where(bit < 32, 0, 1 << (bit % 32)))
    for p in range(len(planes)):
        i = dimension[p]
        own = firsts[i]
        counts = np.bitwise_count(planes[own:] & planes[p]).sum(axis=1, dtype=np.int64)
        # Popcounts weighted by the other planes' bits, summed per dimension.
        at = firsts[i:width] - own
        kept = firsts[i + 1:] > firsts[i:width]  # dimensions that have planes
        for part, shift in ((low, 0), (high, 32)):
            weighted = counts * part[own:]
            if weighted.any():
                sums = np.zeros(width - i, np.int64)
                sums[kept] = np.add.reduceat(weighted, at[kept])
                total[i, i:] += sums.astype(object) << (int(bit[p]) + shift)
    return total


class Scatter:
    """Count, sums and cross-products of x over rows, exact."""

    def __init__(self):
        self.n, self.sums, self.products = 0, None, None

    def add(self, x: np.ndarray) -> None:
        if not len(x):
            return
        if self.sums is None:
            self.sums = np.zeros(x.shape[1], object)
            self.products = np.zeros((x.shape[1], x.shape[1]), object)
        if x.shape[1] != len(self.sums):
            raise ValueError("vectors have different numbers of entries")
        for start in range(0, len(x), BLOCK_ROWS):
            block = x[start:start + BLOCK_ROWS]
            least = block.min(axis=0)
            # Differences of 64-bit numbers fit unsigned 64-bit ones.
            y = block.astype(np.uint64) - least.astype(np.uint64)
            base, n = least.astype(object), len(block)
            sums = (y >> np.uint64(32)).sum(axis=0).astype(object) * (1 << 32) + \
                (y & np.uint64(0xFFFFFFFF)).sum(axis=0).astype(object)
            self.n += n
            self.sums = self.sums + sums + n * base
            self.products = self.products + np.triu(
                plane_products(y) + np.outer(base, sums) + np.outer(sums, base) + n * np.outer(base, base))


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _whole(limbs) -> int:
    return sum(int(v) << (LIMB_BITS * k) for k, v in enumerate(limbs))


_LIMB_NAMES = [f"l{k}" for k in range(LIMBS)]


def _scatter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair of dimensions (i, j); -1 stands for the constant 1.
    A row (-2, number of dimensions) shows whether all tasks have the same."""
    found = Scatter()
    for batch in freed(batches):
        found.add(quantised(batch.column(0))[1])
    if not found.n:
        return
    width = len(found.sums)
    # Row by row of the matrix, so that what is sent at once grows with its width only.
    for i in range(-2, width):
        values = [found.n] if i == -2 else [found.n, *found.sums] if i == -1 else list(found.products[i, i:])
        first = width if i == -2 else i
        limbs = list(zip(*map(_limbs, map(int, values)), strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(values), i, np.int32)), pa.array(np.arange(first, first + len(values), dtype=np.int32)),
             *(pa.array(x, pa.int64()) for x in limbs)], names=["i", "j", *_LIMB_NAMES])


# --- the model --------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """``n`` rows, exact sums per dimension, components (columns of unit
    eigenvectors, by falling eigenvalue) and the share of variance of each."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of x; 0 along components without variance."""
        means = np.array([float(Fraction(s, self.n) - SHIFT) for s in self.sums])
        spread = self.values > 0
        scale = np.where(spread, 1 / np.sqrt(np.where(spread, self.values, 1.0)), 0.0)
        return ((x - SHIFT) - means) @ self.vectors * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exact: n^2 times the
        rows' square sums, less 2 n times their product with S, plus that of S.
        Numbers are split into limbs of 20 bits, whose products fit 64 bits."""
        base = min(int(x.min()), 0) if x.size else 0
        y, s = x - base, [v - self.n * base for v in self.sums]
        parts = _split(y.astype(object) if x.size and int(x.max()) - base >= 1 << 62 else y)
        sums = []
        rest = np.array(s, object)
        while True:
            sums.append((rest % (1 << 20)).astype(np.int64))
            rest = rest // (1 << 20)
            if not rest.any():
                break
        squares = sum((np.einsum("ij,ij->i", a, b).astype(object) << (20 * (k + m))
                       for k, a in enumerate(parts) for m, b in enumerate(parts)), np.zeros(len(x), object))
        crossed = sum(((a @ b).astype(object) << (20 * (k + m))
                       for k, a in enumerate(parts) for m, b in enumerate(sums)), np.zeros(len(x), object))
        own = sum(v * v for v in s)
        return [int(self.n * self.n * q - 2 * self.n * c + own) for q, c in zip(squares, crossed, strict=True)]


def _split(y: np.ndarray) -> list[np.ndarray]:
    """Limbs of 20 bits of non-negative numbers, least first."""
    parts = []
    while True:
        parts.append((y & ((1 << 20) - 1)).astype(np.int64))
        y = y >> 20
        if not y.any():
            return parts


def whitening_of(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int) -> Whitening:
    """The components of exact sums and cross-products (i <= j)."""
    width = len(sums)
    covariance = np.zeros((width, width))
    for (i, j), p in products.items():
        # Centred as integers; the quotient is rounded once.
        covariance[i, j] = covariance[j, i] = float(Fraction(n * p - sums[i] * sums[j], n * n))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(Fraction(sum(n * products[i, i] - sums[i] ** 2 for i in range(width)), n * n))
    values = np.where(values[order] > LEAST_SHARE * trace, values[order], 0.0)
    return Whitening(n, tuple(sums), vectors[:, order], values, values / trace if trace else values)


# --- on Spark ---------------------------------------------------------------

def _vectors(table: DataFrame, vector_col: str) -> DataFrame:
    return table.select(F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def fit(table: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of the table; None if there is none."""
    schema = "i int, j int, " + ", ".join(f"{c} long" for c in _LIMB_NAMES)
    sums = (_vectors(table, vector_col).mapInArrow(_scatter_rows, schema)
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _LIMB_NAMES]))
    found = {(r.i, r.j): _whole(r[2:]) for r in sums.collect()}
    if not found:
        return None
    widths = [j for i, j in found if i == -2]
    if len(widths) > 1:
        raise ValueError("vectors have different numbers of entries")
    n, width = found[-1, -1], widths[0]
    return whitening_of(n, [found[-1, j] for j in range(width)],
                        {k: v for k, v in found.items() if k[0] >= 0}, components)


def identity_error(table: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the
    identity, measured on all of them. Along a component without variance the
    whitened rows are 0, so the value is 1 then."""
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in freed(batches):
            used, x = quantised(batch.column(0))
            if len(used):
                one = np.hstack([np.ones((len(x), 1)), model.project(x)])
                total += one.T @ one
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())],
                                         names=["i", "j", "v"])

    rows = _vectors(table, vector_col).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((size + 1, size + 1))
    for r in rows.collect():
        total[r.i, r.j] = r.v
    means = total[0, 1:] / model.n  # 0 but for rounding: rows were centred before
    covariance = total[1:, 1:] / model.n - np.outer(means, means)
    return float(np.abs(covariance - np.eye(size)).max())


WHITENED = T.StructType([
    T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType())])


def whiten(table: DataFrame, model: Whitening | None, vector_col: str = "embedding", keep=("vec_id",)) -> DataFrame:
    """``keep`` columns, then for each usable row and component: ``component``
    (from 1), ``n``, ``deviation`` (the row's sum of (n x - S)^2, exact),
    ``whitened``, ``explained`` (the component's share of the variance).

    Defined cases: rows whose vector is null, empty or holds a null or
    non-finite entry are left out; vectors of different lengths, or entries
    beyond 64-bit integers, fail the job; there are no more components than
    dimensions; along a component without variance (equal rows, a single row,
    fewer rows than dimensions) all rows are 0; repeated rows count and are
    returned as often as they occur; ties between eigenvalues take the basis
    that ``eigh`` gives, the same for all rows; no usable row gives an empty
    result; a deviation beyond 38 digits is null.
    """
    source = table.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0 if model is None else len(model.values)
        for batch in freed(batches):
            used, x = quantised(batch.column(1))
            if not len(used) or not size:
                continue
            for start in range(0, len(used), BLOCK_ROWS):
                own, at = x[start:start + BLOCK_ROWS], used[start:start + BLOCK_ROWS]
                exact = [v if v < 10 ** 38 else None for v in model.deviations(own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(at, size))),
                     pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(at) * size, model.n)),
                     pc.take(pa.array(exact, pa.decimal128(38, 0)), pa.array(np.repeat(np.arange(len(at)), size))),
                     pa.array(model.project(own).ravel()), pa.array(np.tile(model.explained, len(at)))],
                    names=["kept", *WHITENED.names])

    schema = T.StructType([source.schema["kept"], *WHITENED.fields])
    return source.mapInArrow(run, schema).select("kept.*", *WHITENED.names)
