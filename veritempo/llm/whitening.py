"""Whitening of embeddings from an exact integer scatter.

Entries become integers x = floor(scale * c) + offset. Every task subtracts a shift (its first vector), so that numbers
are small, and adds up counts, sums and cross-products exactly: products of 21-bit parts as matrices of doubles that stay
below 2^53, put together as integers of any length. Tasks hand over their sums about zero, cut into 31-bit parts, which
Spark adds up by place; the driver gets d(d+1)/2 sums for vectors of d entries, however many vectors there are, and forms
n C - S S' from them, still in integers. Only that is turned into doubles and decomposed by `eigh`.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry go; repeated rows count as often as
they occur; vectors of another length are a fit list of their own (n tells its size); ids may be null and repeat; entries
beyond 2^61 after scaling count as 2^61; a component without variance (constant entries, a single vector) has a null
`whitened`, and where nothing varies `explained` is null too; `identity_error` is over the components with a variance; a
deviation of more than 38 digits is null; no row gives no result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS, SCALE, OFFSET = 8, 1024, 100_000
#: Rows of one product of matrices, and bits of their parts: 2^(2 * 21) * 2^11 = 2^53.
CHUNK_ROWS, PART_BITS = 2048, 21
#: Bits of the parts that Spark adds up: sums of 2^32 tasks fit in a long.
SENT_BITS = 31
_LARGEST = 2.0**61


def complete(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(values: np.ndarray, scale: int, offset: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * values), -_LARGEST, _LARGEST).astype(np.int64) + offset


def cross_products(y: np.ndarray) -> np.ndarray:
    """Y'Y of integers below 2^63, exactly, as Python integers."""
    parts, rest = [], y
    while True:
        last = not len(rest) or np.abs(rest).max() < 1 << PART_BITS
        parts.append((rest if last else rest & ((1 << PART_BITS) - 1)).astype(np.float64))
        if last:
            break
        rest = rest >> PART_BITS
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for begin in range(0, len(y), CHUNK_ROWS):
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                product = (a[begin : begin + CHUNK_ROWS].T @ b[begin : begin + CHUNK_ROWS]).astype(np.int64).astype(object)
                total += product << (PART_BITS * (i + j)) if i + j else product
    return total


class Scatter:
    """Count, sums and cross-products of integer vectors of one length, about the first of them."""

    def __init__(self, shift: np.ndarray):
        self.shift, self.n = shift, 0
        self.sums, self.products = np.zeros(len(shift), object), np.zeros((len(shift), len(shift)), object)

    def add(self, x: np.ndarray) -> None:
        y = x - self.shift
        self.n += len(y)
        for begin in range(0, len(y), CHUNK_ROWS):  # halves, as a sum of 2^11 numbers of 63 bits doesn't fit
            part = y[begin : begin + CHUNK_ROWS]
            self.sums = self.sums + (part >> 32).sum(0).astype(object) * (1 << 32) + (part & 0xFFFFFFFF).sum(0).astype(object)
        self.products = self.products + cross_products(y)

    def about_zero(self) -> tuple[np.ndarray, np.ndarray]:
        a = self.shift.astype(object)
        mixed = np.multiply.outer(a, self.sums)
        return self.sums + self.n * a, self.products + mixed + mixed.T + self.n * np.multiply.outer(a, a)


def _places(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield place, sign * (value & ((1 << SENT_BITS) - 1))
        value, place = value >> SENT_BITS, place + 1


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length."""
    lengths, flat = pc.list_value_length(vectors).to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat.reshape(-1, d) if len(at) == len(lengths) else flat[starts[at][:, None] + np.arange(d)]


def scatter(rows: DataFrame, scale: int, offset: int) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Per length: n, the sums S and the cross-products C of all rows' vectors, exact. rows: vector."""

    def partials(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scatter] = {}
        for batch in source:
            for _, values in _by_length(batch.column(0)):
                x = integers(values, scale, offset)
                held.setdefault(x.shape[1], Scatter(x[0])).add(x)
        for d, part in held.items():
            sums, products = part.about_zero()
            cells = [(-1, -1, part.n), *((-1, j, sums[j]) for j in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
            sent = [(d, i, j, place, v) for i, j, value in cells for place, v in _places(value)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*sent, strict=True), [pa.int32()] * 4 + [pa.int64()], strict=True)], names=["d", "i", "j", "place", "v"])

    sent = rows.select("vector").mapInArrow(partials, "d int, i int, j int, place int, v long")
    found: dict[int, tuple[dict, dict]] = {}
    for d, i, j, place, v in sent.groupBy("d", "i", "j", "place").agg(F.sum("v").alias("v")).collect():
        cells = found.setdefault(d, {})
        cells[i, j] = cells.get((i, j), 0) + (v << (SENT_BITS * place))
    out = {}
    for d, cells in found.items():
        sums, products = np.zeros(d, object), np.zeros((d, d), object)
        for j in range(d):
            sums[j] = cells.get((-1, j), 0)
            for i in range(j + 1):
                products[i, j] = products[j, i] = cells.get((i, j), 0)
        out[d] = cells[-1, -1], sums, products
    return out


def decompose(n: int, sums: np.ndarray, products: np.ndarray, components: int) -> dict:
    """The whitening of one fit list: basis (columns u / sqrt(e)), explained, varies and identity_error."""
    exact = n * products - np.multiply.outer(sums, sums)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    k = min(components, len(sums))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = int(np.trace(exact)) / (n * n)
    varies = values > len(sums) * np.finfo(np.float64).eps * max(values[0], 0)
    basis = vectors / np.sqrt(np.where(varies, values, 1))
    wide = np.longdouble(basis[:, varies])
    off = np.abs(wide.T @ np.longdouble(covariance) @ wide - np.eye(int(varies.sum())))
    return {"n": n, "sums": sums, "basis": basis, "varies": varies, "explained": np.maximum(values, 0) / trace if trace > 0 else None, "identity_error": float(off.max()) if varies.any() else None}


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """n x - S of each entry, as doubles, and each row's sum of their squares, as decimals."""
    if max(float(np.abs(x).max()) * n, float(max(abs(s) for s in sums))) < 2.0**61:
        centred = x * n - sums.astype(np.int64)
        if float(np.abs(centred).max()) ** 2 * x.shape[1] < 2.0**62:
            return centred.astype(np.float64), pa.array((centred * centred).sum(1)).cast(pa.decimal128(38, 0))
        centred = centred.astype(object)
    else:
        centred = x.astype(object) * n - sums
    squares = (int(v) for v in (centred * centred).sum(1))
    return centred.astype(np.float64), pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error of every row and component."""
    vector = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).alias("vec_id"), vector.alias("vector")).where(complete(F.col("vector")))
    models = {d: decompose(*found, components) for d, found in scatter(rows, scale, offset).items()}

    def project(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at, values in _by_length(batch.column(1)):
                x = integers(values, scale, offset)
                model = models[x.shape[1]]
                k, n = model["basis"].shape[1], model["n"]
                centred, deviation = _deviations(x, n, model["sums"])
                whitened = (centred / n) @ model["basis"]
                row = np.repeat(np.arange(len(at)), k)
                nothing = ~np.tile(model["varies"], len(at))
                explained = pa.nulls(len(row), pa.float64()) if model["explained"] is None else pa.array(np.tile(model["explained"], len(at)))
                columns = [
                    batch.column(0).take(pa.array(at[row])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(row), n)),
                    deviation.take(pa.array(row)),
                    pa.array(whitened.reshape(-1), mask=nothing),
                    explained,
                    pa.array([model["identity_error"]] * len(row), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
