"""Exact top-k search by a bit-sliced index.

Inside a block, every component is quantised to a few bits and stored as bit slices: bitmaps over the block's rows, one
for each component and bit. A query's inner product with all rows at once is a weighted sum of slices: for a negative
component the slices are complemented, the query's quantised magnitudes say at which weights a slice is added, and
carry-save adders over bitmaps reduce all slices of a weight to one. The sum's slices are read from the most significant
one downward to find the k-th highest quantised sum. Quantisation of rows and query moves a score by a bounded amount
(Cauchy-Schwarz on what was cut off), so every row whose quantised sum lies within twice the bound of the k-th one may
belong to the top; these boundary rows get their exact integer score, and nothing else can.

Defined results: see `vectors.usable` for null, empty, non-finite and repeated vectors; ties go to the smaller id; a
query with fewer than k candidates gets them all; vectors are only compared with vectors of the same length; scores are
64-bit integers: where products of a block could leave their range, whole numbers of any size are added up row by row,
and a sum beyond the range counts as its nearest end; a vector that leaves the range of doubles when it is scaled takes
no part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.llm.vectors import best_of, nearest, usable

#: Bits kept of a row's components and of a query's magnitudes.
ROW_BITS, QUERY_BITS = 6, 5
#: Queries whose bitmaps are handled together.
GROUP = 32


def _slices(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps [.., words] of booleans [.., rows]."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*packed.shape[:-1], words * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(np.uint64)


class SlicedBlock:
    """The slices of a block's integer vectors, and how far quantisation moves them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.rows = vectors, len(vectors)
        self.words = -(-self.rows // 64)
        low = int(vectors.min())
        self.shift = max(0, (int(vectors.max()) - low).bit_length() - ROW_BITS)
        kept = (vectors - low) >> self.shift
        cut = (vectors - low) - (kept << self.shift) - ((1 << self.shift) - 1) / 2
        centred = (kept << self.shift) - float((kept << self.shift).mean())
        self.cut_norm = float(np.sqrt((cut**2).sum(1).max()))
        self.kept_norm = float(np.sqrt((centred**2).sum(1).max()))
        self.slices = np.stack([_slices((kept >> b & 1).astype(bool).T, self.words) for b in range(ROW_BITS)], axis=1)
        self.all = _slices(np.ones((1, self.rows), bool), self.words)[0]

    def sums(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices [query, words] of each row's quantised score, from the lowest; and the bound on the error of each."""
        size = np.abs(queries)
        shift = max(0, int(size.max()).bit_length() - QUERY_BITS)
        kept = (size + (1 << shift >> 1)) >> shift
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        flip = np.where(queries < 0, full, np.uint64(0))
        waiting: dict[int, list[np.ndarray]] = {}

        def add(weight: int, bitmap: np.ndarray) -> None:
            held = waiting.setdefault(weight, [])
            held.append(bitmap)
            if len(held) == 3:  # a full adder: three bitmaps to their sum and their carry
                a, b, c = held
                half = a ^ b
                held[:] = [half ^ c]
                add(weight + 1, (a & b) | (half & c))

        for j in range(queries.shape[1]):
            used = [(t, np.where(kept[:, j] >> t & 1, full, np.uint64(0))[:, None]) for t in range(int(kept[:, j].max()).bit_length())]
            for b in range(ROW_BITS):
                signed = self.slices[j, b][None, :] ^ flip[:, j, None]
                for t, on in used:
                    add(t + b, signed & on)
        out, weight = [], 0
        while waiting and weight <= max(waiting):
            held = waiting.pop(weight, [])
            if len(held) == 2:
                carry = held[0] & held[1]
                held = [held[0] ^ held[1]]
                add(weight + 1, carry)
            out.append(held[0] if held else np.zeros((len(queries), self.words), np.uint64))
            weight += 1
        rounding = np.sqrt(((size - (kept << shift)).astype(float) ** 2).sum(1))
        error = rounding * self.kept_norm + np.sqrt((queries.astype(float) ** 2).sum(1)) * self.cut_norm
        return out, error / 2.0 ** (shift + self.shift)

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Bitmaps [query, words] of all rows that may be among a query's k best; own: its row in the block, or -1."""
        slices, error = self.sums(queries)
        eligible = np.repeat(self.all[None, :], len(queries), 0)
        for q in np.flatnonzero(own >= 0):
            eligible[q, own[q] >> 6] &= ~(np.uint64(1) << np.uint64(own[q] & 63))
        above, level = np.zeros_like(eligible), eligible.copy()
        kth = np.zeros(len(queries), np.int64)
        for i in range(len(slices) - 1, -1, -1):
            ones = level & slices[i]
            enough = np.bitwise_count(above | ones).sum(1) >= k
            kth |= enough.astype(np.int64) << i
            above = np.where(enough[:, None], above, above | ones)
            level = np.where(enough[:, None], ones, level & ~slices[i])
        few = np.bitwise_count(eligible).sum(1) < k
        least = np.where(few, 0, np.maximum(0, kth - np.floor(2 * error).astype(np.int64) - 2))
        above, level = np.zeros_like(eligible), eligible.copy()
        for i in range(len(slices) - 1, -1, -1):
            one = (least >> i & 1 == 1)[:, None]
            above = np.where(one, above, above | (level & slices[i]))
            level = np.where(one, level & slices[i], level & ~slices[i])
        return above | level


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of any size, moved into the range of 64 bits."""
    asked = [int(x) for x in query]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, asked, strict=True)), low), high) for row in vectors.tolist()], np.int64)


def indexed(k: int):
    def index(ids: np.ndarray, vectors: np.ndarray):
        largest = float(np.abs(vectors).max())
        block = SlicedBlock(vectors.astype(np.int64)) if largest < 1 << 31 else None
        order = np.argsort(ids)

        def search(query_ids: np.ndarray, queries: np.ndarray):
            near = order[np.minimum(np.searchsorted(ids[order], query_ids), len(ids) - 1)]
            own = np.where(ids[near] == query_ids, near, -1)
            at, found, scores = [], [], []
            for begin in range(0, len(queries), GROUP):
                part = queries[begin : begin + GROUP]
                fits = block is not None and largest * float(np.abs(part).max()) * vectors.shape[1] < 1 << 62
                bitmaps = block.candidates(part.astype(np.int64), own[begin : begin + GROUP], k) if fits else None
                for q, query in enumerate(part):
                    if fits:
                        rows = np.flatnonzero(np.unpackbits(bitmaps[q].view(np.uint8), bitorder="little", count=len(ids)))
                        exact = block.vectors[rows] @ query.astype(np.int64)
                    else:
                        rows = np.flatnonzero(np.arange(len(ids)) != own[begin + q])
                        exact = exact_scores(vectors[rows], query)
                    best = best_of(ids[rows], exact, k)
                    at.append(np.full(len(best), begin + q))
                    found.append(rows[best])
                    scores.append(exact[best])
            return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

        return search

    return index


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k highest inner products of floor(scale * component) with all other rows."""
    rows = usable(embeddings)
    # in doubles, as a component may be larger than any 64-bit integer; from 2 ** 53 on each double is whole
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.select("vec_id", F.transform("vector", whole).alias("vector"))
    rows = rows.where(F.forall("vector", lambda x: F.abs(x) != float("inf")))
    return nearest(rows, is_query, k, indexed(k), "long")
