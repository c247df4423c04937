"""Approximate nearest neighbours by inner product: a forest of hash-prefix trees.

Each block of rows has its own forest, built once. A tree is a sorted array of long hash strings, whose bits are the
sides of random hyperplanes; all rows with a common prefix are one stretch of it. A query descends in every tree to its
longest matching prefix, whose length differs from tree to tree; then all trees ascend together, one bit at a time, and
unite their stretches, until there are enough candidates. On the last level trees are united a few at a time, so that
the ascent does not overshoot. (How far all trees ascend whole is found by bisection, as stretches only grow upwards.)
Inner product becomes an angle by one more component, which fills each row up to the block's largest norm. Candidates
are scored in single precision, and those near the best are scored again in double precision.

How many candidates a query takes is measured, not assumed: each block searches for the neighbours of a bounded sample of
its own rows, compares what it finds with all rows of the block, and widens the ascent until `RECALL` of the neighbours
are found. It starts at a number that grows with the block's rows to the power of `GROWTH`. So vectors with clusters, whose
neighbours are much nearer than the rest, take few candidates, and vectors of high dimension or very unlike norms many,
up to all rows where nothing less is enough. Every row is in every tree.

Defined results: see `vectors.usable` for null, empty, non-finite and repeated vectors; zero vectors take no part; ties
go to the smaller id; a query with fewer candidates than k gets what was found (all, if no more rows exist); vectors are
only compared with vectors of the same length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.llm.vectors import best_of, nearest, usable

TREES, BITS = 256, 20
#: Candidates of a query in a block of n rows at first: FACTOR * n ** GROWTH; how much more each time, until the sample's recall is enough.
FACTOR, GROWTH, WIDER = 1.0, 0.7, 1.25
RECALL, SAMPLE = 0.94, 96
#: Trees that are united at a time on the last level, and trees whose strings are made at a time.
STEP, MADE = 16, 32
#: Queries whose candidates are looked for together.
GROUP = 256


class Forest:
    """The sorted hash strings of a block."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        self.scale = float(np.abs(vectors).max())
        scaled = vectors / self.scale
        norms = np.sqrt((scaled**2).sum(1))
        self.largest = float(norms.max())
        rest = np.sqrt(np.maximum(self.largest**2 - norms**2, 0))
        self.planes = np.random.default_rng(seed).standard_normal((TREES, vectors.shape[1] + 1, BITS)).astype(np.float32)
        self.vectors = scaled.astype(np.float32)
        codes = self.strings(np.column_stack([scaled, rest]).astype(np.float32))
        self.orders = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.codes = np.take_along_axis(codes, self.orders, 1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings [tree, row] as integers, the first bit highest."""
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int32)
        parts = [((vectors @ self.planes[t : t + MADE]) > 0) @ weights for t in range(0, TREES, MADE)]
        return np.concatenate(parts).astype(np.int32)

    def longest(self, codes: np.ndarray) -> np.ndarray:
        """Length [tree, query] of the longest prefix that some row shares: that of a neighbour in the sorted array."""
        out = np.zeros(codes.shape, np.int64)
        for t in range(TREES):
            at = np.searchsorted(self.codes[t], codes[t])
            apart = [np.frexp((codes[t] ^ self.codes[t][np.clip(at + d, 0, len(self.vectors) - 1)]).astype(float))[1] for d in (-1, 0)]
            out[t] = BITS - np.minimum(*apart)
        return out

    def stretches(self, codes: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places [tree, query] of the rows that share each query's first `depths` bits."""
        shift = (BITS - depths).astype(np.int32)
        low = codes >> shift << shift
        high = low + (np.int32(1) << shift)
        first = np.stack([np.searchsorted(self.codes[t], low[t]) for t in range(TREES)])
        return first, np.stack([np.searchsorted(self.codes[t], high[t]) for t in range(TREES)])

    def start(self, codes: np.ndarray, wanted: float) -> np.ndarray:
        """Per query the greatest depth at which the stretches of all trees, one upon another, hold the wanted rows."""
        enough, few = np.zeros(codes.shape[1], np.int64), self.longest(codes).max(0) + 1
        while (few - enough > 1).any():  # the root has enough, or all there is
            middle = (enough + few) // 2
            first, last = self.stretches(codes, middle)
            much = (last - first).sum(0) >= wanted
            enough, few = np.where(much, middle, enough), np.where(much, few, middle)
        return enough

    def candidates(self, queries: np.ndarray, wanted: float) -> np.ndarray:
        """Bitmaps [query, row]."""
        codes = self.strings(np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32))
        depths = self.start(codes, wanted)
        seen = np.zeros((len(queries), len(self.vectors)), bool)
        level = np.minimum(depths + 1, BITS)
        first, last = self.stretches(codes, level)
        for q, row in enumerate(seen):
            row[np.concatenate([self.orders[t, a:b] for t, (a, b) in enumerate(zip(first[:, q].tolist(), last[:, q].tolist(), strict=True))])] = True
        open_ = np.arange(len(queries))
        while len(open_):
            first, last = self.stretches(codes[:, open_], depths[open_])
            for i, q in enumerate(open_):
                row, a, b = seen[q], first[:, i].tolist(), last[:, i].tolist()
                for t in range(0, TREES, STEP):
                    if np.count_nonzero(row) >= wanted:
                        break
                    row[np.concatenate([self.orders[u, a[u] : b[u]] for u in range(t, t + STEP)])] = True
            open_ = open_[(np.count_nonzero(seen[open_], axis=1) < wanted) & (depths[open_] > 0)]
            depths = np.maximum(depths - 1, 0)
        return seen


def enough(forest: Forest, k: int, seed: int = 11) -> float:
    """Candidates of a query with which a sample of the block's rows finds `RECALL` of its k nearest others."""
    n = len(forest.vectors)
    chosen = np.random.default_rng(seed).choice(n, min(SAMPLE, n), replace=False)
    scores = forest.vectors @ forest.vectors[chosen].T
    scores[chosen, np.arange(len(chosen))] = -np.inf
    k, wanted = min(k, n - 1), max(FACTOR * n**GROWTH, k + 1)
    nearest_rows = np.argpartition(-scores, k - 1, axis=0)[:k] if k else np.zeros((0, len(chosen)), np.int64)
    while wanted < n:
        seen = np.concatenate([forest.candidates(forest.vectors[chosen[g : g + GROUP]], wanted) for g in range(0, len(chosen), GROUP)])
        if np.take_along_axis(seen.T, nearest_rows, 0).mean() >= RECALL:
            break
        wanted *= WIDER
    return min(wanted, n)


def indexed(k: int):
    def index(ids: np.ndarray, vectors: np.ndarray):
        forest = Forest(vectors)
        wanted = enough(forest, k)

        def search(query_ids: np.ndarray, queries: np.ndarray):
            at, found, scores = [], [], []
            scaled = queries / np.abs(queries).max(1, keepdims=True)
            slack = 1e-5 * forest.largest * np.sqrt((scaled**2).sum(1))
            groups = (forest.candidates(scaled[g : g + GROUP], wanted) for g in range(0, len(queries), GROUP))
            for q, seen in enumerate(row for group in groups for row in group):
                rows = np.flatnonzero(seen & (ids != query_ids[q]))
                rough = forest.vectors[rows] @ scaled[q].astype(np.float32)
                if len(rows) > k:
                    rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack[q]]
                exact = (vectors[rows] * queries[q]).sum(1)
                best = best_of(ids[rows], exact, k)
                at.append(np.full(len(best), q))
                found.append(rows[best])
                scores.append(exact[best])
            return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

        return search

    return index


def neighbours(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """Each query's k nearest found rows by inner product."""
    rows = usable(embeddings).where(F.exists("vector", lambda x: x != 0))
    return nearest(rows, is_query, k, indexed(k), "double")
