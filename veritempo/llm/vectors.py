"""Queries against all vectors, in blocks: what both vector searches share.

All vectors are dealt to blocks of about the same size; a query goes to every block. A block's task takes the block's
rows first, makes its index once, and then searches the queries as they stream by in Arrow batches, so it holds one
block and one batch, however many queries there are. A query's best rows of each block are then ranked together, after
a partial limit. Nothing is broadcast: rows travel once, queries once for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.llm.common import groups_for, spread

#: Rows of a block, about.
BLOCK_ROWS = 16_384


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that can be compared.

    Null vectors, empty ones and those with a null or non-finite component go; so do rows without an id. Rows that
    share an id count once, with the vector that sorts first.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1)


def nearest(rows: DataFrame, is_query: Column, k: int, index: Callable, score_type: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of each query by (score descending, vec_id).

    rows: vec_id and vector. index(ids, vectors) gives a function search(query_ids, queries), which gives arrays (query
    position, row position, score) with each query's k best rows of the block, its own row excluded. Vectors of another
    length are not compared.
    """
    blocks = groups_for(rows.count(), block_rows)
    size = F.size("vector").alias("size")
    stored = rows.select(size, spread("vec_id", blocks).alias("block"), F.lit(0).alias("asks"), "vec_id", "vector")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = rows.where(is_query).select(size, every, F.lit(1).alias("asks"), "vec_id", "vector")
    # the sort puts a block's rows before its queries; grouping by the same columns keeps partitions and order
    cells = stored.unionByName(asked).repartition("size", "block").sortWithinPartitions("size", "block", "asks")
    kind = pa.int64() if score_type == "long" else pa.float64()

    def search_block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, search = [], None
        for batch in batches:
            n = int(np.searchsorted(batch.column("asks").to_numpy(), 1))
            if n:
                held.append(batch.slice(0, n))
            part = batch.slice(n)
            if part.num_rows and held:
                if search is None:
                    ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
                    search = index(ids, np.concatenate([_matrix(b) for b in held]))
                query_ids = part.column("vec_id").to_numpy()
                at, found, scores = search(query_ids, _matrix(part))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[at]), pa.array(ids[found]), pa.array(scores, kind)], names=["query_id", "vec_id", "score"])

    found = cells.groupBy("size", "block").applyInArrow(search_block, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
