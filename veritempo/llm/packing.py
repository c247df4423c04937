"""Best-fit packing of documents into sequences under conflicts, in bounded shards.

A piece is a whole document, or a stretch of `capacity` words of a longer one. Pieces are dealt to shards by a hash of
document, stretch and the row's place in the input, so that no source, no cluster of copies and no repeated row makes a
shard large; every shard is packed on its own, longest pieces first. Open bins are kept ordered by residual capacity and carry two bitmaps: the sources and the
duplicate clusters that they hold. A piece goes to the tightest bin with room and without conflict: the search starts at
the smallest residual that fits and goes on to its successors until a compatible bin is found, else opens a bin.
Two pieces conflict when they share a duplicate cluster (copies, or two stretches of one document) or a source.

Defined results: a document without words (null or empty text) has one piece of length 0 and is packed too; very long
texts are cut into stretches and lose nothing; repeated rows are copies of one another and go to different bins; a null
source conflicts with no other; a null doc_id is one like any other; equal pieces (in length, cluster, doc_id and
number) go in any order, which changes no bin's contents but for them; bins of equal residual are taken by their number;
columns other than doc_id, text and source are ignored, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo.llm.common import groups_for

#: Words of a sequence.
CAPACITY = 2048
#: Pieces of a shard, about.
SHARD_PIECES = 4_000


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, length (words), source, cluster (hash of the lower-case text without its white space) and row.

    row numbers the rows of docs by their place in it, which is the same when a task is repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " ")))
    cluster = F.when(spaced == "", F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lower(F.regexp_replace(text, r"\s+", ""))))
    rows = docs.select("doc_id", "source", words.alias("words"), cluster.alias("cluster"), F.monotonically_increasing_id().alias("row"))
    stretches = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("int"))
    rows = rows.select("doc_id", "source", "cluster", "row", "words", F.explode(stretches).alias("piece"))
    return rows.select("doc_id", "piece", "source", "cluster", "row", F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("int").alias("length"))


def best_fit(lengths: list[int], conflicts: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order; conflicts are bitmaps."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []
    bins, offsets = [], []
    for length, bits in zip(lengths, conflicts, strict=True):
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and held[open_bins[at][1]] & bits:
            at += 1
        if at < len(open_bins):
            residual, number = open_bins.pop(at)
        else:
            residual, number = capacity, len(held)
            held.append(0)
        held[number] |= bits
        bins.append(number)
        offsets.append(capacity - residual)
        if residual > length:
            insort(open_bins, (residual - length, number))
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Columns doc_id, piece, length, shard, bin (within the shard) and offset (words before the piece in its bin)."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # a word takes two bytes with its space, so this is no fewer than there are pieces
    shards = groups_for(n + size // (2 * capacity), shard_pieces)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "cluster", "row"), F.lit(shards)).cast("int")
    rows = pieces(docs, capacity)

    def pack_shard(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        part = part.sort_by([("length", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sources = part["source"].combine_chunks().dictionary_encode()
        clusters = np.unique(part["cluster"].to_numpy(), return_inverse=True)[1].tolist()
        numbers = sources.indices.to_pylist() if len(sources) else []
        width = len(sources.dictionary)
        bits = [(0 if s is None else 1 << s) | 1 << (width + c) for s, c in zip(numbers, clusters, strict=True)]
        bins, offsets = best_fit(part["length"].to_pylist(), bits, capacity)
        yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks() for c in ("doc_id", "piece", "length", "shard")), pa.array(bins, pa.int32()), pa.array(offsets, pa.int32())], names=["doc_id", "piece", "length", "shard", "bin", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, length int, shard int, bin int, offset int"
    rows = rows.withColumn("shard", shard).drop("row")
    return rows.groupBy("shard").applyInArrow(pack_shard, schema)
