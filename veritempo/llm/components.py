"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v): a node's neighbours (the larger ones, or the smaller ones and itself) point to its minimum."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # in a small star u is the larger end of each edge
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    moved = moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # a large star gives one row per edge at most, and the small star after it bears repeats: one distinct does for both
    return moved if large else moved.distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node and component (its least node) of every node of edges(a, b) but the least ones themselves.

    A component's least node is the only one without a row. Edges are undirected; repeats and loops do no harm. Each
    step's edges are written to the scratch folder, so that few edges lie in few files and few tasks read them.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, last = scratch.keep(edges), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = state
        before, edges = edges, scratch.keep(_star(_star(edges, True), False))
        scratch.drop(before)
