"""Recall of the prefix forest on vectors of several kinds, in one block and in several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritempo.llm import prefix_forest, vectors


def made(kind, n=2500):
    rng = np.random.default_rng(5)
    if kind == "clusters":
        middles = rng.normal(size=(60, 32)) * 3
        return middles[rng.integers(0, 60, n)] + rng.normal(size=(n, 32))
    if kind == "unit":
        v = rng.normal(size=(n, 32))
        return v / np.linalg.norm(v, axis=1)[:, None]
    if kind == "many dimensions":
        return rng.normal(size=(n, 384))
    return rng.normal(size=(n, 48)) * rng.lognormal(0, 1, (n, 1))


def nearest_rows(v, q, k):
    scores = v @ v[q]
    scores[q] = -np.inf
    return set(np.argsort(-scores, kind="stable")[:k].tolist())


@pytest.mark.parametrize("kind", ["clusters", "unit", "many dimensions", "mixed norms"])
def test_recall_is_measured_and_reached(kind):
    v, k = made(kind), 20
    search = prefix_forest.indexed(k)(np.arange(len(v)), v)
    asked = np.arange(0, len(v), 40)
    at, found, _ = search(asked, v[asked])
    recall = np.mean([len(set(found[at == i].tolist()) & nearest_rows(v, q, k)) / k for i, q in enumerate(asked)])
    assert recall >= 0.9
    if kind == "clusters":  # near neighbours take few candidates
        assert prefix_forest.enough(prefix_forest.Forest(v), k) < len(v) / 3


def test_recall_over_several_blocks(spark):
    v = made("mixed norms", 1200)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<double>")
    found = vectors.nearest(df, F.col("vec_id") % 40 == 0, 10, prefix_forest.indexed(10), "double", block_rows=300).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(by) == 30 and np.mean([len(by[q] & nearest_rows(v, q, 10)) / 10 for q in by]) >= 0.9


def test_a_block_of_one_row_and_of_equal_rows():
    one = prefix_forest.indexed(5)(np.array([3]), np.ones((1, 4)))
    assert [len(x) for x in one(np.array([9]), np.ones((1, 4)))] == [1, 1, 1]
    same = prefix_forest.indexed(5)(np.arange(50), np.ones((50, 4)))
    at, found, scores = same(np.array([0]), np.ones((1, 4)))
    assert found.tolist() == [1, 2, 3, 4, 5] and set(scores.tolist()) == {4.0}
