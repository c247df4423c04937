"""Audit of how filters interact: what each removes, in every order of them.

A document's failures are five bits. A table of 32 masks by 120 orders tells the step at which it goes; a task looks up
its documents' rows of the table and counts (part, order, step, label) with `bincount`, so it hands over arrays of 2,880
counts a part, which Spark adds up. Shuffled are a digest, an id and a byte of flags per document for the copies
(condition E), and those counts; texts are read once and never travel.

Conditions: A under 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z] characters > 3 * code points; D any of
[#$%&*|]; E the text of a smaller doc_id. Words are maximal runs of bytes other than blank and 09 to 0D.

Defined results: a null text is empty, and equal to other empty ones; a null lang is the part "" (with an empty one);
texts are identical if their SHA-256 is; rows that repeat a doc_id each count, and only a smaller doc_id makes one a copy;
a row without doc_id is no copy, makes none and has no label; a document is good or toxic if any of its label rows says
so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo.llm.common import checkpoint

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS, MASKS = len(FILTERS), 1 << len(FILTERS)
#: Labels: bit 0 good, bit 1 toxic.
LABELS = 4
_COUNTS = len(ORDERS) * (STEPS + 1) * LABELS
_UPPER, _ODD = bytes(range(65, 91)), b"#$%&*|"
#: Documents looked up at a time, and parts that a task holds before it hands over.
CHUNK_ROWS, HELD_PARTS = 4096, 256


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 1, at which a document that fails the mask's filters is removed; 0 if none removes it."""
    table = np.zeros((MASKS, len(ORDERS)), np.int64)
    for mask in range(MASKS):
        for o, order in enumerate(ORDERS):
            table[mask, o] = next((s + 1 for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1), 0)
    return table


def text_failures(text: str | None) -> tuple[int, bytes]:
    """The failures A to D of a text as bits, and its digest."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at blank and 09 to 0D
    mask = (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, _UPPER))) > 3 * len(text or "")) << 2
    mask |= (len(raw.translate(None, _ODD)) < len(raw)) << 3
    return mask, hashlib.sha256(raw).digest()


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and label of every document."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [text_failures(t.as_py()) for t in batch.column(1)]
            mask, digest = pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), mask, digest], names=["doc_id", "part", "mask", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    rows = checkpoint(rows.mapInArrow(batches, f"doc_id {kind}, part string, mask int, digest binary"))
    # the first of each text joins by doc_id too, so that a text of very many copies is no key
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("first"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).cast("int").alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).cast("int").alias("toxic"))
    rows = rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copied = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    label = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    return rows.select("part", F.col("mask").bitwiseOR(copied).alias("mask"), label.alias("label"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    table = first_failures()
    base = np.arange(len(ORDERS)) * (STEPS + 1)

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def hand_over() -> Iterator[pa.RecordBatch]:
            for part, counts in held.items():
                cells = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells])], names=["part", "cell", "n"])
            held.clear()

        for whole in source:
            for begin in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(begin, CHUNK_ROWS)
                parts = batch.column(0).dictionary_encode()
                number, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
                mask, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for p, name in enumerate(names):
                    own = number == p
                    cells = (base + table[mask[own]]) * LABELS + label[own, None]
                    found = np.concatenate([np.bincount(cells.reshape(-1), minlength=_COUNTS), np.bincount(mask[own], minlength=MASKS)])
                    held[name] = held[name] + found if name in held else found
                    if len(held) > HELD_PARTS:
                        yield from hand_over()
        yield from hand_over()

    def report(key: tuple, cells: pa.Table) -> pa.Table:
        counts = np.zeros(_COUNTS + MASKS, np.int64)
        counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
        gone, masks = counts[:_COUNTS].reshape(len(ORDERS), STEPS + 1, LABELS), counts[_COUNTS:]
        removed = gone[:, 1:].sum(2)
        which = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
        failing = np.array([masks[np.arange(MASKS) >> f & 1 == 1].sum() for f in range(STEPS)])
        alone = masks[1 << np.arange(STEPS)]
        shapley = np.bincount(which.reshape(-1), removed.reshape(-1), STEPS).astype(np.int64)
        n, steps = removed.size, np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        columns = {
            "part": pa.array([key[0].as_py()] * n, pa.string()),
            "filter_order": pa.array(np.repeat(ORDERS, STEPS)),
            "step": pa.array(steps),
            "kept": masks.sum() - removed.cumsum(1),
            "removed": removed,
            "redundant": failing[which] - removed,
            "unique_fails": alone[which],
            "good_lost": gone[:, 1:, 1::2].sum(2),
            "toxic_lost": gone[:, 1:, 2:].sum(2),
            "shapley": shapley[which],
        }
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v.reshape(-1)) for k, v in columns.items()})

    counts = flagged(docs, labels).mapInArrow(counted, "part string, cell int, n long").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    numbers = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInArrow(report, f"part string, filter_order string, step int, {numbers}")
