"""Discourse state: what a conversation is about, turn by turn, as a batch fold and as a stream, by one function.

A turn is the outcome of a question or a write: user_id, conv_id, turn, kind (query, write, pending, clarify), ok, ids (the
entities that it is about, without the speaker), primitive, relation_type, result_kind, types (entity to type), continues
(a write that leaves a pending question open), attribute (a write of an attribute or measurement), dimension and
candidates (of a pending question).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from veritempo.operators.scope import USER

#: Turns about nothing after which the focus goes, referents kept, and what a faded one must still have.
IDLE_TURNS, REFERENTS, LEAST = 8, 8, 0.2
FADE, BEFORE, ASKED = 0.85, 0.6, 0.9
STATE = "turns long, focus array<string>, target_type string, primitive string, relation_type string, result_kind string, referents array<struct<entity_id: string, salience: double>>, pending_dimension string, pending_candidates array<string>, idle long, reason string"
EMPTY: dict = {"turns": 0, "focus": [], "target_type": None, "primitive": None, "relation_type": None, "result_kind": None, "referents": [], "pending_dimension": None, "pending_candidates": [], "idle": 0, "reason": None}


def _faded(referents: list[tuple[str, float]]) -> list[tuple[str, float]]:
    weaker = [(e, round(s * FADE, 3)) for e, s in referents]
    return [(e, s) for e, s in weaker if s >= LEAST]


def advance(state: dict, turn: dict) -> dict:
    """The state after a turn. Referents are (entity_id, salience), latest first."""
    kind, ids, at = turn["kind"], list(dict.fromkeys(turn["ids"] or [])), {**state, "turns": state["turns"] + 1}
    if kind == "clarify":
        return at
    if kind == "pending":
        asked = list(dict.fromkeys(turn["candidates"] or []))
        rest = [r for r in state["referents"] if r[0] not in asked]
        referents = [(e, ASKED) for e in reversed(asked)] + rest
        return {**at, "pending_dimension": turn["dimension"], "pending_candidates": asked, "referents": referents[:REFERENTS], "reason": "pending_query_stored"}
    if not ids or (kind == "write" and not turn["ok"]):
        idle = state["idle"] + 1
        if idle > IDLE_TURNS:
            return {**at, "focus": [], "target_type": None, "referents": _faded(state["referents"]), "idle": idle, "reason": "idle_cleared"}
        return {**at, "idle": idle}
    before = [e for e in state["focus"] if e not in ids]
    switched = bool(state["focus"]) and len(before) == len(state["focus"])
    done = "successful_query" if kind == "query" else "successful_attribute_write" if turn["attribute"] else "successful_write"
    rest = [r for r in _faded(state["referents"]) if r[0] not in ids and r[0] not in before]
    referents = [(e, 1.0) for e in reversed(ids)] + [(e, BEFORE) for e in before] + rest
    types = dict(turn["types"] or {})
    closes = kind == "query" or not turn["continues"]
    return {
        **at,
        "focus": ids,
        "target_type": next((types[e] for e in ids if types.get(e)), None),
        "primitive": turn["primitive"] if kind == "query" else "ingest",
        "relation_type": turn["relation_type"],
        "result_kind": turn["result_kind"] if kind == "query" else "write",
        "referents": referents[:REFERENTS],
        "pending_dimension": None if closes else state["pending_dimension"],
        "pending_candidates": [] if closes else state["pending_candidates"],
        "idle": 0,
        "reason": "topic_switch" if switched else done,
    }


def _shown(state: dict) -> dict:
    return {**state, "referents": [{"entity_id": e, "salience": s} for e, s in state["referents"]]}


_OUT = ["user_id", "conv_id", *EMPTY]
OUTPUT = f"user_id long, conv_id long, {STATE}"
_ARROW = pa.schema(
    [("user_id", pa.int64()), ("conv_id", pa.int64()), ("turns", pa.int64()), ("focus", pa.list_(pa.string())), ("target_type", pa.string()), ("primitive", pa.string()), ("relation_type", pa.string()), ("result_kind", pa.string()), ("referents", pa.list_(pa.struct([("entity_id", pa.string()), ("salience", pa.float64())]))), ("pending_dimension", pa.string()), ("pending_candidates", pa.list_(pa.string())), ("idle", pa.int64()), ("reason", pa.string())]
)


def folded(turns: DataFrame) -> DataFrame:
    """The state of every conversation after all its turns, in one pass over its turns in order; only the state is held."""

    def fold_one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = EMPTY
        for batch in batches:
            for turn in batch.to_pylist():
                state = advance(state, turn)
        row = {"user_id": key[0].as_py(), "conv_id": key[1].as_py(), **_shown(state)}
        yield pa.RecordBatch.from_pylist([row], _ARROW)

    # grouping by the same columns keeps the partitions and their order
    ordered = turns.repartition(USER, "conv_id").sortWithinPartitions(USER, "conv_id", "turn")
    return ordered.groupBy(USER, "conv_id").applyInArrow(fold_one, OUTPUT)


_REFERENT = StructType([StructField("entity_id", StringType()), StructField("place", LongType()), StructField("salience", StringType())])
_HELD = StructType([StructField("turns", LongType()), StructField("focus", ArrayType(StringType())), StructField("target_type", StringType()), StructField("primitive", StringType()), StructField("relation_type", StringType()), StructField("result_kind", StringType()), StructField("idle", LongType()), StructField("reason", StringType())])


class DiscourseProcessor(StatefulProcessor):
    """Keeps a conversation's focus as a value, its referents as a list and its pending question as a map.

    With `patience`, a pending question goes that many milliseconds after it was asked, by a timer of processing time.
    """

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.referents = handle.getListState("referents", _REFERENT)
        self.pending = handle.getMapState("pending", StructType([StructField("dimension", StringType())]), StructType([StructField("candidates", ArrayType(StringType()))]))

    def _load(self) -> dict:
        state = dict(EMPTY)
        if self.held.exists():
            state |= dict(zip([f.name for f in _HELD.fields], self.held.get(), strict=True))
            state["focus"] = list(state["focus"] or [])
        if self.referents.exists():
            state["referents"] = [(e, float(s)) for e, _, s in sorted(self.referents.get(), key=lambda r: r[1])]
        if self.pending.exists():
            for key, value in self.pending.iterator():
                state["pending_dimension"], state["pending_candidates"] = key[0] or None, list(value[0] or [])
        return state

    def _store(self, state: dict) -> None:
        self.held.update(tuple(state[f.name] for f in _HELD.fields))
        self.referents.clear()
        if state["referents"]:
            self.referents.put([(e, place, repr(s)) for place, (e, s) in enumerate(state["referents"])])
        self.pending.clear()
        if state["pending_dimension"] is not None or state["pending_candidates"]:
            self.pending.updateValue((state["pending_dimension"] or "",), (state["pending_candidates"],))

    def _row(self, key: tuple, state: dict) -> pd.DataFrame:
        return pd.DataFrame([{"user_id": key[0], "conv_id": key[1], **_shown(state)}], columns=_OUT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        turns = pd.concat(list(rows)).sort_values("turn")
        for turn in turns.to_dict("records"):
            listed = {k: list(turn[k]) if turn[k] is not None and not isinstance(turn[k], float) else [] for k in ("ids", "candidates")}
            state = advance(state, {k: None if isinstance(v, float) and pd.isna(v) else v for k, v in turn.items()} | listed)
        self._store(state)
        if self.patience is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if state["pending_dimension"] is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = {**self._load(), "pending_dimension": None, "pending_candidates": [], "reason": "pending_expired"}
        self._store(state)
        yield self._row(key, state)

    def close(self) -> None:
        pass


def streamed(turns: DataFrame, patience: int | None = None) -> DataFrame:
    """The state of every conversation after each batch in which it had turns. Needs the RocksDB state store."""
    mode = "none" if patience is None else "processingTime"
    return turns.groupBy(USER, "conv_id").transformWithStateInPandas(DiscourseProcessor(patience), OUTPUT, "update", mode)
