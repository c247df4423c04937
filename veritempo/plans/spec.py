"""A typed query over the assertion frames, and its execution."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.operators import attributes, events, ledger, measurements, relations, scope, states
from veritempo.sources.frames import KnowledgeFrames


class QueryError(ValueError):
    """A specification that can't be executed."""


class IsolationError(QueryError):
    """A specification that names what its user may not see."""


@dataclass(frozen=True)
class QuerySpec:
    """What is asked. Names of lists are conjunctive, their members alternatives.

    Modes by primitive: event list; attribute value_lookup, history, existence, proposition, snapshot; measurement
    latest, at_time, in_range, proposition; state list; relation list, boolean, historical, termination, held_during.
    """

    primitive: str = "event"  # event, fact, attribute, measurement, state or relation
    mode: str = "list"
    event_types: list[str] = field(default_factory=list)
    event_ids: list[int] = field(default_factory=list)
    actions: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    entity_ids: list[str] = field(default_factory=list)
    association: str | None = None  # actor, subject, object, context, relation_endpoint, relation_subject or relation_object
    fact_concepts: list[str] = field(default_factory=list)
    dimension: str | None = None
    relation_key: str | None = None
    object_types: list[str] = field(default_factory=list)
    text_value: str | None = None
    number_value: str | None = None
    unit: str | None = None
    currency: str | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    aggregate: str | None = None  # count, sum or latest
    include_descendants: bool = False
    current_facts: bool = True
    effective_only: bool = True  # leave out what corrections have retracted or replaced
    descending: bool = False
    limit: int | None = None
    user_id: int | None = None  # one user's knowledge; None asks for all users at once

    def range(self) -> tuple[Column | None, Column | None]:
        if self.start is None:
            return None, None
        return F.lit(self.start), F.lit(self.end)


def explain(spec: QuerySpec) -> dict:
    """The filters that a specification applies."""
    return {k: v for k, v in asdict(spec).items() if v not in (None, [], False)}


def _scoped(spec: QuerySpec, rows: DataFrame) -> DataFrame:
    return rows if spec.user_id is None else scope.snapshot(rows, spec.user_id)


def _effective(spec: QuerySpec, frames: KnowledgeFrames, rows: DataFrame, kind: str) -> DataFrame:
    """One user's or all rows of a primitive, without those that a correction has ended."""
    rows = _scoped(spec, rows)
    return ledger.effective(rows, f"{kind}_id", kind, frames.correction) if spec.effective_only else rows


#: What the entity ids of a specification may be.
ASSOCIATIONS = ("actor", "subject", "object", "context", "relation_endpoint", "relation_subject", "relation_object")


def _wanted(spec: QuerySpec, frames: KnowledgeFrames) -> DataFrame:
    """The entities asked about: of one user, or the ids for every user."""
    rows = frames.spark.createDataFrame([(e,) for e in spec.entity_ids], "entity_id string")
    return rows if spec.user_id is None else rows.withColumn(scope.USER, F.lit(spec.user_id).cast("long"))


def check(spec: QuerySpec, frames: KnowledgeFrames) -> None:
    """Raise for a specification that can't be executed, or that names what its user may not see."""
    if spec.primitive not in ("event", "fact", "attribute", "measurement", "state", "relation"):
        raise QueryError(f"unknown primitive {spec.primitive}")
    if spec.primitive in ("attribute", "measurement", "relation") and spec.mode != "snapshot" and not (spec.dimension or spec.relation_key):
        raise QueryError(f"{spec.primitive} needs a dimension or key")
    if (spec.mode == "held_during" or (spec.primitive == "measurement" and spec.mode == "at_time")) and spec.start is None:
        raise QueryError(f"{spec.mode} needs a range")
    if spec.mode in ("existence", "proposition") and spec.text_value is None and spec.number_value is None:
        raise QueryError(f"{spec.mode} needs a value")
    if spec.association is not None and spec.association not in ASSOCIATIONS:
        raise QueryError(f"unknown association {spec.association}")
    if spec.primitive in ("event", "fact") and spec.association in ("relation_subject", "relation_object"):
        raise QueryError(f"{spec.association} is for relations")
    free = (spec.primitive == "relation" and len(spec.entity_ids) >= 2) or (spec.actions and spec.entity_ids)
    if spec.primitive in ("event", "fact") and spec.entity_ids and not spec.association and not free:
        raise QueryError("entity_ids need an association")
    if spec.user_id is not None and (spec.entity_ids or spec.event_ids):
        wanted = _wanted(spec, frames)
        hidden = wanted.join(_scoped(spec, frames.entity), "entity_id", "left_anti").select("entity_id")
        if spec.event_ids:
            asked = frames.spark.createDataFrame([(e,) for e in spec.event_ids], "event_id long")
            hidden = hidden.unionByName(asked.join(_scoped(spec, frames.event), "event_id", "left_anti").select(F.col("event_id").cast("string").alias("entity_id")))
        if first := hidden.first():
            raise IsolationError(f"not visible: {first[0]}")


def _events(spec: QuerySpec, frames: KnowledgeFrames) -> DataFrame:
    rows = _effective(spec, frames, frames.event, "event")
    if spec.event_types and spec.include_descendants:
        below = events.closure(frames.concept).where(F.col("ancestor").isin(spec.event_types)).select(F.col("concept").alias("type_key")).distinct()
        rows = rows.join(below, "type_key", "left_semi")
    elif spec.event_types:
        rows = events.matching(rows, types=spec.event_types)
    rows = events.matching(rows, actions=spec.actions, statuses=spec.statuses, domains=spec.domains, ids=spec.event_ids)
    if spec.entity_ids:
        wanted = _wanted(spec, frames)
        if spec.association == "subject":
            rows = events.by_subject(rows, frames.participant, wanted)
        elif spec.association == "object":
            rows = events.by_object(rows, frames.participant, wanted)
        elif spec.association == "context":
            rows = events.in_context_of_all(rows, frames.participant, spec.entity_ids)
        elif spec.association == "relation_endpoint":
            rows = events.by_neighbour(rows, frames.participant, frames.relation, wanted)
        else:
            rows = events.by_actor(rows, frames.participant, wanted)
    start, end = spec.range()
    inside = F.lit(T.MATCH) if start is None else T.occurrence_membership(F.col("temporal"), start, end)
    return rows.withColumn("membership", inside).where(F.col("membership") != T.NO_MATCH)


def _attributes(spec: QuerySpec, frames: KnowledgeFrames, keys: list[str]) -> DataFrame:
    start, end = spec.range()
    rows = _effective(spec, frames, frames.attribute, "attribute")
    if spec.entity_ids:
        rows = rows.where(F.col("entity_id").isin(spec.entity_ids))
    if spec.mode == "snapshot":
        return attributes.value_lookup(rows, [*keys, "entity_id", "dimension"], start, end).where("status != 'unknown'")
    rows, keys = rows.where(F.col("dimension") == spec.dimension), [*keys, "entity_id"]
    if spec.mode == "history":
        return attributes.previous_values(rows, keys, first=not spec.descending, limit=spec.limit or 1)
    if spec.mode in ("existence", "proposition"):
        kind = "text" if spec.text_value is not None else "number"
        hit = attributes.value_matches(kind, spec.text_value, F.lit(spec.number_value).cast("decimal(18,2)"), spec.unit)
        ask = attributes.historical_existence if spec.mode == "existence" else attributes.proposition
        return ask(rows, keys, hit, start, end).select(*keys, "answer")
    return attributes.value_lookup(rows, keys, start, end)


def _measurements(spec: QuerySpec, frames: KnowledgeFrames) -> DataFrame:
    start, end = spec.range()
    rows = _effective(spec, frames, frames.measurement, "measurement").where(F.col("dimension") == spec.dimension)
    if spec.mode == "proposition":
        return measurements.value_proposition(rows, ["user_id"], F.lit(spec.number_value).cast("decimal(18,2)"), F.lit(spec.unit), start, end)
    if spec.mode == "at_time":
        return measurements.at_time(rows, ["user_id"], start, end)
    if spec.mode == "in_range":
        return measurements.in_range(rows, ["user_id"], start, end)
    return measurements.latest(rows, ["user_id"])


def _relations(spec: QuerySpec, frames: KnowledgeFrames, keys: list[str]) -> DataFrame:
    start, end = spec.range()
    rows = relations.by_key(_effective(spec, frames, frames.relation, "relation"), spec.relation_key)
    every = rows.select(*keys, "subject").distinct()
    if spec.object_types:
        rows = rows.drop("to_id").withColumnRenamed("object", "to_id")
        rows = relations.of_object_type(rows, frames.entity, spec.object_types).withColumnRenamed("to_id", "object")
    end_asked = "object" if spec.association == "relation_object" and len(spec.entity_ids) == 1 else "subject"
    if spec.entity_ids:
        # whoever has the entity gets an answer, with relations or without
        seen = _scoped(spec, frames.entity).where(F.col("entity_id").isin(spec.entity_ids[:1]))
        asked = seen.select(*keys, F.col("entity_id").alias(end_asked)).distinct()
        rows = rows.where(F.col(end_asked).isin(spec.entity_ids[:1]))
        if len(spec.entity_ids) > 1:
            rows = rows.where(F.col("object").isin(spec.entity_ids[1:2]))
    else:
        asked = every  # all that stand in the relation, whatever the type of the other end
    if spec.mode == "boolean":
        return relations.current_answer(asked, rows, [*keys, end_asked])
    if spec.mode == "historical":
        return relations.historical_existence(asked, rows, [*keys, end_asked])
    if spec.mode == "termination":
        return relations.termination(rows, [*keys, end_asked], asked)
    if spec.mode == "held_during":
        return relations.held_during(rows, [*keys, "subject", "object"], start, end)
    return relations.ranked(rows.where("is_current"), [*keys, end_asked])


def execute(spec: QuerySpec, frames: KnowledgeFrames) -> DataFrame:
    """The answer to a specification. Precedence: snapshot, measurement, attribute, relation, state, fact, event.

    All users at once, or the one that the specification names; user_id is in every key. A list of events has each
    user's first items by position, and matched_count.
    """
    frames = frames if spec.user_id is None else frames.of_user(spec.user_id)
    check(spec, frames)
    keys = [scope.USER]
    if spec.mode == "snapshot" or spec.primitive == "attribute":
        return _attributes(spec, frames, keys)
    if spec.primitive == "measurement":
        return _measurements(spec, frames)
    if spec.primitive == "relation":
        return _relations(spec, frames, keys)
    if spec.primitive == "state":
        rows = _effective(spec, frames, frames.state, "state")
        rows = rows if spec.dimension is None else rows.where(F.col("dimension") == spec.dimension)
        return states.current(rows, [*keys, "entity_id", "dimension"])
    chosen = _events(spec, frames)
    if spec.fact_concepts:
        facts = ledger.with_currency(_scoped(spec, frames.fact))  # superseded by any fact of the user, effective or not
        if spec.effective_only:
            facts = ledger.effective(facts, "fact_id", "fact", frames.correction)
        facts = facts.where(F.col("concept").isin(spec.fact_concepts))
        usable = facts.where("is_current") if spec.current_facts else facts
        if spec.aggregate == "sum":
            known = facts if spec.current_facts else facts.withColumn("is_current", F.lit(True))
            return events.money_sum(chosen, known, spec.fact_concepts, keys, spec.currency)
        if spec.aggregate == "latest":
            return events.latest(chosen, usable, keys)
        rows = events.with_facts(chosen, usable, spec.fact_concepts)
        return rows.groupBy(*keys).agg(F.count("*").alias("n")) if spec.aggregate == "count" else rows
    if spec.aggregate == "count":
        return events.counts(chosen, keys)
    items = events.event_items(chosen, frames.participant)
    return events.listed(items, keys, spec.limit, "event_time", spec.descending)
