"""Schemas of stored frames, checks against them, and forward-only migrations as a fold of transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions.temporal import TEMPORAL

#: Columns that every stored frame must have, with their types; temporal columns have the struct of `temporal`.
REQUIRED = {
    "entity": {"user_id": "bigint", "entity_id": "string", "type_key": "string", "name": "string"},
    "event": {"user_id": "bigint", "event_id": "bigint", "type_key": "string", "status": "string", "temporal": TEMPORAL, "created_at": "timestamp"},
    "participant": {"user_id": "bigint", "event_id": "bigint", "entity_id": "string", "role": "string"},
    "fact": {"user_id": "bigint", "fact_id": "bigint", "about_id": "bigint", "concept": "string", "amount": "decimal(18,2)", "currency": "string", "supersedes_id": "bigint"},
    "relation": {"user_id": "bigint", "relation_id": "string", "from_id": "string", "to_id": "string", "key": "string", "is_current": "boolean", "temporal": TEMPORAL},
    "state": {"user_id": "bigint", "state_id": "bigint", "entity_id": "string", "dimension": "string", "value": "string", "is_current": "boolean"},
    "attribute": {"user_id": "bigint", "attribute_id": "bigint", "entity_id": "string", "dimension": "string", "is_current": "boolean", "temporal": TEMPORAL},
    "measurement": {"user_id": "bigint", "measurement_id": "bigint", "dimension": "string", "value": "decimal(18,2)", "unit": "string", "observed_at": "timestamp"},
    "correction": {"user_id": "bigint", "kind": "string", "target_id": "bigint", "action": "string", "replacement_id": "bigint"},
}


class MigrationError(ValueError):
    """A version that is newer than known, unknown, or not advanced by its step."""


def schema_faults(frame: DataFrame, name: str) -> list[str]:
    """Columns that a stored frame lacks, or has with another type."""
    types = dict(frame.dtypes)
    return [c if c not in types else f"{c}: {types[c]}" for c, kind in REQUIRED[name].items() if types.get(c) != kind]


def empty_frame(spark, name: str) -> DataFrame:
    """A stored frame without rows, to start a store with."""
    return spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in REQUIRED[name].items()))


def append_log(rows: DataFrame, path: str) -> None:
    """Append stages of requests (request_id, stage, at, body) to a log of JSON lines, laid out by day."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)


def upgrade(frames: dict[str, DataFrame], version: int, steps: list[tuple[int, int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]], target: int) -> tuple[dict[str, DataFrame], list[int]]:
    """Frames at the target version, and the versions that were passed. steps: (from, to, transform), in any order."""
    if version > target:
        raise MigrationError(f"version {version} is newer than {target}")
    by_start = {start: (end, step) for start, end, step in steps}
    passed = []
    while version < target:
        if version not in by_start:
            raise MigrationError(f"no step from version {version}")
        end, step = by_start[version]
        if end <= version:
            raise MigrationError(f"the step from {version} doesn't advance")
        frames, version = step(frames), end
        passed.append(version)
    return frames, passed


def backfilled_participants(actor: Column, subject: Column) -> Column:
    """Participants of an event that only has the two legacy columns: one safe role each, nothing for nulls."""
    def part(entity: Column, role: str) -> Column:
        return F.when(entity.isNotNull(), F.struct(entity.alias("entity_id"), F.lit(role).alias("role")))

    return F.array_compact(F.array(part(actor, "role.participant"), part(subject, "role.affected")))


def add_participants(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The step that gives events participants from their actor and subject."""
    events = frames["event"]
    return frames | {"event": events.withColumn("participants", backfilled_participants(F.col("actor_id"), F.col("subject_id")))}


def trained_catalog(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and lemma aliases of a JSON catalog file: {concepts: [{key, kind, parent, lemmas}]}."""
    schema = "concepts array<struct<key:string,kind:string,parent:string,lemmas:array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("concepts").alias("c")).select("c.*")
    rows = rows.where(F.col("key").rlike(r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+)*$"))
    return rows.drop("lemmas"), rows.select(F.explode("lemmas").alias("alias"), F.col("key").alias("concept"))
