"""Registry, focus and readiness operators: newest rows, catalogue counts, targets of corrections, salience, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.operators.events import closure
from veritempo.operators.scope import by_user
from veritempo.operators.targets import matches


def newest(rows: DataFrame, keys: list[str], at: str, id_column: str) -> DataFrame:
    """The newest row per keys, ties to the greatest id; partial maxima, no window."""
    best = F.max_by(F.struct(*rows.columns), F.struct(at, id_column))
    return rows.groupBy(*keys).agg(best.alias("__r")).select("__r.*")


def catalogue_counts(concepts: DataFrame) -> DataFrame:
    """Per root of the hierarchy: concepts below it, and the greatest depth."""
    below = closure(concepts)
    roots = concepts.where("parent is null").select(F.col("concept").alias("ancestor"))
    return below.join(roots, "ancestor").groupBy(F.col("ancestor").alias("root")).agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def conflicting_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts registered under more than one parent."""
    rows = concepts.groupBy("concept").agg(F.count_distinct(F.coalesce("parent", F.lit(""))).alias("parents"))
    return rows.where("parents > 1")


def unknown_keys(keys: DataFrame, concepts: DataFrame) -> DataFrame:
    """Keys that no concept has: what is to be learned."""
    return keys.select("concept").distinct().join(concepts, "concept", "left_anti")


def correction_targets(descriptions: DataFrame, candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """description_id, status, target_id and n: the effective candidates that fit a description.

    descriptions: description_id, scope, part (of a name, may be null), amount and kind (both may be null). candidates:
    scope, id, name, amount, kind. Name parts are contained, the rest is equal or missing. A description meets only
    candidates of its scope (a user or place), by the rarest string of its part, its amount or its kind: see `targets`.
    """
    user = by_user(descriptions, candidates)
    live = candidates.join(corrections.select(*by_user(candidates, corrections), F.col("target_id").alias("id")), [*by_user(candidates, corrections), "id"], "left_anti")
    kind = lambda rows: F.col("kind") if "kind" in rows.columns and "kind" in descriptions.columns else F.lit(None).cast("string")
    asked = descriptions.select(*user, "description_id", "scope", "part", F.col("amount").alias("number"), kind(descriptions).alias("text"))
    held = live.select(*user, "scope", "id", F.array("name").alias("names"), F.col("amount").alias("number"), kind(live).alias("text"))
    found = matches(asked, held, [*user, "scope"]).select(*user, "description_id", "n", "one")
    rows = descriptions.select(*user, "description_id").join(found, [*user, "description_id"], "left")
    status = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return rows.select(*user, "description_id", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("target_id"), F.coalesce("n", F.lit(0)).alias("n"))


def inferred_ownership(possessives: DataFrame, relations: DataFrame, key: str = "owns") -> DataFrame:
    """owner, entity_id of ownership that possessive mentions imply and no current relation of the same user has yet."""
    pair = [*by_user(possessives, relations), "owner", "entity_id"]
    held = relations.where("is_current").where(F.col("key") == key).withColumns({"owner": F.col("from_id"), "entity_id": F.col("to_id")})
    return possessives.select(*pair).distinct().join(held.select(*pair), pair, "left_anti")


def salience(commits: DataFrame, keys: list[str], position: str, entity: str = "entity_id") -> DataFrame:
    """Per keys and entity its salience after all commits: 1 in focus, 0.6 just before, then 0.85 of it each time.

    What falls under 0.2 is dropped. The position counts commits from 1, so the fold has a closed form.
    """
    last = commits.groupBy(*keys, entity).agg(F.max(position).alias("last"))
    length = commits.groupBy(*keys).agg(F.max(position).alias("n"))
    age = F.col("n") - F.col("last")
    value = F.when(age == 0, F.lit(1.0)).otherwise(F.lit(0.6) * F.pow(F.lit(0.85), age - 1))
    return last.join(length, keys).select(*keys, entity, F.round(value, 6).alias("salience")).where("salience >= 0.2")


#: Slots that each primitive needs before it may be stored.
SLOTS = {"event": ["type", "time"], "relation": ["subject", "object", "key"], "attribute": ["subject", "dimension", "value"], "measurement": ["subject", "dimension", "value"], "state": ["subject", "dimension", "value"]}


def missing_slots(primitive: Column, present: dict[str, Column]) -> Column:
    """Sorted array of the slots that a proposal lacks; null for a primitive without rules."""
    out = F.lit(None).cast("array<string>")
    for name, slots in SLOTS.items():
        lacks = F.array_sort(F.array_compact(F.array(*[F.when(~present[s], F.lit(s)) for s in slots])))
        out = F.when(primitive == name, lacks).otherwise(out)
    return out


def readiness(assertions: DataFrame) -> DataFrame:
    """proposal_id, n, ready and decision of assertions(proposal_id, missing): what may be done without asking."""
    known = F.col("missing").isNotNull()
    key = [*by_user(assertions), "proposal_id"]
    rows = assertions.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(known & (F.size("missing") == 0)).alias("ready"), F.count_if(~known).alias("unsupported"), F.min(F.when(known & (F.size("missing") == 1), F.element_at("missing", 1))).alias("ask"))
    decision = (
        F.when(F.col("ready") == F.col("n"), "auto")
        .when(F.col("ready") > 0, "partial")
        .when(F.col("ask").isNotNull(), "clarify")
        .when(F.col("unsupported") == F.col("n"), "unsupported")
        .otherwise("safe_abstain")
    )
    return rows.select(*key, "n", "ready", decision.alias("decision"), F.when(decision == "clarify", F.col("ask")).alias("ask"))
