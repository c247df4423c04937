"""Users' knowledge kept apart: user_id belongs to every key, and requests are checked against what a user may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER = "user_id"


class MixedUsersError(ValueError):
    """Rows of users meet rows that name no user."""


def by_user(*frames: DataFrame, shared: bool = False) -> list[str]:
    """The user's column, for the front of a key, or nothing where no frame has users.

    Where only some of the frames have it, a key without it would mix users: that raises, unless `shared` says that the
    others hold for every user.
    """
    having = [USER in f.columns for f in frames]
    if any(having) and not all(having) and not shared:
        raise MixedUsersError("some of the frames have no user_id")
    return [USER] if all(having) else []


def association_error(n_entities: Column, association: Column, primitive: Column, n_actions: Column) -> Column:
    """Why a request's entity ids can't be read without an association, or null.

    They need one, but for a relation with two ids or more and for an action with one.
    """
    free = ((primitive == "relation") & (n_entities >= 2)) | ((n_actions > 0) & (n_entities >= 1))
    return F.when((n_entities > 0) & association.isNull() & ~free, "association_missing")


def visibility(requests: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """Per request (user_id, request_id): error, which is null, association_missing or isolation, and hidden ids.

    requests: user_id, request_id, primitive, association, actions, entity_ids, event_ids. An id is visible if the same
    user has it; another user's id and one that doesn't exist are told apart by nothing.
    """
    asked = requests.select(USER, "request_id", F.explode(F.concat(F.transform("entity_ids", lambda x: F.struct(F.lit("entity").alias("kind"), x.alias("id"))), F.transform("event_ids", lambda x: F.struct(F.lit("event").alias("kind"), x.cast("string").alias("id"))))).alias("x"))
    asked = asked.select(USER, "request_id", "x.*")
    known = entities.select(USER, F.lit("entity").alias("kind"), F.col("entity_id").alias("id")).unionByName(events.select(USER, F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id")))
    hidden = asked.join(known, [USER, "kind", "id"], "left_anti").groupBy(USER, "request_id").agg(F.count("*").alias("n_hidden"), F.min("id").alias("first_hidden"))
    rows = requests.join(hidden, [USER, "request_id"], "left")
    wrong = association_error(F.size("entity_ids"), F.col("association"), F.col("primitive"), F.size("actions"))
    return rows.select(USER, "request_id", F.coalesce(wrong, F.when(F.col("n_hidden") > 0, "isolation")).alias("error"), F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"), "first_hidden")


def snapshot(rows: DataFrame, user_id: int) -> DataFrame:
    """One user's rows; on tables laid out by user a pruned scan."""
    return rows.where(F.col(USER) == user_id)


def with_own_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts whose source is there and belongs to the same user; the others are dropped, as on loading."""
    return facts.join(sources.select(USER, "source_id"), [USER, "source_id"], "left_semi")


def wrong_kind(keys: DataFrame, concepts: DataFrame) -> DataFrame:
    """keys(key, expected) that no concept bears (unknown) or that are of another kind (kind_mismatch).

    concepts: concept, kind.
    """
    rows = keys.join(concepts.select(F.col("concept").alias("key"), "kind"), "key", "left")
    error = F.when(F.col("kind").isNull(), "unknown").when(F.col("kind") != F.col("expected"), "kind_mismatch")
    return rows.withColumn("error", error).where("error is not null").select(*keys.columns, "error")
