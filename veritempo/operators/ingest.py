"""The write side: integrity checks, type-2 histories, relation life cycles, completeness, requests and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.operators.scope import by_user


def insert_once(existing: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Incoming rows whose key is new, one for each key (that with the least hash of its columns); and the rejected rest."""
    user = by_user(existing, incoming)
    held = existing.select(*user, key, F.lit(True).alias("__held")).distinct()
    order = Window.partitionBy(*user, key).orderBy(F.xxhash64(*incoming.columns))
    rows = incoming.withColumn("__copy", F.row_number().over(order)).join(held, [*user, key], "left")
    fresh = F.col("__held").isNull() & (F.col("__copy") == 1)
    return rows.where(fresh).select(*incoming.columns), rows.where(~fresh).select(*incoming.columns)


def missing_references(rows: DataFrame, column: str, targets: DataFrame, target_column: str) -> DataFrame:
    """Rows whose reference is not null and not among the targets."""
    user = by_user(rows, targets)
    known = targets.select(*user, F.col(target_column).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, [*user, column], "left_anti")


def violations(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """check and id of all violating rows: (check, rows, id column) each."""
    out = None
    for name, rows, column in checks:
        part = rows.select(F.lit(name).alias("check"), F.col(column).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def closing_history(rows: DataFrame, keys: list[str], at: str, id_column: str, singleton: Column) -> DataFrame:
    """Type-2 history where singleton holds: a new row closes the one before it; others stay open."""
    following = F.when(singleton, F.lead(at).over(Window.partitionBy(*keys).orderBy(at, id_column)))
    return rows.withColumns({"valid_from": F.col(at), "valid_to": following, "is_current": following.isNull()})


def relation_life(commands: DataFrame, keys: list[str], at: str = "at", mode: str = "mode") -> DataFrame:
    """Instances of relations from ordered commands: assert, historical, terminate, deny.

    assert opens an instance unless one is open, and refreshes its observed moment otherwise; historical is an ended
    instance of its own. terminate ends the open instance or, where none is open, the newest one there is; deny closes
    the open one and leaves its end unknown. An instance is the run of asserts between closings, found by counting
    closings before a row; so the fold over a relation is a running sum, not a loop.
    """
    order = Window.partitionBy(*keys).orderBy(at, "command_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = F.col(mode)
    rows = commands.withColumn("run", F.coalesce(F.sum(m.isin("terminate", "deny").cast("int")).over(before), F.lit(0)))
    in_run = Window.partitionBy(*keys, "run").orderBy(at, "command_id").rowsBetween(Window.unboundedPreceding, -1)
    instance = F.when(m == "assert", F.concat(F.lit("r"), F.col("run").cast("string"))).when(m == "historical", F.concat(F.lit("h"), F.col("command_id").cast("string")))
    rows = rows.withColumns({"open": F.coalesce(F.max((m == "assert").cast("int")).over(in_run), F.lit(0)) == 1, "made": instance})
    rows = rows.withColumn("newest", F.last("made", ignorenulls=True).over(before))
    # the newest instance is the open one where one is open, but for historical ones since
    own = F.when(F.col("open"), F.concat(F.lit("r"), F.col("run").cast("string"))).when(m == "terminate", F.col("newest"))
    rows = rows.withColumn("instance", F.coalesce("made", F.when(m.isin("terminate", "deny"), own))).where("instance is not null")
    made, ended = F.col("made").isNotNull(), m == "terminate"
    found = rows.groupBy(*keys, "instance").agg(
        F.min(F.when(made, F.col(at))).alias("valid_from"),
        F.max(F.when(made, F.col(at))).alias("observed_at"),
        F.max(F.when(ended, F.col(at))).alias("valid_to"),
        F.max(F.when(m == "deny", "deny")).alias("denied"),
        F.max(F.when(m == "historical", "historical")).alias("past"),
    )
    closed_by = F.coalesce(F.when(F.col("valid_to").isNotNull(), "terminate"), "denied", "past")
    return found.select(*keys, "valid_from", "observed_at", "valid_to", closed_by.isNull().alias("is_current"), closed_by.alias("closed_by"))


def completeness(candidates: DataFrame, requirements: DataFrame, slots: dict[str, Column]) -> DataFrame:
    """Per candidate: whether it may be stored, the missing slots, and which question to ask first.

    requirements: type_key, slot, importance (essential, useful), priority, ask. An essential missing slot blocks.
    """
    present = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in slots.items()]))
    rows = candidates.withColumn("present", present).join(requirements, "type_key", "left")
    missing = F.col("slot").isNotNull() & ~F.array_contains("present", F.col("slot"))
    essential = F.col("importance") == "essential"
    rank = F.struct(F.when(essential, 0).otherwise(1).alias("a"), F.col("priority"), F.col("slot"))
    key = [*by_user(candidates), "candidate_id"]
    found = rows.groupBy(*key).agg(
        F.array_sort(F.collect_set(F.when(missing, F.col("slot")))).alias("missing"),
        F.max(F.coalesce(missing & essential, F.lit(False))).alias("blocking"),
        F.min(F.when(missing & (essential | F.col("ask")), rank)).alias("first"),
    )
    return found.select(*key, "missing", "blocking", (~F.col("blocking")).alias("storable"), F.col("first.slot").alias("question"))


def merged_requirements(schemas: DataFrame, concept_closure: DataFrame) -> DataFrame:
    """Requirements per type with those of its ancestors; the nearest one's slot counts."""
    rows = concept_closure.join(schemas.withColumnRenamed("type_key", "ancestor"), "ancestor")
    near = Window.partitionBy("concept", "slot").orderBy("depth", "ancestor")
    return rows.withColumn("n", F.row_number().over(near)).where("n = 1").select(F.col("concept").alias("type_key"), "slot", "importance", "priority", "ask")


def claim_tally(claims: DataFrame) -> DataFrame:
    """Per request how its claims fared, and the outcome."""
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    rows = claims.groupBy("request_id").agg(F.count("*").alias("received"), count("committed").alias("committed"), count("rejected").alias("rejected"), count("deferred").alias("deferred"))
    outcome = F.when(F.col("committed") == F.col("received"), "committed").when(F.col("committed") > 0, "partial").when(F.col("deferred") > 0, "deferred").otherwise("unsupported")
    return rows.withColumn("outcome", outcome)


def idempotency(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Per request: proceed, replay, conflict, in_progress or recovery_required, against stored records.

    records: user_id, request_id, fingerprint, state (done, running, failed).
    """
    held = records.select("user_id", "request_id", F.col("fingerprint").alias("held"), "state")
    rows = requests.join(held, ["user_id", "request_id"], "left")
    result = (
        F.when(F.col("held").isNull(), "proceed")
        .when(F.col("held") != F.col("fingerprint"), "conflict")
        .when(F.col("state") == "done", "replay")
        .when(F.col("state") == "running", "in_progress")
        .otherwise("recovery_required")
    )
    return rows.withColumn("result", result).drop("held", "state")
