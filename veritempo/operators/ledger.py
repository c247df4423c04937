"""The append-only correction ledger and fact supersession."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.operators.scope import by_user
from veritempo.storage import checkpoint


def effective(rows: DataFrame, id_column: str, kind: str, corrections: DataFrame) -> DataFrame:
    """Rows that no correction targets; retracted and replaced rows go alike."""
    user = by_user(rows, corrections)
    gone = corrections.where(F.col("kind") == kind).select(*user, F.col("target_id").alias(id_column))
    return rows.join(gone, [*user, id_column], "left_anti")


def effectiveness(rows: DataFrame, id_column: str, kind: str, corrections: DataFrame, unknown: Column) -> DataFrame:
    """Rows with effectiveness: ineffective if corrected, unknown where the condition holds, else effective."""
    user = by_user(rows, corrections)
    gone = corrections.where(F.col("kind") == kind).select(*user, F.col("target_id").alias(id_column), F.lit(True).alias("__gone")).distinct()
    status = F.when(F.col("__gone"), "ineffective").when(unknown, "unknown").otherwise("effective")
    return rows.join(gone, [*user, id_column], "left").withColumn("effectiveness", status).drop("__gone")


def explained(rows: DataFrame, id_column: str, kind: str, corrections: DataFrame) -> DataFrame:
    """Ineffective rows with the correction that made them so."""
    user = by_user(rows, corrections)
    why = corrections.where(F.col("kind") == kind).select(*user, F.col("target_id").alias(id_column), "action", "replacement_id")
    return rows.join(why, [*user, id_column])


def current_facts(facts: DataFrame) -> DataFrame:
    """Facts that no fact of the same user in the whole frame supersedes."""
    user = by_user(facts)
    replaced = facts.select(*user, F.col("supersedes_id").alias("fact_id")).where("fact_id is not null")
    return facts.join(replaced, [*user, "fact_id"], "left_anti")


def with_currency(facts: DataFrame) -> DataFrame:
    """All facts with is_current: whether no fact of the same user supersedes them."""
    user = by_user(facts)
    replaced = facts.where("supersedes_id is not null").select(*user, F.col("supersedes_id").alias("fact_id"), F.lit(False).alias("is_current")).distinct()
    return facts.join(replaced, [*user, "fact_id"], "left").withColumn("is_current", F.coalesce("is_current", F.lit(True)))


def fact_items(facts: DataFrame, events: DataFrame) -> DataFrame:
    """Facts as items: event and its time, amount and currency, source, predecessor, and whether it is current."""
    user = by_user(facts, events)
    times = events.select(*user, F.col("event_id").alias("about_id"), F.date_format(T.sort_instant(F.col("temporal")), "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"))
    rows = with_currency(facts).join(times, [*user, "about_id"], "left")
    return rows.select(*user, "fact_id", F.col("about_id").alias("event_id"), "event_time", "concept", "amount", "currency", "source_id", "supersedes_id", "is_current", "created_at")


def history(facts: DataFrame) -> DataFrame:
    """All versions per (about, concept) with their number, oldest first."""
    order = Window.partitionBy(*by_user(facts), "about_id", "concept").orderBy("created_at", "fact_id")
    return facts.withColumn("version", F.row_number().over(order))


def branched(facts: DataFrame) -> DataFrame:
    """Facts with more than one direct successor, which a ledger must refuse."""
    return facts.where("supersedes_id is not null").groupBy(*by_user(facts), "supersedes_id").agg(F.count("*").alias("successors")).where("successors > 1")


def last_replacements(corrections: DataFrame) -> DataFrame:
    """user_id, kind, target_id, last_id, steps and outcome of every corrected assertion, by pointer jumping.

    A replacement may be corrected in turn: following (target, replacement) to the end gives the assertion that stands for
    the target now. Each round doubles the distance that every open pointer has come, so a chain of n corrections takes
    log2(n) rounds; what has found its end is set aside and only looked up. outcome: replaced (last_id is effective),
    retracted (the chain ends in a retraction of last_id), cycle (it has no end; last_id is the least assertion on the way),
    or branched, where the target or one on the way has several corrections (last_id is the first such one); those and the
    cycles must be refused by a ledger. steps counts the corrections on the way. A way that comes to its least assertion
    twice goes round: that ends the rounds at about twice the longest cycle, whatever the number of corrections.
    """
    key = [*by_user(corrections), "kind"]
    counted = corrections.groupBy(*key, "target_id").agg(F.count("*").alias("n"), F.min(F.struct("action", "replacement_id")).alias("c"))
    end = F.when(F.col("n") > 1, "branched").when(F.col("c.action") == "retract", "retracted")
    start = counted.select(
        *key, "target_id", F.when(end.isNull(), F.col("c.replacement_id")).otherwise(F.col("target_id")).alias("at"), F.when(end.isNull() | (end == "retracted"), 1).otherwise(0).alias("steps"), end.alias("outcome"),
        F.col("target_id").alias("least"), F.lit(1).alias("times"),  # of the assertions from the target to before `at`
    )
    table = checkpoint(start)
    done, open_ = [table.where("outcome is not null")], table.where("outcome is null")
    while True:
        ahead = reduce(DataFrame.unionByName, [*done, open_]).select(*key, F.col("target_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("outcome").alias("ends"), F.col("least").alias("further"), F.col("times").alias("times_further"))
        jumped = open_.join(ahead, [*key, "at"], "left")
        going = F.col("next").isNotNull()
        least = F.least("least", "further")  # skips nulls
        times = F.when(F.col("least") == least, F.col("times")).otherwise(0) + F.when(F.col("further") == least, F.col("times_further")).otherwise(0)
        ends = F.when(~going, "replaced").otherwise(F.coalesce("ends", F.when(times > 1, "cycle")))
        moved = checkpoint(jumped.select(*key, "target_id", F.when(going, F.col("next")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.when(going, F.col("more")).otherwise(0)).alias("steps"), ends.alias("outcome"), least.alias("least"), times.alias("times")))
        done, open_ = [*done, moved.where("outcome is not null")], moved.where("outcome is null")
        if open_.isEmpty():
            break
    cycle = F.col("outcome") == "cycle"
    return reduce(DataFrame.unionByName, done).select(*key, "target_id", F.when(cycle, F.col("least")).otherwise(F.col("at")).alias("last_id"), F.when(~cycle, F.col("steps")).alias("steps"), "outcome")


def correction_errors(corrections: DataFrame, ids: DataFrame) -> DataFrame:
    """Corrections with a reason against them: second for its target, missing target, or a wrong replacement.

    ids: user_id, kind and id of all assertions; only the same user's count.
    """
    user = by_user(corrections, ids)
    number = F.row_number().over(Window.partitionBy(*by_user(corrections), "kind", "target_id").orderBy("action", "replacement_id"))
    known = ids.select(*user, "kind", F.col("id").alias("target_id"), F.lit(True).alias("known")).distinct()
    rows = corrections.withColumn("number", number).join(known, [*user, "kind", "target_id"], "left")
    reason = (
        F.when(F.col("known").isNull(), "target_missing")
        .when(F.col("number") > 1, "branch")
        .when((F.col("action") == "retract") & F.col("replacement_id").isNotNull(), "retract_with_replacement")
        .when((F.col("action") == "replace") & F.col("replacement_id").isNull(), "replace_without_replacement")
        .when((F.col("action") == "replace") & (F.col("replacement_id") == F.col("target_id")), "replaces_itself")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*corrections.columns, "reason")


def valid_periods(rows: DataFrame, keys: list[str], at: str, id_column: str) -> DataFrame:
    """Type-2 history of states: a new row closes the one before it and names it; the last is current.

    As in the reference, a state's own start stays unknown: valid_from is null.
    """
    order = Window.partitionBy(*keys).orderBy(at, id_column)
    following = F.lead(at).over(order)
    return rows.withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_to": following, "is_current": following.isNull(), "supersedes_id": F.lag(id_column).over(order)})
