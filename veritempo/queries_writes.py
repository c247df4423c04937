"""Queries of the write path: stated times, validation, materialisation and corrections, over candidates made of orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.operators import writes
from veritempo.queries_rules import GUARD_PARTS, said
from veritempo.registry import query, query_of_two_users, text_of
from veritempo.storage import checkpoint

CONCEPT_KINDS = [("event.order", "event"), ("event.recurring_bill", "event"), ("action.buy", "action"), ("attribute.amount", "attribute"), ("state.open", "state_value"), ("relation.owns", "relation"), ("entity.person", "entity")]
FIELDS = ["event.type", "event.action", "fact.attribute", "state.value", "relation.type", "mention.type"]
NAMED = ["event.order", "action.buy", "attribute.amount", "state.open", "relation.owns", "entity.person", "event.nothing"]
ROLES = ["role.actor", "role.object", "role.context", "role.provider", "role.instrument"]
STATUSES, REFERENCES = ["resolved", "resolved", "create_candidate", "resolved", "unresolved", "create_candidate", "ambiguous"], ["named", "named", "possessive", "named", "contextual"]
POLICIES = ["next", "previous", "next_strict", "from_status", None]


def _pick(key: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


# Times --------------------------------------------------------------------------------------------------------------


@query
def stated_times(f):
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    none = F.lit(None)
    s = {
        "relative_day": F.when(k % 5 == 0, _pick(k, ["today", "yesterday", "tomorrow"])), "weekday": F.when(k % 7 == 0, k % 8).cast("int"), "weekday_policy": _pick(k, POLICIES), "date": F.when(k % 3 == 0, F.date_add(day, F.when(k % 30 == 0, 0).otherwise(1))),
        "instant": none.cast("timestamp"), "time_of_day": F.when(k % 4 == 0, "09:30"), "monthday": F.when(k % 11 == 0, 10), "period_start": F.when(k % 13 == 0, F.col("o_orderdate")), "period_end": F.when(k % 26 == 0, F.date_add(day, (k % 3 - 1).cast("int")).cast("timestamp")),
        "month": F.when(k % 17 == 0, 3), "year": F.when(k % 19 == 0, 1999), "relation": F.when(k % 23 == 0, "after"), "unknown_reason": F.when(k % 29 == 0, "forgotten"), "text": F.lit("some day"),
    }
    status = F.when(k % 2 == 0, "completed").when(k % 6 == 1, "scheduled")
    found = T.with_stated_time(f.table("orders"), s, F.when(k % 9 != 0, F.col("o_orderdate")), F.lit("-03:00"), status)
    return found.select(k.alias("k"), F.coalesce("error", F.lit("")).alias("error"), F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce(F.col("temporal.date").cast("string"), F.lit("")).alias("day"), F.coalesce(F.date_format("temporal.instant", "yyyy-MM-dd HH:mm"), F.lit("")).alias("instant"), F.coalesce("temporal.precision", "temporal.granularity", F.lit("")).alias("precision"))


# Candidates -----------------------------------------------------------------------------------------------------------


def _user(key: str) -> Column:
    return (F.col(key) % 2 + 1).cast("long").alias("user_id")


def _candidates(f):
    k = F.col("o_orderkey")
    time = F.when(k % 7 == 0, T.at_instant(F.col("o_orderdate"))).when(k % 10 == 2, T.unknown_time(F.lit("some day"))).otherwise(T.on_day(F.to_date("o_orderdate")))
    return f.table("orders").select(
        _user("o_orderkey"), k.alias("candidate_id"), _pick(k, ["event", "event", "state", "relation", "obligation"]).alias("primitive"), F.when(k % 10 == 0, "correct").otherwise("record").alias("intent"), F.when(k % 3 == 0, "inference").otherwise("user").alias("source_kind"),
        F.when(k % 5 != 4, time).alias("temporal"), F.when(k % 2 == 0, "day").alias("stated_precision"), (k % 28 == 0).alias("stated_clock"), F.when(k % 3 == 0, "event.recurring_bill").otherwise("event.order").alias("type_key"), F.when(k % 4 != 0, "action.buy").alias("action"), F.lit("completed").alias("status"),
        F.when(k % 8 < 6, "monthly").otherwise("weekly").alias("frequency"), F.when(k % 25 != 4, 10).alias("monthday"), F.when(k % 20 == 0, k).alias("target_id"),
    )


def _references(f):
    rows = f.table("lineitem").where("l_linenumber <= 2")
    return rows.select(_user("l_orderkey"), F.col("l_orderkey").alias("candidate_id"), _pick(F.col("l_suppkey"), FIELDS).alias("field"), _pick(F.when(F.col("l_partkey") % 6 != 0, F.col("l_suppkey") % 6).otherwise(F.col("l_partkey")), NAMED).alias("key"))


def _mentions(f):
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    status = _pick(part % 7, STATUSES)
    return f.table("lineitem").where("l_linenumber >= 3").select(
        _user("l_orderkey"), F.col("l_orderkey").alias("candidate_id"), F.concat(F.lit("m"), n.cast("string")).alias("text"), status.alias("status"), _pick(F.col("l_suppkey") % 5, REFERENCES).alias("reference_kind"), F.when(n % 4 != 0, "entity.thing").alias("create_type"), F.lit(None).cast("string").alias("create_name"),
        (n % 2 == 0).alias("vehicle"), F.when(status == "resolved", F.concat(F.lit("p:"), part.cast("string"))).alias("entity_id"), _pick(n + part, ROLES).alias("role"), n.alias("position"),
    )


def _facts(f):
    k = F.col("o_orderkey")
    amount = F.when(k % 31 == 0, "abc").when(k % 37 == 1, "-5").otherwise(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    return f.table("orders").select(_user("o_orderkey"), k.alias("candidate_id"), F.lit("attribute.amount").alias("key"), F.lit(1).alias("position"), _pick(k, ["exact", "approximately", "about"]).alias("qualifier"), _pick(k % 40, ["uncertain", "inferred", *["stated"] * 38]).alias("epistemic"), F.when(k % 41 == 0, 1.0).otherwise(0.5).alias("confidence"), amount.alias("amount"), F.when(k % 43 != 0, "BRL").alias("currency"))


def _validated(f):
    concepts = f.spark.createDataFrame(CONCEPT_KINDS, "concept string, kind string")
    return writes.validated(_candidates(f), _references(f), _mentions(f), _facts(f), concepts, f.entity)


def _completeness(f):
    return f.owned("orders", "o_orderkey").select("user_id", F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderkey") % 12 == 0).alias("blocking"), F.lit("time").alias("question"))


@query_of_two_users
def candidate_validation(f):
    rows = _validated(f)
    return rows.groupBy(F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid").agg(F.count("*").alias("n"))


@query_of_two_users
def assessed_candidates(f):
    accepted, rejected = writes.assessed(_validated(f), _completeness(f))
    parts = [df.groupBy("user_id", "primitive").agg(F.count("*").alias("n")).withColumn("outcome", F.lit(o)) for df, o in ((accepted, "accepted"), (rejected, "rejected"))]
    return parts[0].unionByName(parts[1])


def _made(f):
    # validation joins all candidates, references, mentions and facts: run once, not once for each kind of row made of it
    accepted = checkpoint(writes.assessed(_validated(f), _completeness(f))[0].select(*writes.KEY, "primitive", "type_key", "action", "status", "monthday", "temporal"))
    bound, fresh, refused = writes.bound_entities(_mentions(f).join(accepted.select(*writes.KEY), writes.KEY, "left_semi"))
    taking_part = writes.participants(bound)
    made = writes.materialised_events(accepted, taking_part)
    return accepted, bound, fresh, refused, taking_part, made


@query_of_two_users
def materialised_events(f):
    made = _made(f)[-1]
    slot = lambda c: F.coalesce(F.when(F.col(c).startswith("p:"), F.col(c)), F.when(F.col(c).isNotNull(), "new"), F.lit("")).alias(c)
    return made.select("user_id", "candidate_id", "type_key", F.coalesce("action", F.lit("")).alias("action"), "status", slot("actor_id"), slot("subject_id"), "n_participants", F.coalesce("temporal.precision", F.lit("")).alias("precision"))


@query_of_two_users
def ingest_pipeline(f):
    """What one batch of candidates becomes: rows of each kind per user."""
    accepted, bound, fresh, refused, taking_part, made = _made(f)
    facts = writes.materialised_facts(made, _facts(f))
    parts = [("accepted", accepted), ("bound", bound), ("new_entities", fresh), ("refused_mentions", refused), ("participants", taking_part), ("events", made), ("facts", facts)]
    out = None
    for name, rows in parts:
        one = rows.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query_of_two_users
def materialised_measurements(f):
    k = F.col("event_id")
    bound = f.entity.where("entity_id like 'c:%'").select("user_id", F.lit(0).cast("long").alias("candidate_id"), F.col("name").alias("text"), "entity_id")
    subject = F.concat(F.lit("Customer#"), F.lpad((k % 100).cast("string"), 9, "0"))
    time = F.when(k % 3 == 0, T.at_instant(F.col("ts"))).when(k % 3 == 1, T.on_day(F.to_date("ts"))).otherwise(T.unknown_time(F.lit("once")))
    stated = f.table("events").select((k % 2 + 1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("candidate_id"), subject.alias("subject"), F.when(k % 5 == 0, F.concat(F.lit("Customer#"), F.lpad((k % 90).cast("string"), 9, "0"))).alias("context"), F.concat_ws("/", "event_type", k).alias("dimension"), F.when(k % 11 == 0, "much").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("number"), F.lit("kg").alias("unit"), F.lit(None).cast("string").alias("currency"), time.alias("temporal"), (k % 4 == 0).alias("with_event"))
    made, rejects = writes.materialised_measurements(stated, bound)
    one = made.select("user_id", F.lit("made").alias("outcome"), F.when(F.col("observed_at").isNotNull(), "observed").otherwise("").alias("why"))
    two = rejects.select("user_id", "outcome", F.col("error").alias("why"))
    return one.unionByName(two).groupBy("user_id", "outcome", "why").agg(F.count("*").alias("n"))


@query_of_two_users
def principals(f):
    users = f.spark.range(1, 6).select(F.col("id").alias("user_id"))
    bindings = f.spark.createDataFrame([(1, "c:1"), (2, "c:2"), (3, "c:3")], "user_id long, entity_id string")
    return writes.ensured_principals(users, bindings, f.entity).select("user_id", F.when(F.col("outcome") == "created", "new").otherwise(F.col("entity_id")).alias("entity_id"), "outcome")


@query
def self_mentions(f):
    k = F.col("o_orderkey")
    rows = f.table("orders").select((k % 2 + 1).cast("long").alias("user_id"), k.alias("mention_id"), _pick(k, ["Eu", "meu carro", "  Para   mim", "Maria", "MIM"]).alias("text"), F.when(k % 3 != 0, "contextual").otherwise("named").alias("reference_kind"))
    bindings = f.spark.createDataFrame([(1, "c:1")], "user_id long, entity_id string")
    return writes.resolved_selves(rows, bindings).groupBy("text", "reference_kind", "self_id").agg(F.count("*").alias("n"))


# Corrections ------------------------------------------------------------------------------------------------------------


@query_of_two_users
def fact_corrections(f):
    k = F.col("o_orderkey")
    said_ = f.table("orders").select((k % 2 + 1).cast("long").alias("user_id"), k.alias("correction_id"), F.when(k % 3 == 0, k * 2).alias("fact_id"), F.when(k % 3 == 1, k).alias("event_id"), F.lit("attribute.price").alias("concept"), F.lit("1.00").cast("decimal(18,2)").alias("amount"), F.lit("BRL").alias("currency"))
    made, rejects = writes.fact_corrections(said_, f.fact)
    one = made.select("user_id", "correction_id", text_of("about_id"), text_of("supersedes_id"), F.lit("").alias("error"))
    return one.unionByName(rejects.select("user_id", "correction_id", F.lit(None).cast("string").alias("about_id"), F.lit(None).cast("string").alias("supersedes_id"), "error")).select("user_id", "correction_id", F.coalesce("about_id", F.lit("")).alias("about_id"), F.coalesce("supersedes_id", F.lit("")).alias("supersedes_id"), "error")


@query_of_two_users
def correction_requests(f):
    k = F.col("o_orderkey")
    asked = f.table("orders").select((k % 2 + 1).cast("long").alias("user_id"), k.alias("request_id"), F.when(k % 5 == 0, "retract").otherwise("replace").alias("action"), F.lit("fact").alias("kind"), (F.floor(k / 3) * 6).alias("target_id"), F.when(k % 7 == 0, F.floor(k / 3) * 6).when(k % 11 == 0, -k).otherwise((F.floor(k / 3) + 1) * 6).alias("replacement_id"))
    ids = f.fact.select("user_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("id"))
    entries, rejects = writes.correction_entries(asked, ids, f.correction)
    one = entries.select("user_id", "request_id", F.lit("appended").alias("outcome"), F.coalesce(F.col("replacement_id").cast("string"), F.lit("")).alias("replacement_id"))
    return one.unionByName(rejects.select("user_id", "request_id", F.col("error").alias("outcome"), F.lit("").alias("replacement_id")))


@query_of_two_users
def correction_utterances(f):
    """Utterances of both users that would correct what they said of a customer, by the last digits of the name."""
    k = F.col("o_orderkey")
    number = F.col("o_custkey")
    rows = f.table("orders").select((k % 2 + 1).cast("long").alias("user_id"), k.alias("request_id"), said(k, GUARD_PARTS).alias("text"), (number % 2 == 0).alias("has_prior"), F.lit("retract").alias("action"), F.lit("fact").alias("kind"), F.lpad((number % 200).cast("string"), 4, "0").alias("part"), F.lit(None).cast("decimal(18,2)").alias("amount"), (number % 5).alias("scope"), F.lit(None).cast("long").alias("replacement_id"))
    key = F.split("entity_id", ":")[1].cast("long")
    candidates = f.entity.where("entity_id like 'c:%'").select("user_id", (key % 5).alias("scope"), (key * 2).alias("id"), "name", F.lit(None).cast("decimal(18,2)").alias("amount"), F.lit("fact").alias("kind"))
    ids = candidates.select("user_id", "kind", "id")
    ledger = f.correction.where("kind = 'fact'").select("user_id", "kind", "target_id")
    outcomes, entries = writes.correction_outcomes(rows, candidates, ids, ledger)
    counts = outcomes.groupBy("user_id", "outcome", "reason").agg(F.count("*").alias("n"))
    return counts.unionByName(entries.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit("entries").alias("outcome"), F.lit(None).cast("string").alias("reason"), "n"))
