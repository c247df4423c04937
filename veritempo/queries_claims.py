"""Queries of claims, envelopes, catalogues, clarification and query building."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from veritempo.operators import catalog, claims, events, ledger, ranges
from veritempo.registry import LOG_DAY, query, query_of_two_users, span, text_of
from veritempo.streaming import discourse

KINDS = ["entity", "attribute", "relation", "measurement", "classification", "intrinsic_property", "mood"]
ORIGINS = ["explicit", "explicit", "derived", "explicit", "assumed"]
SUBJECTS, OBJECTS = ["Maria", "o carro", None, "a sala"], ["Acme", "Recife", "Maria"]
PREDICATES = ["trabalha em", "mora em", "?!", "parent"]
DIMENSIONS = ["cor", "peso", "sabor", "nome", "temperatura, ontem"]
VALUES = ["azul", "10,5", None, "12"]
REPLIES = ['{"ir_kind": "ingest"}', '```json\n{"ir_kind": "semantic_proposal", "x": {"y": 1}}\n```', "no object here", "", '{"ir_kind": "other"}', '{"ir_kind": ', '{"a": 1} and {"b": 2}', 'text before {"ir_kind": "query"} after']
PERIODS = ["today", "yesterday", "this_week", "last_week", "this_month", "last_month", "now", "some_time"]


def _pick(key: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _claims(f):
    k = F.col("l_orderkey") + F.col("l_linenumber") * 3
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    rows = f.table("lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_linenumber").alias("n"), part.alias("p"), _pick(part, ORIGINS).alias("origin"), _pick(k, KINDS).alias("kind"), _pick(supplier, SUBJECTS).alias("subject"), _pick(part + supplier, OBJECTS).alias("object"), _pick(supplier, PREDICATES).alias("predicate"), _pick(part, DIMENSIONS).alias("dimension"), _pick(k, VALUES).alias("value"), supplier.alias("s"))
    return rows.withColumn("position", F.col("n") * 1_000_000 + F.col("p") * 10 + F.col("s") % 10).drop("n", "p", "s")


@query
def claim_overlay(f):
    return claims.overlaid(_claims(f)).groupBy("origin", "kind", "key", "status", "reason", "slot").agg(F.count("*").alias("n"))


@query
def claim_reports(f):
    k = F.col("o_orderkey")
    proposals = f.table("orders").select(k.alias("proposal_id"), (k % 4 == 0).alias("has_event"), (k % 3 == 0).alias("has_state"), F.when(k % 2 == 0, "correct").otherwise("chat").alias("intent"))
    return claims.claim_reports(claims.overlaid(_claims(f)), proposals)


@query
def identity_mentions(f):
    owned = f.table("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("proposal_id"), F.lit("meu gato").alias("text"))
    rows = claims.identity_mentions(_claims(f), owned)
    return rows.select("proposal_id", "text", "position")


@query
def identity_naming(f):
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    mentions = f.table("lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.when(n == 1, _pick(part, ["irmã", "gata", "Rex"])).otherwise(_pick(part, ["Ana", "Rex", "Mia"])).alias("text"), F.when(n == 1, "possessive").when(n == 2, "named").otherwise("contextual").alias("reference_kind"), F.when(part % 5 == 0, "person").otherwise("thing").alias("kind"), (F.col("l_orderkey") % 2 == 0).alias("naming"))
    return claims.folded_names(mentions)


@query
def envelope_dispatch(f):
    found = claims.dispatched(_pick(F.col("o_orderkey") + F.col("o_custkey"), REPLIES))
    return f.table("orders").select(found.alias("d")).groupBy("d.route", "d.failure").agg(F.count("*").alias("n"))


@query
def wire_mapping(f):
    k = F.col("o_orderkey")
    event = F.when(k % 3 == 0, F.format_string('"event": {"type": " Event.Order ", "action": "buy"%s}, ', F.when(k % 2 == 0, ', "status": "scheduled"').otherwise(""))).otherwise("")
    relation = F.when(k % 4 != 0, F.format_string('"relation": {"type": "%s", "subject": "c:%d", "object": "o:%d"%s}, ', _pick(k, ["relation.owns", "relation.child_of", "Relation.Employs"]), F.col("o_custkey"), k, F.when(k % 5 == 0, ', "mode": "terminate"').otherwise(""))).otherwise("")
    confidence = F.when(k % 7 == 0, '"confidence": "0.75", ').when(k % 7 == 1, '"confidence": "high", ').otherwise("")
    text = F.concat(F.lit('```\n{"ir_kind": "ingest", "ir": {'), event, relation, confidence, F.when(k % 6 == 0, '"intent": "record_event", ').otherwise(""), F.lit('"raw_input": "x"}}\n```'))
    w = claims.wired(text)
    return f.table("orders").select(k.alias("k"), w.alias("w")).select("k", *[F.coalesce(F.col(f"w.{c}"), F.lit("")).alias(c) for c in ("intent", "event_type", "status", "relation", "subject", "object", "mode")], "w.confidence")


@query
def ontology_view(f):
    return claims.ontology_view(f.concept).select("kind", "n", F.array_join("keys", " ").alias("keys"))


@query
def allowed_keys(f):
    keys = f.entity.select(F.when(F.col("entity_id").startswith("s:"), "event").otherwise("entity").alias("kind"), F.col("type_key").alias("key"))
    return claims.allowed(keys, f.concept).groupBy("kind", "key", "allowed").agg(F.count("*").alias("n"))


@query
def learned_concepts(f):
    stored = f.table("orders").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "relation.learned.").when(F.col("o_orderkey") % 3 == 1, "entity.learned.").otherwise("relation."), F.lower(F.col("o_orderstatus")), (F.col("o_custkey") % 5).cast("string")).alias("key"))
    known = f.spark.createDataFrame([("relation.learned.f1",), ("entity.learned.o2",)], "concept string")
    return claims.hydrated(stored, known)


@query
def event_preservation(f):
    k = F.col("o_orderkey")
    kept = claims.event_preserved(k % 2 == 0, k % 3 == 0, k % 5 == 0)
    false = claims.falsely_canonical(F.when(k % 3 == 0, _pick(k, ["event.intent", "event.order"])), F.when(k % 4 == 0, "event.intent").when(k % 4 == 1, "event.order"), F.when(k % 7 == 0, "action.buy"), F.when(k % 14 == 0, "action.buy"))
    return f.table("orders").groupBy(kept.alias("preserved"), false.alias("false_type")).agg(F.count("*").alias("n"))


@query
def observable_groups(f):
    rows = ledger.effective(f.measurement, "measurement_id", "measurement", f.correction)
    start, end = span(LOG_DAY)
    inside = F.coalesce((F.col("observed_at") >= start) & (F.col("observed_at") < end), F.lit(False))
    return claims.observable_groups(rows, ["user_id", "dimension"], inside).groupBy("user_id", "dimension", "taken_from").agg(F.count("*").alias("n_groups"), F.sum("support").alias("support"))


@query
def interpreter_metrics(f):
    k = F.col("event_id")
    calls = f.table("events").select("event_type", _pick(k, ["ok", "ok", "json", "ok", "wire", "canonical", "ok", "provider"]).alias("outcome"), F.floor(F.abs("value") * 10).alias("latency_ms"), (k % 100).alias("prompt_tokens"), (k % 7).alias("completion_tokens"))
    return claims.call_metrics(calls, ["event_type"])


@query
def owned_tie_break(f):
    k = F.col("c_custkey")
    mentions = f.table("customer").select(k.alias("mention_id"), k.alias("owner"), F.lit("entity.automobile").alias("hint"))
    things = f.table("orders").select(F.col("o_custkey").alias("owner"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.when(F.col("o_orderkey") % 5 == 0, "entity.automobile").otherwise("entity.thing").alias("type_key"), F.col("o_orderkey").alias("k"))
    recent = things.where("k % 15 = 0")
    last = things.where("k % 35 = 0").groupBy("owner", "type_key").agg(F.max("entity_id").alias("entity_id"))
    return claims.owned_tie_break(mentions, things.drop("k"), recent, last, create=True).select("mention_id", "status", F.coalesce("entity_id", F.lit("")).alias("entity_id"), F.coalesce("why", F.lit("")).alias("why"))


@query_of_two_users
def clarification_recovery(f):
    k = F.col("o_orderkey")
    pending = f.table("orders").select((k % 2 + 1).cast("long").alias("user_id"), k.alias("pending_id"), _pick(k, ["open", "open", "resolved", "open", "cancelled"]).alias("state"), _pick(k, ["entity_reference", "dimension", "value"]).alias("expects"), F.when(k % 4 == 0, "subject").when(k % 4 == 1, "dimension").otherwise("value").alias("slot"), (k % 3).alias("rounds"), F.when(k % 7 == 0, "peso").otherwise("12,5").alias("answered"))
    text = F.when(k % 3 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(k % 3 == 1, "peso").otherwise("12,5")
    answers = f.table("orders").select(F.when(k % 11 == 0, k % 2 + 5).otherwise(k % 2 + 1).cast("long").alias("user_id"), k.alias("pending_id"), text.alias("text"))
    return claims.recovered(pending, answers, f.entity).groupBy("user_id", "outcome").agg(F.count("*").alias("n"), F.max("filled").alias("last_filled"))


@query_of_two_users
def query_building(f):
    k = F.col("event_id")
    name = F.when(k % 4 != 0, F.concat(F.lit(" CUSTOMER#"), F.lpad((k % 300).cast("string"), 9, "0")))
    explicit = F.when(k % 5 == 0, F.col("ts"))
    asked = f.table("events").select((k % 2 + 1).cast("long").alias("user_id"), k.alias("request_id"), name.alias("name"), _pick(k, ["trabalha em", "child of", "gosta muito de"]).alias("predicate"), F.when(k % 3 != 0, _pick(k, PERIODS)).alias("period"), explicit.alias("explicit_start"), F.when(k % 10 == 0, F.col("ts") - F.expr("INTERVAL 1 HOUR")).otherwise(explicit + F.expr("INTERVAL 1 HOUR")).alias("explicit_end"), F.col("ts").alias("now"), F.when(k % 2 == 0, "-03:00").otherwise("+05:30").alias("zone"))
    rows = claims.built_queries(asked, f.entity)
    return rows.select("user_id", "request_id", "relation", "swapped", F.coalesce("entity_id", F.lit("")).alias("entity_id"), *[F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(c) for c in ("start", "end")], F.coalesce("error", F.lit("")).alias("error"))


@query
def event_items_matched(f):
    """Per actor the three earliest items, and how many there were before the limit."""
    items = events.event_items(f.event, f.participant.where("role = 'role.actor'")).join(f.event.select("event_id", "actor_id"), "event_id")
    rows = events.top_items(items.withColumn("late", F.coalesce("event_time", F.lit(""))), ["actor_id"], 3, by="late")
    counts = f.event.groupBy("actor_id").agg(F.count("*").alias("matched_count"))
    return rows.join(counts, "actor_id").select("actor_id", "position", "event_id", "matched_count")


@query
def assertion_listing(f):
    """States and attributes of a thing and measurements of a user, each numbered in the order of its repository."""
    state = f.state.select(F.lit("state").alias("kind"), "entity_id", F.col("state_id").alias("id"), F.row_number().over(Window.partitionBy("user_id", "entity_id").orderBy("observed_at", "state_id")).alias("position"))
    attribute = f.attribute.select(F.lit("attribute").alias("kind"), "entity_id", F.col("attribute_id").alias("id"), F.row_number().over(Window.partitionBy("user_id", "entity_id", "dimension").orderBy("attribute_id")).alias("position"))
    measured = f.measurement.select(F.lit("measurement").alias("kind"), F.col("user_id").cast("string").alias("entity_id"), F.col("measurement_id").alias("id"), F.row_number().over(Window.partitionBy("user_id", "dimension").orderBy(F.coalesce("observed_at", F.lit("1900-01-01").cast("timestamp")), "measurement_id")).alias("position"))
    rows = state.unionByName(attribute).unionByName(measured)
    return rows.select("kind", "entity_id", text_of("id"), "position")


@query
def concept_conflicts(f):
    """Registrations that would give a concept several parents."""
    new = f.table("part").select(F.concat(F.lit("entity.part."), F.lower("p_type")).alias("concept"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("entity.brand."), F.lower("p_brand"))).otherwise("entity.product").alias("parent"))
    return catalog.conflicting_concepts(f.concept.unionByName(new))


@query_of_two_users
def counts_in_many_ranges(f):
    """Every customer asks about a range of its own, from a day to some years, over all orders of its user."""
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1992-06-01").cast("date"), (k * 37 % 2000).cast("int"))
    days = F.element_at(F.array(*map(F.lit, [1, 7, 31, 365, 1000])), (k % 5 + 1).cast("int"))
    asked = f.owned("customer", "c_custkey").select("user_id", k.alias("request_id"), day.cast("timestamp").alias("start"), F.date_add(day, days).cast("timestamp").alias("end"))
    return ranges.counted(asked, f.event)


@query_of_two_users
def correction_chains(f):
    """Chains of replacements that end in an effective assertion or a retraction, go round, or branch."""
    k = F.col("o_orderkey")
    step = F.col("user_id")
    following = F.when(k % 50 == 43, k - 2 * step).otherwise(k + step)
    ends = k % 10 == 0
    rows = f.owned("orders", "o_orderkey").where(~ends | (k % 30 == 0)).select("user_id", F.lit("fact").alias("kind"), k.alias("target_id"), F.when(ends, "retract").otherwise("replace").alias("action"), F.when(~ends, following).alias("replacement_id"))
    twice = rows.where("target_id % 70 = 25").withColumns({"action": F.lit("retract"), "replacement_id": F.lit(None).cast("long")})
    return ledger.last_replacements(rows.unionByName(twice)).select("user_id", "target_id", "last_id", F.coalesce("steps", F.lit(-1)).alias("steps"), "outcome")


@query_of_two_users
def discourse_states(f):
    """Every conversation's focus, referents and pending question after all its turns, made of the log of each user's events."""
    k, kind = F.col("event_id"), F.col("event_type")
    one, two = F.concat(F.lit("e:"), (k % 7).cast("string")), F.concat(F.lit("e:"), (k % 5).cast("string"))
    turn_kind = F.when(k % 11 == 0, "pending").when(k % 13 == 0, "clarify").when(k % 2 == 0, "query").otherwise("write")
    ids = F.when(k % 4 == 3, F.array().cast("array<string>")).when(k % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    turns = f.owned("events", "event_id").select(
        "user_id", (k % 20).alias("conv_id"), k.alias("turn"), turn_kind.alias("kind"), (k % 5 != 1).alias("ok"), ids.alias("ids"), F.lit("attribute").alias("primitive"), F.lit(None).cast("string").alias("relation_type"), F.lit("value").alias("result_kind"),
        F.create_map(one, F.concat(F.lit("t:"), (k % 7).cast("string"))).alias("types"), (k % 6 == 1).alias("continues"), (k % 9 == 0).alias("attribute"), kind.alias("dimension"), F.array(F.lit("e:1"), two).alias("candidates"),
    )
    shown = F.array_join(F.transform("referents", lambda r: F.concat_ws("=", r["entity_id"], F.format_number(r["salience"], 3))), " ")
    return discourse.folded(turns).select("user_id", "conv_id", "turns", F.array_join("focus", " ").alias("focus"), F.coalesce("target_type", F.lit("")).alias("target_type"), shown.alias("referents"), F.coalesce("pending_dimension", F.lit("")).alias("pending"), "idle", F.coalesce("reason", F.lit("")).alias("reason"))
