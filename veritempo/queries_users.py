"""Queries over two users whose ids collide, per-entity lists, and every branch of the typed query."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from veritempo.operators import catalog, claims, events, ingest, ledger, linkage, proposals, relations, scope
from veritempo.plans.spec import QuerySpec, execute
from veritempo.registry import YEAR, query, query_of_two_users, span, text_of

# Isolation --------------------------------------------------------------------------------------------------------


@query_of_two_users
def isolated_effective(f):
    return ledger.effective(f.fact, "fact_id", "fact", f.correction).groupBy("user_id", "currency").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query_of_two_users
def isolated_current_facts(f):
    return ledger.current_facts(f.fact).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query_of_two_users
def isolated_sums(f):
    rows = events.money_sum(events.with_membership(f.event, *span(YEAR)), f.fact, ["attribute.price"], ["user_id", "actor_id"], "BRL")
    return rows.select("user_id", "actor_id", "total", "n_facts", "n_unknown_events")


@query_of_two_users
def isolated_event_list(f):
    """Only the second user asks, for all its parts."""
    wanted = f.entity.where("user_id = 2 and entity_id like 'p:%'").select("user_id", "entity_id")
    return events.by_subject(f.event, f.participant, wanted).select("user_id", "event_id")


@query_of_two_users
def isolated_context(f):
    return events.in_context_of_all(f.event, f.participant, ["s:1", "s:2"]).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query_of_two_users
def isolated_walk(f):
    seeds = f.entity.where("type_key = 'entity.region'").select("user_id", F.col("entity_id").alias("seed"))
    found = relations.walk(seeds, f.relation.where("key in ('resides_at', 'located_in')"), 2, most=None)
    return found.groupBy("user_id", "seed", "depth").agg(F.count("*").alias("n"))


@query_of_two_users
def isolated_resolution(f):
    """Both users mention all customers, but the second one has only those with even keys."""
    users = F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    mentions = f.table("customer").select(users.alias("user_id"), F.col("c_custkey").alias("mention_id"), F.col("c_name").alias("text"))
    return linkage.resolve_named(mentions, f.entity).groupBy("user_id", "status").agg(F.count("*").alias("n"), F.max("entity_id").alias("last"))


@query_of_two_users
def isolated_correction_errors(f):
    """The first user's corrections, as if the second one had written them: what that user hasn't got is missing."""
    ids = f.fact.select("user_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("id"))
    said = f.correction.where("kind = 'fact' and user_id = 1").withColumn("user_id", F.lit(2).cast("long"))
    return ledger.correction_errors(said, ids).groupBy("user_id", "kind", "reason").agg(F.count("*").alias("n"))


@query_of_two_users
def visible_ids(f):
    key = F.col("o_orderkey")
    asked = f.table("orders").select(
        (key % 3 % 2 + 1).alias("user_id"),
        key.alias("request_id"),
        F.when(key % 5 == 0, "relation").otherwise("event").alias("primitive"),
        F.when(key % 4 != 0, "actor").alias("association"),
        F.when(key % 7 == 0, F.array(F.lit("action.f"))).otherwise(F.array().cast("array<string>")).alias("actions"),
        F.concat(F.array(F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))), F.when(key % 2 == 0, F.array(F.lit("r:2"))).otherwise(F.array().cast("array<string>"))).alias("entity_ids"),
        F.array(key).alias("event_ids"),
    )
    return scope.visibility(asked, f.entity, f.event)


@query_of_two_users
def user_facts_with_sources(f):
    """Facts of the second user, without those whose source only the other one has."""
    sources = f.fact.select("user_id", "source_id").distinct().where("user_id = 1 or source_id < 50")
    rows = scope.with_own_sources(f.fact, sources)
    return scope.snapshot(rows, 2).groupBy("currency").agg(F.count("*").alias("n"), F.max("source_id").alias("last_source"))


# Lists of one entity or fact ---------------------------------------------------------------------------------------


@query
def fact_items(f):
    rows = ledger.fact_items(f.fact, f.event)
    return rows.select("fact_id", "event_id", F.coalesce("event_time", F.lit("")).alias("event_time"), "amount", "currency", "source_id", text_of("supersedes_id"), "is_current")


@query
def relations_for_entity(f):
    wanted = f.entity.where("type_key in ('entity.nation', 'entity.region')").select("user_id", "entity_id")
    rows = relations.of_entity(f.relation.where("key in ('resides_at', 'located_in')"), wanted)
    return rows.select("entity_id", "position", "relation_id", "is_current")


@query
def entity_card(f):
    wanted = f.entity.where("type_key in ('entity.nation', 'entity.region') or entity_id like 'p:%'").select("entity_id")
    rows = relations.entity_card(f.entity, f.relation.where("key != 'buys_from'"), f.attribute, f.state, wanted)
    return rows.select("entity_id", "name", "list", "item", "n")


@query
def raw_input_sink(f):
    """Requests that come twice or are known already are rejected."""
    rows = f.table("events").select("user_id", (F.col("event_id") % 700).alias("raw_id"), F.col("props").alias("text"))
    held = rows.where("raw_id % 10 = 3").select("user_id", "raw_id").distinct()
    kept, rejected = ingest.insert_once(held, rows, "raw_id")
    counts = [df.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("raw_id").alias("n_ids")).withColumn("outcome", F.lit(o)) for df, o in ((kept, "inserted"), (rejected, "rejected"))]
    return counts[0].unionByName(counts[1])


@query
def concept_kind_guard(f):
    kinds = f.concept.select("concept", F.substring_index("concept", ".", 1).alias("kind"))
    rows = f.entity.select(F.col("type_key").alias("key"), F.when(F.col("entity_id").startswith("s:"), "event").otherwise("entity").alias("expected"))
    more = f.table("part").select(F.concat(F.lit("entity.part."), F.lower("p_brand")).alias("key"), F.lit("entity").alias("expected"))
    return scope.wrong_kind(rows.unionByName(more), kinds).groupBy("key", "expected", "error").agg(F.count("*").alias("n"))


# The typed query ---------------------------------------------------------------------------------------------------


@query_of_two_users
def spec_relation_boolean(f):
    return execute(QuerySpec(primitive="relation", relation_key="resides_at", mode="boolean", user_id=2), f).select("subject", "answer", "n")


@query_of_two_users
def spec_relation_historical(f):
    return execute(QuerySpec(primitive="relation", relation_key="sells_to", mode="historical", user_id=2), f).select("subject", "answer")


@query
def spec_relation_termination(f):
    return execute(QuerySpec(primitive="relation", relation_key="buys_from", mode="termination"), f).select("subject", "answer", "terminated")


@query
def spec_relation_held_during(f):
    spec = QuerySpec(primitive="relation", relation_key="buys_from", mode="held_during", start=dt.datetime(1997, 1, 1), end=dt.datetime(1997, 7, 1))
    return execute(spec, f).select("subject", "object", "answer")


@query
def spec_relation_object_type(f):
    spec = QuerySpec(primitive="relation", relation_key="located_in", object_types=["entity.region"])
    return execute(spec, f).select("subject", "object", "completeness")


@query
def spec_attribute_existence(f):
    spec = QuerySpec(primitive="attribute", dimension="size", mode="existence", number_value="10", unit="cm", start=dt.datetime(2000, 6, 1), end=dt.datetime(2001, 6, 1))
    return execute(spec, f).select("entity_id", "answer")


@query_of_two_users
def spec_attribute_proposition(f):
    return execute(QuerySpec(primitive="attribute", dimension="brand", mode="proposition", text_value="Brand#11", user_id=2), f).select("entity_id", "answer")


@query
def spec_attribute_history(f):
    return execute(QuerySpec(primitive="attribute", dimension="brand", mode="history", descending=True), f).select("entity_id", "attribute_id")


@query
def spec_measurement_proposition(f):
    spec = QuerySpec(primitive="measurement", dimension="click", mode="proposition", number_value="10.00", unit="kg", start=dt.datetime(2024, 1, 10), end=dt.datetime(2024, 1, 11))
    return execute(spec, f)


@query
def spec_measurement_latest(f):
    return execute(QuerySpec(primitive="measurement", dimension="click", mode="latest"), f)


@query_of_two_users
def spec_event_count(f):
    return execute(QuerySpec(aggregate="count", statuses=["completed"], start=dt.datetime(1996, 1, 1), end=dt.datetime(1997, 1, 1)), f)


@query_of_two_users
def spec_event_list(f):
    rows = execute(QuerySpec(event_types=["event.order"], include_descendants=True, entity_ids=["c:2", "c:4"], association="actor", user_id=2, descending=True), f)
    return rows.select("event_id", F.coalesce("event_time", F.lit("")).alias("event_time"))


@query_of_two_users
def spec_effective_sum(f):
    spec = QuerySpec(primitive="fact", fact_concepts=["attribute.price"], aggregate="sum", currency="BRL", start=dt.datetime(1996, 1, 1), end=dt.datetime(1997, 1, 1))
    return execute(spec, f).select("user_id", "total", "n_facts", "n_unknown_events")


@query
def spec_state(f):
    return execute(QuerySpec(primitive="state", dimension="openness"), f).select("entity_id", text_of("state_id"), "completeness")


@query_of_two_users
def spec_event_lists(f):
    """The five latest orders of every user, and how many there are."""
    rows = execute(QuerySpec(statuses=["completed"], start=dt.datetime(1996, 1, 1), end=dt.datetime(1997, 1, 1), descending=True, limit=5), f)
    return rows.select("user_id", "position", "event_id", "matched_count")


@query_of_two_users
def spec_event_objects(f):
    rows = execute(QuerySpec(entity_ids=["p:2", "p:3", "p:4"], association="object", limit=50), f)
    return rows.select("user_id", "position", "event_id", "matched_count")


@query_of_two_users
def spec_event_neighbours(f):
    """Events of what a relation ties to two nations, by user."""
    rows = execute(QuerySpec(entity_ids=["n:2", "n:4"], association="relation_endpoint", limit=7), f)
    return rows.select("user_id", "position", "event_id", "matched_count")


@query_of_two_users
def spec_relation_asked(f):
    """What has no such relation is answered too, for whoever has it; what only the first user has is none of the second one's."""
    asked = [("resides_at", "boolean", ["c:7"]), ("resides_at", "boolean", ["c:14"]), ("resides_at", "boolean", ["p:2"]), ("resides_at", "boolean", ["p:3"]), ("sells_to", "historical", ["n:4"]), ("buys_from", "termination", ["r:2"])]
    rows = [execute(QuerySpec(primitive="relation", relation_key=key, mode=mode, entity_ids=ids), f).select("user_id", F.lit(mode).alias("mode"), "subject", "answer") for key, mode, ids in asked]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query_of_two_users
def spec_relation_of_objects(f):
    """By the other end: who resides where, asked about the place."""
    rows = execute(QuerySpec(primitive="relation", relation_key="resides_at", mode="boolean", entity_ids=["n:2"], association="relation_object"), f)
    return rows.select("user_id", "object", "answer", "n")


@query_of_two_users
def spec_relation_pair_of_type(f):
    """A pair whose object has another type than asked for is no hit."""
    specs = [QuerySpec(primitive="relation", relation_key="located_in", mode="boolean", entity_ids=["n:2", f"r:{r}"], object_types=[kind]) for r in range(5) for kind in ("entity.region", "entity.nation")]
    rows = [execute(s, f).select("user_id", F.lit(s.entity_ids[1]).alias("object"), F.lit(s.object_types[0]).alias("kind"), "answer") for s in specs]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query_of_two_users
def isolated_possessive(f):
    """Both users' customers say "mine" under the same mention ids; the second user has fewer places."""
    mentions = f.owned("customer", "c_custkey").select("user_id", (F.col("c_custkey") % 50).alias("mention_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("owner")).where("mention_id < 20")
    rows = linkage.resolve_possessive(mentions, relations.owned(f.relation, f.entity, f.concept, "resides_at", "entity.place"))
    return rows.groupBy("user_id", "mention_id", "status").agg(F.count("*").alias("n"), F.max("entity_id").alias("last"))


@query_of_two_users
def isolated_contextual(f):
    """Conversations of two users bear the same numbers."""
    key = F.col("event_id")
    recent = f.owned("events", "event_id").select("user_id", (key % 40).alias("conv_id"), key.alias("position"), F.concat(F.lit("e:"), key.cast("string")).alias("entity_id"), F.concat(F.lit("event."), F.col("event_type")).alias("type_key"))
    asked = recent.select("user_id", "conv_id").distinct().withColumns({"mention_id": F.col("conv_id"), "hint": F.when(F.col("conv_id") % 2 == 0, "event.click").otherwise("event.any")})
    return proposals.resolve_contextual(asked, recent, f.concept)


@query_of_two_users
def isolated_referents(f):
    recent = f.owned("events", "event_id").select("user_id", (F.col("event_id") % 40).alias("conv_id"), F.col("event_id").alias("position"), F.col("event_type").alias("entity_id"))
    return linkage.most_recent(recent.select("user_id", "conv_id").distinct(), recent).select("user_id", "conv_id", "entity_id", "recency")


@query_of_two_users
def isolated_ownership(f):
    """What one user's relations hold doesn't keep the other one's mentions from implying it."""
    key = F.col("c_custkey")
    owner, place = F.concat(F.lit("c:"), key.cast("string")), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string"))
    said = f.table("customer").select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("user_id"), owner.alias("owner"), place.alias("entity_id"))
    return catalog.inferred_ownership(said, f.relation, "resides_at").groupBy("user_id").agg(F.count("*").alias("n"), F.max("owner").alias("last"))


@query_of_two_users
def isolated_recovery(f):
    """Both users have pending operations under the same ids; those of the second one are resolved."""
    k = F.col("o_orderkey")
    pending = f.owned("orders", "o_orderkey").select("user_id", k.alias("pending_id"), F.when(F.col("user_id") == 2, "resolved").otherwise("open").alias("state"), F.lit("value").alias("expects"), F.lit("value").alias("slot"), F.lit(0).alias("rounds"), F.lit("7").alias("answered"))
    answers = f.table("orders").select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("user_id"), k.alias("pending_id"), F.when(k % 3 == 0, "7").when(k % 3 == 1, "12,5").otherwise("?").alias("text"))
    return claims.recovered(pending, answers, f.entity).groupBy("user_id", "outcome").agg(F.count("*").alias("n"), F.max("filled").alias("last_filled"))
