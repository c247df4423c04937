"""The library's queries: one for each operator or group of operators, over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo import queries_claims, queries_concepts, queries_questions, queries_rules, queries_users, queries_writes  # noqa: F401  (they register their queries)
from veritempo.functions import temporal as T
from veritempo.functions import text as X
from veritempo.operators import attributes, catalog, events, ingest, interpret, ledger, linkage, measurements, proposals, relations, states
from veritempo.plans.spec import QuerySpec, execute
from veritempo.registry import DAY, LOG_DAY, MONTH, QUERIES, YEAR, query, span, stamp, text_of
from veritempo.sources import migrations
from veritempo.sources.frames import KnowledgeFrames

__all__ = ["QUERIES"]

# Events -----------------------------------------------------------------------------------------------------------


def _membership_counts(f: KnowledgeFrames, start, end) -> DataFrame:
    return events.with_membership(f.event, start, end).groupBy("type_key", "membership").agg(F.count("*").alias("n"))


@query
def event_membership_month(f):
    return _membership_counts(f, *span(MONTH))


@query
def event_membership_year(f):
    return _membership_counts(f, *span(YEAR))


@query
def event_membership_day(f):
    return _membership_counts(f, *span(DAY))


@query
def event_membership_instants(f):
    rows = f.table("events").select("user_id", T.at_instant(F.col("ts")).alias("temporal"))
    return events.with_membership(rows, *span(LOG_DAY)).groupBy("user_id", "membership").agg(F.count("*").alias("n"))


@query
def event_validity_month(f):
    role = T.role_of("state", "valid_from")
    return f.event.groupBy(T.membership(F.col("temporal"), *span(MONTH), role).alias("membership")).agg(F.count("*").alias("n"))


@query
def event_status_domain_filter(f):
    rows = events.matching(f.event, actions=["action.f", "action.o"], statuses=["completed", "scheduled"], domains=["domain.1", "domain.3"])
    return rows.select("event_id", "type_key", "action", "status")


@query
def event_hierarchy_exact(f):
    return events.of_type(f.event, f.concept, "event.order.1-urgent", descendants=False).select("event_id", "type_key")


@query
def event_hierarchy_descendants(f):
    return events.of_type(f.event, f.concept, "event.order").groupBy("type_key").agg(F.count("*").alias("n"))


@query
def concept_closure(f):
    return events.closure(f.concept)


def _wanted(f: KnowledgeFrames, prefix: str) -> DataFrame:
    return f.entity.where(F.col("entity_id").startswith(f"{prefix}:")).select("user_id", "entity_id")


@query
def event_list_subject(f):
    return events.by_subject(f.event, f.participant, _wanted(f, "p")).select("event_id", "status")


@query
def event_list_actor(f):
    return events.by_actor(f.event, f.participant, _wanted(f, "c")).select("event_id", "actor_id")


@query
def event_list_context_all(f):
    return events.in_context_of_all(f.event, f.participant, ["s:1", "s:2"]).select("event_id", "actor_id")


@query
def event_relation_endpoint(f):
    return events.by_neighbour(f.event, f.participant, f.relation.where("key = 'resides_at'"), F.broadcast(f.entity.where("entity_id in ('n:3', 'n:7')")).select("entity_id")).select("event_id", "actor_id")


@query
def event_items_top(f):
    items = events.event_items(f.event, f.participant.where("role = 'role.actor'"))
    rows = items.join(f.event.select("event_id", "actor_id"), "event_id")
    return events.top_items(rows, ["actor_id"], 3).select("actor_id", "position", "event_id", F.coalesce("event_time", F.lit("")).alias("event_time"))


@query
def event_items_sorted(f):
    items = events.event_items(f.event.select("user_id", "event_id", "temporal", "created_at"), f.participant)
    return events.sorted_items(items, descending=True).select("event_id", F.coalesce("event_time", F.lit("")).alias("event_time"), F.size("entity_ids").alias("n_entities"))


# Facts ------------------------------------------------------------------------------------------------------------


@query
def fact_current(f):
    return ledger.current_facts(f.fact).select("fact_id", "about_id", "amount", "currency")


@query
def fact_history(f):
    return ledger.history(f.fact).select("about_id", "fact_id", "version", "amount")


@query
def effective_assertions(f):
    return ledger.effective(f.fact, "fact_id", "fact", f.correction).groupBy("currency").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


@query
def effectiveness_status(f):
    rows = ledger.effectiveness(f.fact, "fact_id", "fact", f.correction, F.col("source_id") % 23 == 0)
    return rows.groupBy("effectiveness").agg(F.count("*").alias("n"))


@query
def correction_lineage(f):
    return ledger.explained(f.fact, "fact_id", "fact", f.correction).select("fact_id", "amount", "action", text_of("replacement_id"))


@query
def correction_errors(f):
    ids = f.fact.select("user_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("id")).where("id % 34 != 0").unionByName(f.measurement.select("user_id", F.lit("measurement").alias("kind"), F.col("measurement_id").alias("id")))
    return ledger.correction_errors(f.correction, ids).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def _sums(f: KnowledgeFrames, currency: str | None) -> DataFrame:
    return events.money_sum(events.with_membership(f.event, *span(YEAR)), f.fact, ["attribute.price"], ["actor_id"], currency)


@query
def sum_current_currency(f):
    return _sums(f, "BRL").select("actor_id", "total", "currency", "n_facts", "completeness", "n_unknown_events")


@query
def sum_multi_currency_flag(f):
    return _sums(f, None).select("actor_id", "total", "currency", "error")


@query
def sum_unknown_contributors(f):
    open_ = events.with_membership(f.event, *span(MONTH)).where(F.col("membership") == T.UNKNOWN)
    return events.with_facts(open_, f.fact, ["attribute.price"]).select("event_id", "fact_id", "amount", "currency")


@query
def count_with_unknown(f):
    return events.counts(events.with_membership(f.event, *span(MONTH)), ["actor_id"])


@query
def latest_event_value(f):
    rows = events.with_membership(f.event, *span(YEAR)).where(F.col("membership") != T.NO_MATCH)
    return events.latest(rows, ledger.current_facts(f.fact), ["user_id", "actor_id"]).drop("user_id")


# Attributes -------------------------------------------------------------------------------------------------------


@query
def attr_value_lookup(f):
    return attributes.value_lookup(f.attribute.where("dimension = 'brand'"), ["entity_id"])


@query
def attr_value_lookup_in_range(f):
    return attributes.value_lookup(f.attribute.where("dimension = 'size'"), ["entity_id"], stamp("2000-06-01"), stamp("2001-06-01"))


@query
def attr_snapshot(f):
    return attributes.value_lookup(f.attribute, ["entity_id", "dimension"]).where("status != 'unknown'")


@query
def attr_value_groups(f):
    return attributes.value_groups(f.attribute.where("dimension = 'size' and is_current"), ["entity_id"]).select("entity_id", "numeric_value", "support")


@query
def attr_history_previous(f):
    return attributes.previous_values(f.attribute, ["entity_id", "dimension"]).select("entity_id", "dimension", "attribute_id")


@query
def attr_history_first(f):
    return attributes.previous_values(f.attribute, ["dimension", "text_value"], first=True, limit=2).where("text_value is not null").select("dimension", "text_value", "position", "attribute_id")


@query
def attr_existence(f):
    hit = attributes.value_matches("number", number=F.lit(10).cast("decimal(18,2)"), unit="cm")
    return attributes.historical_existence(f.attribute.where("dimension = 'size'"), ["entity_id"], hit, stamp("2000-06-01"), stamp("2001-06-01")).select("entity_id", "answer")


@query
def attr_proposition(f):
    hit = attributes.value_matches("text", text="Brand#11")
    return attributes.proposition(f.attribute.where("dimension = 'brand'"), ["entity_id"], hit)


@query
def attr_composed_label(f):
    return attributes.composed_label(f.attribute, "brand", "type")


@query
def intrinsic_name(f):
    return attributes.intrinsic_names(f.entity)


# Measurements -----------------------------------------------------------------------------------------------------


def _measured(f: KnowledgeFrames) -> DataFrame:
    return ledger.effective(f.measurement, "measurement_id", "measurement", f.correction)


_SUBJECT = ["user_id", "dimension", "unit"]


@query
def meas_latest(f):
    return measurements.latest(_measured(f), ["user_id", "dimension"])


@query
def meas_latest_known(f):
    return measurements.latest(_measured(f).where("observed_at is not null"), ["user_id", "dimension"])


@query
def meas_at_time(f):
    return measurements.at_time(_measured(f), ["user_id", "dimension"], *span(LOG_DAY))


@query
def meas_in_range(f):
    return measurements.in_range(_measured(f), ["user_id", "dimension"], *span(LOG_DAY)).withColumns({c: text_of(c) for c in ("first_id", "last_id")})


@query
def meas_proposition(f):
    return measurements.value_proposition(_measured(f), ["user_id", "dimension"], F.lit("10.00").cast("decimal(18,2)"), F.lit("kg"), *span(LOG_DAY))


@query
def meas_incomparable_units(f):
    rows = _measured(f).withColumn("c", measurements.comparable(F.lit("10.00").cast("decimal(18,2)"), F.lit("g")))
    return rows.groupBy("dimension", "c").agg(F.count("*").alias("n"))


@query
def meas_value_groups(f):
    return measurements.value_groups(_measured(f), ["dimension"])


# States -----------------------------------------------------------------------------------------------------------


@query
def state_current(f):
    return states.current(f.state.where("dimension = 'openness'"), ["entity_id"]).withColumn("state_id", text_of("state_id"))


@query
def state_current_by_dimension(f):
    return states.current(f.state, ["dimension"], few=True).withColumn("state_id", text_of("state_id"))


@query
def state_completeness(f):
    return states.current(f.state, ["entity_id", "dimension"]).groupBy("entity_id").agg(states.worst("completeness").alias("completeness"))


@query
def state_scd2(f):
    rows = ledger.valid_periods(f.state.where("dimension = 'return'").drop("is_current"), ["entity_id"], "observed_at", "state_id")
    return rows.select("state_id", "entity_id", "value", F.col("valid_from").isNull().alias("no_start"), "valid_to", "is_current", text_of("supersedes_id"))


@query
def attribute_scd2(f):
    rows = f.measurement.where("observed_at is not null")
    out = ingest.closing_history(rows, ["user_id", "dimension"], "observed_at", "measurement_id", F.col("dimension").isin("click", "view"))
    return out.select("measurement_id", "valid_from", "valid_to", "is_current")


# Relations --------------------------------------------------------------------------------------------------------


@query
def relation_current_boolean(f):
    asked = f.table("customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("subject"))
    return relations.current_answer(asked, relations.by_key(f.relation, "buys_from"), ["subject"])


@query
def relation_list_ranked(f):
    return relations.ranked(relations.by_key(f.relation, "buys_from"), ["subject"]).select("subject", "object", "completeness")


@query
def relation_undated_ranked(f):
    return relations.ranked(relations.by_key(f.relation, "home_of"), ["subject"]).select("subject", "object", "completeness")


@query
def relation_historical(f):
    asked = f.entity.where("type_key = 'entity.supplier'").select(F.col("entity_id").alias("subject"))
    return relations.historical_existence(asked, relations.by_key(f.relation, "sells_to").where("not is_current"), ["subject"])


@query
def relation_termination(f):
    return relations.termination(relations.by_key(f.relation, "buys_from"), ["subject"])


@query
def relation_held_during(f):
    return relations.held_during(relations.by_key(f.relation, "buys_from"), ["subject", "object"], stamp("1997-01-01"), stamp("1997-07-01"))


@query
def relation_symmetric(f):
    return relations.by_key(f.relation, "peer_of").select("subject", "object", "is_current")


@query
def relation_canonical(f):
    return relations.canonical_ends(f.relation.where("key = 'peer_of'")).select("from_id", "to_id")


@query
def relation_inverse(f):
    return relations.by_key(f.relation, "contains").select("subject", "object")


@query
def relation_object_type(f):
    rows = relations.of_object_type(f.relation, f.entity, ["entity.nation", "entity.region"])
    return relations.labelled(rows, f.entity).select("relation_id", "object_name")


@query
def owned_entities(f):
    return relations.owned(f.relation, f.entity, f.concept, "buys_from", "entity.party").select("owner", "entity_id")


@query
def graph_walk_2hop(f):
    seeds = f.entity.where("type_key = 'entity.region'").select("user_id", F.col("entity_id").alias("seed"))
    return relations.walk(seeds, f.relation.where("key in ('resides_at', 'located_in')"), 2, most=None).drop("user_id")


@query
def graph_walk_bounded(f):
    seeds = f.entity.where("type_key = 'entity.region'").select("user_id", F.col("entity_id").alias("seed"))
    return relations.walk(seeds, f.relation.where("key in ('resides_at', 'located_in')"), 2, most=40).drop("user_id")


@query
def entity_detail(f):
    return relations.entity_detail(f.entity, f.relation, f.attribute, f.state, f.participant).drop("user_id")


@query
def relation_lifecycle(f):
    rows = f.table("events").select((F.col("user_id") % 100).alias("subject"), F.col("event_type").alias("object"), F.col("ts").alias("at"), F.col("event_id").alias("command_id"), F.when(F.col("event_id") % 11 == 0, "terminate").when(F.col("event_id") % 13 == 0, "deny").when(F.col("event_id") % 17 == 0, "historical").otherwise("assert").alias("mode"))
    return ingest.relation_life(rows, ["subject", "object"])


# Linkage ----------------------------------------------------------------------------------------------------------


@query
def entity_search(f):
    return linkage.search(f.entity, "00001")


@query
def entity_search_ranks(f):
    return f.entity.withColumn("rank", linkage.search_rank(F.lit("ar")).cast("string")).groupBy("rank").agg(F.count("*").alias("n"))


def _mentions(f: KnowledgeFrames) -> DataFrame:
    return f.table("orders").select(F.col("o_orderkey").alias("mention_id"), F.concat(F.lit("  Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" !")).alias("text"), F.lit("entity.party").alias("hint"))


@query
def entity_resolution_named(f):
    return linkage.resolve_named(_mentions(f).withColumn("user_id", F.lit(1).cast("long")), f.entity, f.concept).drop("user_id")


@query
def entity_resolution_names_shared(f):
    mentions = f.owned("part", "p_partkey").select("user_id", F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("text"), F.lit("entity.product").alias("hint"))
    return linkage.resolve_named(mentions, f.entity, f.concept).drop("user_id")


@query
def entity_resolution_possessive(f):
    mentions = f.owned("customer", "c_custkey").select("user_id", F.col("c_custkey").alias("mention_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("owner"))
    return linkage.resolve_possessive(mentions, relations.owned(f.relation, f.entity, f.concept, "resides_at", "entity.place"), create=True).drop("user_id")


@query
def recent_referents(f):
    recent = f.table("events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("position"), F.col("event_type").alias("entity_id"))
    return linkage.most_recent(recent.select("conv_id").distinct(), recent).select("conv_id", "entity_id", "recency")


# Ingest -----------------------------------------------------------------------------------------------------------


@query
def integrity_violations(f):
    duplicates = f.fact.groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1")
    orphans = ingest.missing_references(f.participant.where("role = 'role.context'"), "entity_id", f.entity.where("entity_id not in ('s:1', 's:3')"), "entity_id")
    return ingest.violations([("duplicate_fact", duplicates, "fact_id"), ("branched_fact", ledger.branched(f.fact), "supersedes_id"), ("missing_context", orphans, "event_id")]).groupBy("check").agg(F.count("*").alias("n"))


def _requirements(f: KnowledgeFrames) -> DataFrame:
    rows = [("event.any", "time", "essential", 2, True), ("event.any", "actor", "essential", 1, True), ("event.order", "action", "useful", 3, True), ("event.order", "time", "useful", 5, False)]
    return f.spark.createDataFrame(rows, "type_key string, slot string, importance string, priority int, ask boolean")


@query
def completeness_clarification(f):
    merged = ingest.merged_requirements(_requirements(f), events.closure(f.concept))
    rows = f.event.withColumn("candidate_id", F.col("event_id"))
    slots = {"time": T.sort_instant(F.col("temporal")).isNotNull(), "actor": F.col("event_id") % 9 != 0, "action": F.col("action").isNotNull()}
    found = ingest.completeness(rows, merged, slots)
    return found.groupBy(F.array_join("missing", ",").alias("missing"), "blocking", "question").agg(F.count("*").alias("n"))


@query
def claim_tally(f):
    claims = f.table("lineitem").select(F.col("l_orderkey").alias("request_id"), F.when(F.col("l_linenumber") % 4 == 0, "deferred").when(F.col("l_returnflag") == "R", "rejected").otherwise("committed").alias("status"))
    return ingest.claim_tally(claims)


@query
def idempotency_claims(f):
    rows = f.table("events").select("user_id", F.col("event_id").alias("request_id"), F.sha2(F.concat_ws("|", F.col("event_type"), F.col("props")), 256).alias("fingerprint"))
    held = rows.where("request_id % 3 = 0").select("user_id", "request_id", F.when(F.col("request_id") % 2 == 0, F.col("fingerprint")).otherwise("other").alias("fingerprint"), F.when(F.col("request_id") % 4 == 0, "done").when(F.col("request_id") % 5 == 0, "running").otherwise("failed").alias("state"))
    return ingest.idempotency(rows, held).groupBy("result").agg(F.count("*").alias("n"))


@query
def last_message_preview(f):
    rows = f.table("conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return rows.select("conv_id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 80).alias("preview"))


# Interpretation and text ------------------------------------------------------------------------------------------


@query
def alias_match(f):
    aliases = f.spark.createDataFrame([("the", "concept.the", 1), ("and the", "concept.and_the", 1), ("of", "concept.of", 2), ("der", "concept.der", 3), ("le", "concept.le", 3)], "alias string, concept string, priority int")
    texts = f.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("text_id"), "text")
    return interpret.alias_matches(texts, aliases)


@query
def normalize_lexical(f):
    return f.table("conversations").select("conv_id", "turn", X.normalize(F.col("text")).alias("normal"))


@query
def slug_key(f):
    return f.table("part").select("p_partkey", X.slug(F.concat_ws(" ", "p_size", "p_name")).alias("slug"), X.slug(F.col("p_type")).alias("type_slug"))


@query
def number_formats(f):
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return f.table("orders").select("o_orderkey", X.format_number(amount).alias("number"), X.format_money(amount, F.when(F.col("o_orderkey") % 7 == 0, "USD").otherwise("BRL")).alias("money"))


@query
def quantity_extraction(f):
    said = F.concat(F.lit("pesa "), F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.when(F.col("event_id") % 3 == 0, " kg").when(F.col("event_id") % 3 == 1, "km").otherwise(" nada"))
    return f.table("events").select("event_id", X.quantity_of(said).alias("q")).select("event_id", F.col("q.number").cast("decimal(18,2)").alias("number"), "q.unit")


@query
def idempotency_fingerprint(f):
    return f.table("events").select("event_id", X.fingerprint("user_id", "event_type").alias("fingerprint"))


@query
def value_codec(f):
    k = F.col("event_id")
    raw = F.when(k % 6 == 0, F.col("props")).when(k % 6 == 1, k.cast("string")).when(k % 6 == 2, F.col("value").cast("decimal(18,2)").cast("string")).when(k % 6 == 3, F.when(k % 2 == 0, "true").otherwise("False")).when(k % 6 == 4, F.concat(F.lit('{"amount": "'), k.cast("string"), F.lit('", "currency": "BRL"}'))).otherwise(F.col("event_type"))
    return f.table("events").select("event_id", X.encode_value(raw).alias("v")).select("event_id", "v.kind", "v.value")


@query
def id_validation(f):
    rows = f.entity.select(F.col("entity_id").rlike(X.ID_PATTERN).alias("id_ok"), F.col("type_key").rlike(X.CONCEPT_PATTERN).alias("type_ok"))
    return rows.groupBy("id_ok", "type_ok").agg(F.count("*").alias("n"))


@query
def closed_vocabulary(f):
    word = X.coerce_closed(F.col("o_orderpriority"), ["high", "medium", "low"], {"1-urgent": "high", "2-high": "high", "3-medium": "medium", "5-low": "low"}, "other")
    return f.table("orders").groupBy(word.alias("word")).agg(F.count("*").alias("n"))


@query
def relative_periods(f):
    now = dt.datetime(2024, 1, 17, 2, 30, tzinfo=dt.UTC)
    spans = {n: T.relative_period(n, now, "America/Fortaleza") for n in ("today", "yesterday", "this_week", "last_week", "this_month", "last_month")}
    hits = [F.count_if((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).alias(n) for n, (a, b) in spans.items()]
    return f.table("events").groupBy("user_id").agg(*hits)


@query
def weekday_shift(f):
    day = F.to_date("o_orderdate")
    shifts = {p: T.weekday_shift(day, F.lit(2), p) for p in ("next", "previous", "next_strict", "previous_strict")}
    return f.table("orders").select("o_orderkey", *[c.cast("string").alias(p) for p, c in shifts.items()])


@query
def time_conflicts(f):
    day = F.to_date("o_orderdate")
    other = F.when(F.col("o_orderkey") % 5 == 0, F.date_add(day, 1))
    why = T.time_conflict([day, other], F.col("o_orderdate"), day, F.when(F.col("o_orderkey") % 3 == 0, 2), F.lit("UTC"))
    return f.table("orders").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query
def spec_sum(f):
    spec = QuerySpec(primitive="fact", fact_concepts=["attribute.price"], aggregate="sum", currency="BRL", start=dt.datetime(1996, 1, 1), end=dt.datetime(1997, 1, 1))
    return execute(spec, f)


@query
def spec_snapshot(f):
    return execute(QuerySpec(mode="snapshot"), f).drop("user_id")


# Registry, focus and readiness ------------------------------------------------------------------------------------


@query
def newest_binding(f):
    rows = f.table("events").select("user_id", "ts", "event_id", "event_type")
    return catalog.newest(rows, ["user_id"], "ts", "event_id")


@query
def relation_instance_newest(f):
    rows = f.table("orders").join(f.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey", F.col("o_orderdate").alias("observed_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("instance"))
    return catalog.newest(rows, ["o_custkey", "l_suppkey"], "observed_at", "instance")


@query
def participant_backfill(f):
    key = F.col("o_orderkey")
    rows = f.table("orders").select("o_orderkey", F.when(key % 3 != 0, F.concat(F.lit("c:"), F.col("o_custkey").cast("string"))).alias("actor_id"), F.when(key % 4 == 0, F.lit("p:1")).alias("subject_id"))
    frames, _ = migrations.upgrade({"event": rows}, 6, [(6, 7, migrations.add_participants)], 7)
    return frames["event"].select("o_orderkey", F.explode("participants").alias("p")).select("o_orderkey", "p.entity_id", "p.role")


@query
def catalogue_counts(f):
    return catalog.catalogue_counts(f.concept)


@query
def concepts_to_learn(f):
    keys = f.table("part").select(F.concat(F.lit("entity.part."), F.lower("p_brand")).alias("concept")).unionByName(f.entity.select(F.col("type_key").alias("concept")))
    return catalog.unknown_keys(keys, f.concept)


@query
def correction_target(f):
    said = f.table("supplier").select(F.col("s_suppkey").alias("description_id"), F.col("s_nationkey").alias("scope"), F.concat(F.lit("0000"), (F.col("s_suppkey") % 10).cast("string")).alias("part"), F.lit(None).cast("decimal(18,2)").alias("amount"))
    candidates = f.table("customer").select(F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(18,2)").alias("amount"))
    return catalog.correction_targets(said, candidates, f.correction.where("kind = 'fact'").drop("user_id")).withColumn("target_id", text_of("target_id"))


@query
def inferred_ownership(f):
    said = f.owned("orders", "o_orderkey").select("user_id", F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("owner"), F.concat(F.lit("s:"), (F.col("o_orderkey") % 10 + 1).cast("string")).alias("entity_id"))
    return catalog.inferred_ownership(said, f.relation, "buys_from").drop("user_id")


@query
def referent_salience(f):
    rows = f.table("conversations").select("conv_id", F.col("turn").alias("position"), F.concat(F.col("role"), (F.col("turn") % 3).cast("string")).alias("entity_id"))
    return catalog.salience(rows, ["conv_id"], "position")


@query
def proposal_readiness(f):
    key = F.col("l_orderkey") + F.col("l_linenumber")
    primitive = F.element_at(F.array(*map(F.lit, ["event", "relation", "attribute", "measurement", "state", "other"])), (key % 6 + 1).cast("int"))
    present = {"type": key % 5 != 0, "time": key % 7 != 0, "subject": F.col("l_partkey") % 3 != 0, "object": F.col("l_suppkey") % 2 == 0, "key": F.lit(True), "dimension": key % 4 != 0, "value": F.col("l_linenumber") % 3 != 0}
    rows = f.table("lineitem").select(F.col("l_orderkey").alias("proposal_id"), catalog.missing_slots(primitive, present).alias("missing"))
    return catalog.readiness(rows)


@query
def answer_projection(f):
    rows = attributes.value_lookup(f.attribute, ["entity_id", "dimension"])
    shown = interpret.projected(F.col("status"), F.col("value"), F.array_repeat(F.lit("v"), F.col("n_values").cast("int")))
    return rows.select(shown.alias("p")).groupBy("p.status", "p.kind").agg(F.count("*").alias("n"))


# Proposals --------------------------------------------------------------------------------------------------------


def _proposal_mentions(f: KnowledgeFrames) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    return f.table("lineitem").select(
        F.col("l_orderkey").alias("proposal_id"),
        (F.col("l_orderkey") * 10 + n).alias("mention_id"),
        F.concat(F.lit("Place "), (part % 3).cast("string")).alias("text"),
        F.when(n == 1, "subject").when(n == 2, "object").otherwise("other").alias("slot"),
        F.when(part % 3 == 0, "person").when(part % 3 == 1, "place").otherwise("thing").alias("kind"),
        F.when(part % 7 == 0, "actor").when(part % 5 == 0, "object").otherwise("none").alias("hint"),
        (F.col("l_orderkey") % 2 == 0).alias("change"),
        (F.col("l_orderkey") % 3 == 0).alias("intransitive"),
        F.when(part % 4 == 0, F.concat(F.lit("class"), (part % 8).cast("string"))).alias("class_hint"),
    )


@query
def event_roles(f):
    return proposals.event_roles(_proposal_mentions(f))


@query
def propagated_hints(f):
    return proposals.propagated_hints(_proposal_mentions(f))


@query
def type_evidence(f):
    rows = f.entity.select(F.col("entity_id").alias("mention_id"), "entity_id", "type_key", F.when(F.col("entity_id").startswith("c:"), "entity.party").when(F.col("entity_id").startswith("n:"), "entity.nation").otherwise("entity.place").alias("hint"))
    return proposals.type_evidence(rows, f.concept)


@query
def entity_resolution_contextual(f):
    recent = f.table("events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("position"), F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("entity_id"), F.concat(F.lit("event."), F.col("event_type")).alias("type_key"))
    asked = f.table("events").select(F.col("user_id").alias("conv_id"), F.col("user_id").alias("mention_id"), F.when(F.col("user_id") % 2 == 0, "event.click").otherwise("event.any").alias("hint")).distinct()
    return proposals.resolve_contextual(asked, recent, f.concept)
