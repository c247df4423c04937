"""Atomic claims of proposals: what each becomes, which mentions are entities, and the envelopes they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions import vocabulary as V
from veritempo.functions.text import decimal_of, fold, json_object_of, objects_in
from veritempo.operators.scope import by_user

#: Kinds of claims whose subject alone is an entity; of relations both ends are.
SUBJECT_ONLY = ("attribute", "intrinsic_property", "measurement", "state", "classification", "event")
#: The parts of an ingest envelope, by the key of each.
WIRE = "struct<ir_kind:string,ir:struct<intent:string,raw_input:string,event:struct<type:string,action:string,status:string>,relation:struct<type:string,subject:string,object:string,mode:string>,confidence:string>>"
#: Slots that an answer of each kind may fill, and rounds that a pending operation has.
RECOVERABLE = {"entity_reference": ["subject", "object", "target"], "dimension": ["dimension"], "value": ["value"]}
ROUNDS = 2


def overlaid(claims: DataFrame) -> DataFrame:
    """Claims with key (dimension or relation type), status, reason and slot.

    claims: proposal_id, position, origin (explicit, derived, assumed), kind, subject, object, predicate, dimension, value.
    Assumed claims are rejected and derived ones deferred. Entities, classifications and names are bound to a mention.
    Attributes need a known dimension, relations a predicate and both ends, measurements a dimension and a number; others
    are unsupported. Of claims for one thing the first is kept and the rest are duplicates; the first of a kind takes the
    proposal's own slot, later ones are additional.
    """
    user = by_user(claims)
    kind = F.col("kind")
    dimension = F.coalesce(V.dimension_of(F.col("dimension")), V.dimension_of(F.col("predicate")))
    key = F.when(kind == "relation", V.relation_key(F.col("predicate"))).when(kind == "measurement", V.measure_dimension_of(F.col("dimension"))).when(kind.isin("attribute", "intrinsic_property"), dimension)
    rows = claims.withColumn("key", key)
    named = F.coalesce(F.col("key") == "name", F.lit(False))
    bad = (
        F.when((kind == "intrinsic_property") & ~named, "unsupported_intrinsic")
        .when((kind == "attribute") & (F.col("key").isNull() | F.col("value").isNull()), "unsupported_attribute_dimension")
        .when((kind == "relation") & (F.col("key").isNull() | F.col("subject").isNull() | F.col("object").isNull()), "unsupported_relation_predicate")
        .when((kind == "measurement") & (F.col("key").isNull() | decimal_of(F.col("value")).isNull()), "unsupported_measurement")
        .when(~kind.isin("entity", "classification", "intrinsic_property", "attribute", "relation", "measurement"), "unsupported_kind")
    )
    reason = F.when(F.col("origin") == "assumed", "assumed_dropped").when(F.col("origin") == "derived", "derived_not_materialized").otherwise(bad)
    status = (
        F.when(F.col("origin") == "assumed", "rejected").when(F.col("origin") == "derived", "deferred").when(bad.isNotNull(), "unsupported")
        .when(kind.isin("entity", "classification", "intrinsic_property") | named, "bound").otherwise("overlaid")
    )
    rows = rows.withColumns({"status": status, "reason": reason})
    laid = F.col("status") == "overlaid"
    thing = [*user, "proposal_id", "status", "kind", "key", "subject", F.when(kind == "relation", F.col("object"))]
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy(*thing).orderBy("position")))
    fresh = laid & (F.col("__copy") == 1)
    turn = F.count_if(fresh).over(Window.partitionBy(*user, "proposal_id", "kind").orderBy("position"))
    slot = F.when(laid, F.when(F.col("__copy") > 1, "duplicate").when(turn == 1, "primary").otherwise("additional"))
    return rows.withColumn("slot", slot).drop("__copy")


def claim_reports(laid: DataFrame, proposals: DataFrame) -> DataFrame:
    """Per proposal the tally of its claims and the intent that follows: event, relation, attribute, measurement, state, or its own.

    proposals: proposal_id, has_event, has_state, intent.
    """
    user = by_user(laid, proposals)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    has = lambda k: F.max((F.col("slot") == "primary") & (F.col("kind") == k)).alias(f"has_{k}")
    tally = laid.groupBy(*user, "proposal_id").agg(F.count("*").alias("received"), *map(count, ("overlaid", "bound", "rejected", "deferred", "unsupported")), *map(has, ("relation", "attribute", "measurement")))
    rows = proposals.join(tally, [*user, "proposal_id"], "left")
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    intent = (
        F.when(sure("has_event"), "record_event").when(sure("has_relation"), "record_relation").when(sure("has_attribute"), "record_attribute")
        .when(sure("has_measurement"), "record_measurement").when(sure("has_state"), "record_state")
        .when(F.col("intent").isin("correct", "record_obligation", "record_intent"), F.col("intent")).otherwise("none")
    )
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("received", "overlaid", "bound", "rejected", "deferred", "unsupported")]
    return rows.select(*user, "proposal_id", *numbers, intent.alias("intent"))


def identity_mentions(claims: DataFrame, possessives: DataFrame) -> DataFrame:
    """proposal_id, text and position of the mentions that need an entity: ends of explicit claims, and owned things; each once.

    possessives: proposal_id, text: what a proposal mentions as owned.
    """
    user = by_user(claims, possessives)
    kind = F.col("kind")
    ends = F.when(kind.isin(*SUBJECT_ONLY), F.array("subject")).when(kind == "relation", F.array("subject", "object")).otherwise(F.array(F.coalesce("subject", "object")))
    said = claims.where("origin = 'explicit'").select(*user, "proposal_id", "position", F.posexplode(ends).alias("end", "text"))
    later = possessives.select(*user, "proposal_id", F.lit(1 << 30).alias("position"), F.lit(0).alias("end"), "text")
    rows = said.unionByName(later).where("text != ''").groupBy(*user, "proposal_id", "text").agg(F.min(F.struct("position", "end")).alias("at"))
    return rows.select(*user, "proposal_id", "text", F.row_number().over(Window.partitionBy(*user, "proposal_id").orderBy("at", "text")).alias("position"))


def folded_names(mentions: DataFrame) -> DataFrame:
    """proposal_id, name, role and fold of proposals that mention an owned role and a name for one entity.

    mentions: proposal_id, text, reference_kind, kind, naming (the proposal names something). The entity is kept under its
    name. With a person on either side it stands in the relation of the role; another thing is an owned instance, if the
    proposal names it. The least text decides between several.
    """
    user = by_user(mentions)
    pick = lambda cond: F.min(F.when(cond, F.struct("text", "kind"))).alias
    rows = mentions.groupBy(*user, "proposal_id").agg(pick(F.col("reference_kind") == "possessive")("role"), pick(F.col("reference_kind") == "named")("name"), F.max("naming").alias("naming"))
    rows = rows.where(F.lower(F.trim("role.text")) != F.lower(F.trim("name.text")))
    person = (F.coalesce(F.col("role.kind"), F.lit("")) == "person") | (F.coalesce(F.col("name.kind"), F.lit("")) == "person")
    fold_ = F.when(person, "person_role").when(F.col("naming"), "owned_instance")
    return rows.where(fold_.isNotNull()).select(*user, "proposal_id", F.col("name.text").alias("name"), F.col("role.text").alias("role"), fold_.alias("fold"))


def dispatched(text: Column) -> Column:
    """struct(route, failure): v2_canonical, semantic_v3 or invalid, by the kind of the one JSON object in a reply."""
    body = json_object_of(text)
    kind = F.get_json_object(body, "$.ir_kind")
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    many = objects_in(F.coalesce(text, F.lit(""))) > 1
    route = F.when(kind.isin("ingest", "query"), "v2_canonical").when(kind.isin("semantic_proposal", "semantic_query"), "semantic_v3").otherwise("invalid")
    failure = F.when(blank, "empty_response").when(many, "multiple_json_objects").when(body.isNull(), F.when(F.contains(text, F.lit("{")), "malformed_json").otherwise("non_json_text")).when(route == "invalid", "wrong_ir_kind")
    return F.struct(route.alias("route"), failure.alias("failure"))


def wired(text: Column) -> Column:
    """The parts of an ingest envelope in their canonical form: defaults filled in, inverse relations turned round."""
    w = F.from_json(json_object_of(text), WIRE)
    stored = V.stored_relation(F.lower(F.trim(w["ir"]["relation"]["type"])))
    swap = stored["swapped"]
    subject, other = w["ir"]["relation"]["subject"], w["ir"]["relation"]["object"]
    return F.struct(
        F.coalesce(w["ir"]["intent"], F.lit("none")).alias("intent"),
        F.lower(F.trim(w["ir"]["event"]["type"])).alias("event_type"),
        F.when(w["ir"]["event"]["type"].isNotNull(), F.coalesce(w["ir"]["event"]["status"], F.lit("completed"))).alias("status"),
        F.when(w["ir"]["relation"]["type"].isNotNull(), stored["key"]).alias("relation"),
        F.when(swap, other).otherwise(subject).alias("subject"),
        F.when(swap, subject).otherwise(other).alias("object"),
        F.when(w["ir"]["relation"]["type"].isNotNull(), F.coalesce(w["ir"]["relation"]["mode"], F.lit("assert"))).alias("mode"),
        F.coalesce(w["ir"]["confidence"].try_cast("decimal(4,2)"), F.lit(1).cast("decimal(4,2)")).alias("confidence"),
    )


def ontology_view(concepts: DataFrame) -> DataFrame:
    """kind, n and keys (in order) of all concepts; a kind is the first part of a key."""
    return concepts.select(F.substring_index("concept", ".", 1).alias("kind"), "concept").distinct().groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("concept")).alias("keys"))


def allowed(keys: DataFrame, concepts: DataFrame) -> DataFrame:
    """keys(kind, key) with allowed: whether the catalogue has the key under that kind."""
    known = concepts.select(F.substring_index("concept", ".", 1).alias("kind"), F.col("concept").alias("key"), F.lit(True).alias("allowed")).distinct()
    return keys.join(known, ["kind", "key"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def hydrated(stored: DataFrame, concepts: DataFrame) -> DataFrame:
    """Learned keys of stored rows (column key) that the registry lacks, each once, with how many rows bear it."""
    learned = stored.where(F.col("key").rlike(r"^[a-z]+\.learned\.")).groupBy("key").agg(F.count("*").alias("n"))
    return learned.join(concepts.select(F.col("concept").alias("key")), "key", "left_anti")


def event_preserved(asserted: Column, made: Column, reported: Column) -> Column:
    """Whether an asserted event has survived: as an event that is made, or among what is reported as not made."""
    return F.when(asserted, made | reported)


def falsely_canonical(made_type: Column, type_key: Column, action: Column, made_action: Column) -> Column:
    """Whether a partial event was given the type of an intent that it hadn't."""
    right = F.coalesce(type_key == made_type, F.lit(False)) | (action.isNotNull() & made_action.isNotNull())
    return made_type.isNotNull() & ~right & (made_type == "event.intent") & F.coalesce(type_key != "event.intent", F.lit(True))


def observable_groups(rows: DataFrame, keys: list[str], in_scope: Column) -> DataFrame:
    """Values that may be shown per keys: those in scope or, where there are none, those of all candidates; with support."""
    scoped = F.count_if(in_scope)
    groups = rows.groupBy(*keys, "value", "unit").agg(scoped.alias("n_scoped"), F.count("*").alias("n_all"))
    some = F.max(F.col("n_scoped") > 0).over(Window.partitionBy(*keys))
    rows = groups.withColumn("some", some).where(~F.col("some") | (F.col("n_scoped") > 0))
    return rows.select(*keys, "value", "unit", F.when(F.col("some"), F.col("n_scoped")).otherwise(F.col("n_all")).alias("support"), F.when(F.col("some"), "scope").otherwise("candidates").alias("taken_from"))


def call_metrics(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: attempts, calls, mean latency, tokens and the share of attempts with valid JSON, of calls with a valid shape.

    calls: outcome (ok, json, wire, canonical, provider), latency_ms, prompt_tokens, completion_tokens.
    """
    ok = lambda *o: F.count_if(F.col("outcome").isin(*o))
    found = calls.groupBy(*keys).agg(F.count("*").alias("attempts"), ok("ok", "canonical").alias("calls"), ok("json").alias("json_failures"), ok("wire").alias("wire_failures"), ok("canonical").alias("canonical_failures"), F.round(F.avg("latency_ms"), 2).alias("mean_latency"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    share = lambda bad, of: F.round(F.when(of > 0, (of - bad) / of), 4)
    return found.withColumns({"json_rate": share(F.col("json_failures"), F.col("attempts")), "wire_rate": share(F.col("wire_failures"), F.col("calls") + F.col("wire_failures"))})


def owned_tie_break(mentions: DataFrame, owned: DataFrame, recent: DataFrame, last_of_type: DataFrame, create: bool = False) -> DataFrame:
    """mention_id, status, entity_id and why: which of several owned things a mention means.

    mentions: mention_id, owner, hint. owned: owner, entity_id, type_key. recent: owner, entity_id. last_of_type: owner,
    type_key, entity_id. One that fits is it; else the one last spoken of as this type, else the only recent one.
    """
    user = by_user(mentions, owned)
    fits = mentions.join(owned.withColumnRenamed("type_key", "hint"), [*user, "owner", "hint"], "left")
    fits = fits.join(recent.select(*user, "owner", "entity_id", F.lit(True).alias("recent")).distinct(), [*user, "owner", "entity_id"], "left")
    fits = fits.join(last_of_type.select(*user, "owner", F.col("type_key").alias("hint"), "entity_id", F.lit(True).alias("last")), [*user, "owner", "hint", "entity_id"], "left")
    found = fits.groupBy(*user, "mention_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"), F.min(F.when(F.col("last"), F.col("entity_id"))).alias("last"), F.count_if("recent").alias("n_recent"), F.min(F.when(F.col("recent"), F.col("entity_id"))).alias("recent"))
    why = F.when(F.col("n") == 1, "only").when((F.col("n") > 1) & F.col("last").isNotNull(), "last_of_type").when((F.col("n") > 1) & (F.col("n_recent") == 1), "recent")
    entity = F.when(why == "only", F.col("one")).when(why == "last_of_type", F.col("last")).when(why == "recent", F.col("recent"))
    status = F.when(why.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("create_candidate" if create else "unresolved")
    return found.select(*user, "mention_id", status.alias("status"), entity.alias("entity_id"), why.alias("why"))


def recovered(pending: DataFrame, answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers to clarifying questions: user_id, pending_id, outcome and filled (the slot's new value).

    pending: user_id, pending_id, state (open, resolved, cancelled), expects, slot, rounds, answered. answers: user_id,
    pending_id, text. entities: user_id, entity_id, name. Ids may be the same for several users: an answer goes to its own
    user's operation. One that only others have is rejected, one that nobody has gives no row; the same answer to a
    resolved one is a replay, closed and exhausted ones stay closed; an answer fills one slot or asks again.
    """
    key = ["user_id", "pending_id"]
    expects = F.col("expects")
    slots = [(expects == e) & F.col("slot").isin(s) for e, s in RECOVERABLE.items()]
    # what an answer needs to know of its operation, in few bytes: both sides have a row for each, and tasks sort them
    asked = pending.select(
        *key, F.when(~(slots[0] | slots[1] | slots[2]), -1).otherwise(F.coalesce(*[F.when(expects == e, i) for i, e in enumerate(RECOVERABLE)])).alias("way"), (F.col("state").isin("resolved", "cancelled") | (F.col("rounds") >= ROUNDS)).alias("closed"),
        F.when(F.col("state") == "resolved", F.trim("answered")).alias("before"),
    ).hint("merge")
    way, open_ = F.col("way"), ~F.coalesce("closed", F.lit(False))
    value = F.when(way == 1, V.measure_dimension_of(F.col("text"))).when(way == 2, decimal_of(F.col("text")).cast("decimal(18,2)").cast("string"))
    outcome = F.when(F.col("before") == F.trim("text"), "replay").when(~open_, "closed").when(way == -1, "unsupported_slot").when(way == 0, "by_name").when(value.isNotNull(), "recovered").otherwise("asked_again")
    # answers that give no name get a key of their own, so that a common one ("yes", "7") is not a single task's rows
    name = F.when(open_ & (way == 0), fold(F.col("text"))).otherwise(F.concat(F.lit("\0"), F.col("pending_id").cast("string")))
    rows = answers.join(asked, key).select(*key, outcome.alias("outcome"), F.when(outcome == "recovered", value).alias("filled"), name.alias("__name"))
    names = entities.groupBy("user_id", fold(F.col("name")).alias("__name")).agg(F.when(F.count("*") == 1, F.min("entity_id")).alias("named")).where("named is not null")
    rows = rows.join(names, ["user_id", "__name"], "left")
    by_name = F.col("outcome") == "by_name"
    own = rows.select(*key, F.when(~by_name, F.col("outcome")).otherwise(F.when(F.col("named").isNull(), "asked_again").otherwise("recovered")).alias("outcome"), F.when(by_name, F.col("named")).otherwise(F.col("filled")).alias("filled"))
    others = answers.select(*key).join(pending.select(*key).hint("merge"), key, "left_anti").join(pending.select("pending_id").hint("merge"), "pending_id", "left_semi")
    return own.unionByName(others.select(*key, F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("filled")))


def relative_span(name: Column, now: Column, zone: Column) -> Column:
    """struct(start, end): as `temporal.relative_period`, for names, moments and zones that differ from row to row."""
    day = F.to_date(F.from_utc_timestamp(now, zone))
    week, month = F.date_trunc("week", day).cast("date"), F.trunc(day, "month")
    spans = {
        "today": (day, F.date_add(day, 1)), "yesterday": (F.date_sub(day, 1), day), "this_week": (week, F.date_add(week, 7)), "last_week": (F.date_sub(week, 7), week),
        "this_month": (month, F.add_months(month, 1)), "last_month": (F.add_months(month, -1), month),
    }
    utc = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    found = [F.when(name == n, F.struct(utc(a).alias("start"), utc(b).alias("end"))) for n, (a, b) in spans.items()]
    return F.coalesce(F.when(name == "now", F.struct(now.alias("start"), (now + F.expr("INTERVAL 1 MICROSECOND")).alias("end"))), *found)


def built_queries(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """What a question means in ids: request_id, relation (stored key), swapped, entity_id, start, end and error.

    asked: user_id, request_id, name, predicate, period, explicit_start, explicit_end, now, zone. An inverse predicate
    swaps the ends of the relation. Relative and explicit times together are an error, as are a name that nobody or
    several bear and a period without a meaning.
    """
    names = entities.groupBy("user_id", fold(F.col("name")).alias("__name")).agg(F.count("*").alias("n_named"), F.min("entity_id").alias("entity_id"))
    rows = asked.withColumn("__name", fold(F.col("name"))).join(names, ["user_id", "__name"], "left")
    rows = rows.withColumns({"r": V.stored_relation(V.relation_key(F.col("predicate"))), "span": relative_span(F.col("period"), F.col("now"), F.col("zone"))})
    error = (
        F.when(F.col("period").isNotNull() & F.col("explicit_start").isNotNull(), "time_twice")
        .when(F.col("period").isNotNull() & F.col("span").isNull(), "period_unknown")
        .when(F.col("explicit_end") <= F.col("explicit_start"), "range_empty")
        .when(F.col("name").isNotNull() & F.col("n_named").isNull(), "entity_unresolved")
        .when(F.col("n_named") > 1, "entity_ambiguous")
    )
    return rows.select("user_id", "request_id", F.col("r.key").alias("relation"), F.col("r.swapped").alias("swapped"), F.when(F.col("n_named") == 1, F.col("entity_id")).alias("entity_id"), F.coalesce("explicit_start", "span.start").alias("start"), F.coalesce("explicit_end", "span.end").alias("end"), error.alias("error"))
