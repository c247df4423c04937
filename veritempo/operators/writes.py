"""From candidates to assertions: validation, acceptance, materialisation and corrections, rejects beside accepts.

A candidate is one row of a statement that may become assertions of one user; its mentions, references and facts are rows
of their own that carry (user_id, candidate_id). New ids are hashes of what they stand for, so that a repeated run gives
the same ids and an append can be checked by an anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.functions.text import decimal_of, fold
from veritempo.operators import interpret
from veritempo.operators.scope import USER, by_user
from veritempo.storage import checkpoint

KEY = [USER, "candidate_id"]
#: The kind of concept that each reference must name.
REFERENCE_KINDS = {"event.type": "event", "event.action": "action", "state.value": "state_value", "state.dimension": "state_dimension", "relation.type": "relation", "obligation.type": "event", "fact.attribute": "attribute", "mention.type": "entity"}
#: Roles that a mention's role becomes on an event; others take no part.
PARTICIPANT_ROLES = {"role.actor": "role.actor", "role.provider": "role.actor", "role.object": "role.object", "role.subject": "role.object", "role.patient": "role.patient", "role.context": "role.context", "role.unspecified": "role.unspecified"}
# Words by which a speaker means themself.
SELF_WORDS = ["eu", "me", "mim", "comigo", "meu", "minha", "meus", "minhas", "self", "actor", "speaker", "para mim", "pra mim", "a mim"]
PRINCIPAL_NAME, PRINCIPAL_TYPE = "self", "entity.person"


def new_id(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256), 1, 26)


# Validation ---------------------------------------------------------------------------------------------------------


def _issue(rows: DataFrame, code: Column | str, severity: str = "error") -> DataFrame:
    return rows.select(*KEY, F.lit(severity).alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code")).where("code is not null")


def validated(candidates: DataFrame, references: DataFrame, mentions: DataFrame, facts: DataFrame, concepts: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with errors and warnings (sorted codes, each once) and valid.

    candidates: KEY, primitive, intent, source_kind, temporal, stated_precision, stated_clock (a time of day or instant was
    stated), type_key, frequency, monthday, target_id (of a correction). references: KEY, field, key. mentions: KEY, text,
    status, reference_kind, create_type, vehicle (the type is one), entity_id. facts: KEY, key, qualifier, epistemic,
    confidence, amount (text), currency. concepts: concept, kind. entities: user_id, entity_id.
    """
    wanted = reduce(lambda acc, x: F.when(F.col("field") == x[0], x[1]).otherwise(acc), REFERENCE_KINDS.items(), F.lit(None).cast("string"))
    named = references.withColumn("wanted", wanted).join(concepts.select(F.col("concept").alias("key"), "kind"), "key", "left")
    issues = [_issue(named, F.when(F.col("kind").isNull(), "ontology.unknown").when(F.col("kind") != F.col("wanted"), "ontology.kind_mismatch"))]

    of_candidate = mentions.join(candidates.select(*KEY, "intent"), KEY)
    bound = F.col("reference_kind").isin("contextual", "possessive")
    may_create = F.col("create_type").isNotNull() & ((F.col("reference_kind") == "possessive") | F.col("vehicle"))
    creates = F.col("status") == "create_candidate"
    refused = creates & F.when(bound, ~may_create).otherwise(F.col("intent") == "correct")
    issues.append(_issue(of_candidate, F.when(F.col("status") == "ambiguous", "entity.ambiguous").when(refused, "entity.create_not_allowed").when((F.col("status") == "unresolved") & bound, "entity.contextual_unresolved")))
    issues.append(_issue(of_candidate, F.when(creates & ~refused, "entity.create_pending"), "warning"))
    foreign = mentions.where("entity_id is not null").join(entities.select(USER, "entity_id"), [USER, "entity_id"], "left_anti")
    issues.append(_issue(foreign, "entity.foreign"))

    timed = F.col("primitive").isin("event", "state", "relation")
    got = F.col("temporal.precision")
    promoted = (F.col("primitive") == "event") & (F.col("stated_precision") == "day") & (got == "minute") & ~F.col("stated_clock")
    issues.append(_issue(candidates, F.when(timed & ~T.persistable(F.col("temporal")), "time.missing").when(promoted, "time.precision_promoted")))
    bill = (F.col("type_key") == "event.recurring_bill") & (F.col("frequency") != "monthly")
    issues.append(_issue(candidates, F.when((F.col("primitive") == "obligation") & (bill | ((F.col("frequency") == "monthly") & F.col("monthday").isNull())), "time.recurrence_incompatible")))
    issues.append(_issue(candidates, F.when((F.col("intent") == "correct") & F.col("target_id").isNull(), "correction.target_unresolved")))

    stated = facts.join(candidates.select(*KEY, "source_kind"), KEY)
    for code in (
        F.when((F.col("qualifier") == "exact") & (F.col("epistemic") == "uncertain"), "epistemic.exact_vs_uncertain"),
        F.when((F.col("qualifier") == "approximately") & (F.col("confidence") >= 0.99), "epistemic.confidence_inflated"),
        F.when((F.col("epistemic") == "inferred") & (F.col("source_kind") != "inference"), "epistemic.inference_source"),
        F.when(F.col("key") == "attribute.amount", _money_error(F.col("amount"), F.col("currency"))),
        F.when((F.col("key") == "attribute.amount") & F.col("currency").isNull() & (decimal_of(F.col("amount")) < 0), "value.amount_negative"),
    ):
        issues.append(_issue(stated, code))
    every = reduce(DataFrame.unionByName, issues)
    found = every.groupBy(*KEY).agg(*[F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("code")))).alias(f"{s}s") for s in ("error", "warning")])
    rows = candidates.join(found, KEY, "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("errors", "warnings")})
    return rows.withColumn("valid", F.size("errors") == 0)


def _money_error(amount: Column, currency: Column) -> Column:
    number = decimal_of(amount)
    return F.when(number.isNull(), "value.money_invalid").when(currency.isNull(), "value.money_currency_missing").when(number < 0, "value.amount_negative")


def assessed(rows: DataFrame, completeness: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected candidates: accepted are those that are valid and lack nothing essential.

    rows: validated candidates. completeness: candidate_id, blocking, question.
    """
    joined = rows.join(completeness.select(*by_user(rows, completeness), "candidate_id", "blocking", "question"), [*by_user(rows, completeness), "candidate_id"], "left")
    accepted = F.col("valid") & ~F.coalesce("blocking", F.lit(False))
    return joined.where(accepted), joined.where(~accepted)


# Materialisation ----------------------------------------------------------------------------------------------------


def bound_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions with their entity ids, new entities, and rejected mentions (to be created, but without a type).

    mentions: KEY, text, status, reference_kind, create_type, create_name, entity_id, role. An owned thing gets a name of
    its own that no other one has; other new entities are named as mentioned, one for each text of a candidate.
    """
    creates = F.col("status") == "create_candidate"
    made = creates & F.col("create_type").isNotNull()
    named = mentions.withColumn("new", new_id(USER, "candidate_id", "text"))
    bound = named.where(made | ((F.col("status") == "resolved") & F.col("entity_id").isNotNull())).withColumn("entity_id", F.when(made, F.col("new")).otherwise(F.col("entity_id")))
    owned = F.concat(F.lit("owned "), F.col("create_type"), F.lit(":"), F.substring("new", -8, 8))
    name = F.when(F.col("reference_kind") == "possessive", owned).otherwise(F.coalesce("create_name", "text"))
    fresh = named.where(made).select(USER, F.col("new").alias("entity_id"), F.col("create_type").alias("type_key"), name.alias("name")).dropDuplicates([USER, "entity_id"])
    return bound.drop("new"), fresh, named.where(creates & F.col("create_type").isNull()).drop("new")


def participants(bound: DataFrame) -> DataFrame:
    """KEY, entity_id and role of the mentions that take part in an event, each once; position orders them."""
    role = F.create_map(*[F.lit(x) for pair in PARTICIPANT_ROLES.items() for x in pair])[F.col("role")]
    rows = bound.withColumn("role", role).where("role is not null")
    return rows.groupBy(*KEY, "entity_id", "role").agg(F.min("position").alias("position"))


def materialised_events(accepted: DataFrame, taking_part: DataFrame) -> DataFrame:
    """Events of accepted candidates that are events or obligations; obligations are scheduled and recur as stated.

    The first actor and the first object or patient fill the older actor and subject slots; context never does.
    """
    first = lambda *roles: F.min_by("entity_id", F.when(F.col("role").isin(*roles), F.struct("position", "entity_id")))
    slots = taking_part.groupBy(*KEY).agg(first("role.actor").alias("actor_id"), first("role.object", "role.patient").alias("subject_id"), F.count("*").alias("n_participants"))
    rows = accepted.where(F.col("primitive").isin("event", "obligation")).join(slots, KEY, "left")
    due = F.col("primitive") == "obligation"
    recurring = T.temporal(kind=F.lit("exact"), precision=F.lit("recurring"), recurring=F.lit(True), original_text=F.concat(F.lit("todo dia "), F.col("monthday").cast("string")))
    when = F.when(due & F.col("temporal").isNull(), recurring).otherwise(F.col("temporal"))
    return rows.select(*KEY, new_id(USER, "candidate_id", F.lit("event")).alias("event_id"), "type_key", F.when(~due, F.col("action")).alias("action"), F.when(due, "scheduled").otherwise(F.col("status")).alias("status"), "actor_id", "subject_id", F.coalesce("n_participants", F.lit(0)).alias("n_participants"), when.alias("temporal"))


def materialised_facts(made_events: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts about the events made of their candidates."""
    rows = made_events.select(*KEY, F.col("event_id").alias("about_id")).join(facts, KEY)
    return rows.select(*KEY, new_id("about_id", "key", "position").alias("fact_id"), "about_id", F.col("key").alias("concept"), decimal_of(F.col("amount")).alias("amount"), "currency", "qualifier", "confidence", F.lit(None).cast("string").alias("supersedes_id"))


def materialised_measurements(stated: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Measurements of stated(KEY, subject, context, dimension, number, unit, currency, temporal, with_event), and rejects.

    observed_at is an exact calendar instant or null, never the moment of writing. A measurement that can't be made is
    skipped beside an event and a reason to reject the candidate alone.
    """
    names = bound.select(*KEY, F.col("text").alias("subject"), "entity_id").dropDuplicates([*KEY, "subject"])
    contexts = names.withColumnsRenamed({"subject": "context", "entity_id": "context_id"})
    rows = stated.join(names, [*KEY, "subject"], "left").join(contexts, [*KEY, "context"], "left").withColumn("value", decimal_of(F.col("number")))
    error = F.when(F.col("entity_id").isNull(), "subject_unresolved").when(F.col("context").isNotNull() & F.col("context_id").isNull() & ~F.col("with_event"), "context_unresolved").when(F.col("value").isNull(), "number_invalid")
    rows = rows.withColumn("error", error)
    exact = F.when(F.col("temporal.kind") == "exact", F.col("temporal.instant"))
    made = rows.where("error is null").select(*KEY, new_id(USER, "candidate_id", "subject", "dimension").alias("measurement_id"), "entity_id", "context_id", "dimension", "value", "unit", "currency", exact.alias("observed_at"))
    return made, rows.where("error is not null").select(*KEY, "subject", "error", F.when(F.col("with_event"), "skipped").otherwise("rejected").alias("outcome"))


def ensured_principals(users: DataFrame, bindings: DataFrame, entities: DataFrame) -> DataFrame:
    """user_id, entity_id, outcome: the entity that stands for each user: kept, created, or broken (bound to none)."""
    rows = users.select(USER).distinct().join(bindings.select(USER, "entity_id"), USER, "left")
    known = entities.select(USER, "entity_id", F.lit(True).alias("known"))
    rows = rows.join(known, [USER, "entity_id"], "left")
    outcome = F.when(F.col("entity_id").isNull(), "created").when(F.col("known"), "kept").otherwise("broken")
    return rows.select(USER, F.when(outcome == "created", new_id(USER, F.lit("principal"))).otherwise(F.col("entity_id")).alias("entity_id"), outcome.alias("outcome"))


def resolved_selves(mentions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Mentions with the principal's id where the speaker means themself, in contextual references of such words alone."""
    rows = mentions.join(bindings.select(USER, F.col("entity_id").alias("principal_id")), USER, "left")
    word = F.regexp_replace(fold(F.col("text")), r"\s+", " ")
    meant = (F.col("reference_kind") == "contextual") & word.isin(SELF_WORDS)
    return rows.withColumn("self_id", F.when(meant, F.col("principal_id"))).drop("principal_id")


# Corrections --------------------------------------------------------------------------------------------------------


def fact_corrections(corrections: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New facts that replace older ones, and rejects.

    corrections: user_id, correction_id, fact_id or event_id, concept, amount, currency. A fact is replaced itself; of an
    event, the current fact of that concept (the newest), or none, so that the new one is its first.
    """
    from veritempo.operators.ledger import with_currency

    marked = with_currency(facts)
    by_id = marked.select(USER, "fact_id", F.col("about_id").alias("fact_about"), F.lit(True).alias("found"))
    newest = marked.where("is_current").groupBy(USER, F.col("about_id").alias("event_id"), "concept").agg(F.max_by("fact_id", F.struct("created_at", "fact_id")).alias("current_id"))
    rows = corrections.join(by_id, [USER, "fact_id"], "left").join(newest, [USER, "event_id", "concept"], "left")
    error = F.when(F.col("fact_id").isNull() & F.col("event_id").isNull(), "anchor_missing").when(F.col("fact_id").isNotNull() & F.col("found").isNull(), "fact_missing")
    rows = rows.withColumn("error", error)
    made = rows.where("error is null").select(USER, "correction_id", new_id(USER, "correction_id").alias("fact_id"), F.coalesce("fact_about", "event_id").alias("about_id"), "concept", "amount", "currency", F.coalesce("fact_id", "current_id").alias("supersedes_id"))
    return made, rows.where("error is not null").select(USER, "correction_id", "error")


def correction_entries(requests: DataFrame, ids: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries to append to the correction ledger, and rejected requests with a reason.

    requests: user_id, request_id, action, kind, target_id, replacement_id. ids: user_id, kind, id of all assertions. A
    target must be there, be effective and not have been corrected; of two requests for one target the first one counts.
    """
    known = ids.select(USER, "kind", F.col("id").alias("target_id"), F.lit(True).alias("target_known"))
    other = ids.select(USER, "kind", F.col("id").alias("replacement_id"), F.lit(True).alias("replacement_known"))
    done = ledger.select(USER, "kind", "target_id", F.lit(True).alias("done")).distinct()
    rows = requests.join(known, [USER, "kind", "target_id"], "left").join(other, [USER, "kind", "replacement_id"], "left").join(done, [USER, "kind", "target_id"], "left")
    replaces = F.col("action") == "replace"
    error = (
        F.when(F.col("target_known").isNull(), "target_missing")
        .when(replaces & F.col("replacement_known").isNull(), "replacement_missing")
        .when(replaces & (F.col("replacement_id") == F.col("target_id")), "self_replacement")
        .when(F.col("done"), "target_recorrected")
    )
    rows = rows.withColumn("error", error)
    turn = F.row_number().over(Window.partitionBy(USER, "kind", "target_id").orderBy(F.col("error").isNotNull(), "request_id"))
    rows = rows.withColumn("error", F.coalesce("error", F.when(turn > 1, "target_recorrected")))
    columns = [USER, "request_id", "action", "kind", "target_id", F.when(replaces, F.col("replacement_id")).alias("replacement_id")]
    return rows.where("error is null").select(*columns), rows.where("error is not null").select(USER, "request_id", "error")


def correction_outcomes(utterances: DataFrame, candidates: DataFrame, ids: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What comes of utterances that propose a correction, and the entries to append.

    utterances: user_id, request_id, text, has_prior, action, kind, part, amount, scope, replacement_id; candidates: as for
    `catalog.correction_targets`, with user_id and kind. First the acceptance guard, then the target, then the ledger.
    """
    from veritempo.operators.catalog import correction_targets

    guarded = checkpoint(utterances.withColumn("guard", interpret.correction_guard(F.col("text"), F.col("has_prior"))).drop("text"))  # read by every step below
    admitted = guarded.where("guard.outcome = 'accept'")
    asked = admitted.select(USER, F.col("request_id").alias("description_id"), "scope", "part", "amount", "kind")
    found = correction_targets(asked, candidates, ledger.select(USER, "target_id")).withColumnsRenamed({"description_id": "request_id", "status": "target_status"})
    aimed = checkpoint(admitted.join(found.select(USER, "request_id", "target_status", "target_id"), [USER, "request_id"]))
    entries, rejects = correction_entries(aimed.where("target_status = 'resolved'").select(USER, "request_id", "action", "kind", "target_id", "replacement_id"), ids, ledger)
    rows = guarded.join(aimed.select(USER, "request_id", "target_status"), [USER, "request_id"], "left").join(rejects, [USER, "request_id"], "left")
    outcome = (
        F.when(F.col("guard.outcome") == "clarify", "clarify")
        .when(F.col("guard.outcome") == "reject", "rejected")
        .when(F.col("target_status") == "ambiguous", "target_ambiguous")
        .when(F.col("target_status") == "not_found", "target_unresolved")
        .when(F.col("error").isNotNull(), "rejected")
        .otherwise("committed")
    )
    reason = F.coalesce("error", F.when(F.col("guard.outcome") != "accept", F.col("guard.reason")))
    return rows.select(USER, "request_id", outcome.alias("outcome"), reason.alias("reason")), entries
