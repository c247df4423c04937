"""Concept resolution: which canonical concept a proposal's words mean, or why none may be used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritempo.functions import attribute_values
from veritempo.functions import vocabulary as V
from veritempo.functions.text import decimal_of, fold, slug
from veritempo.operators import interpret
from veritempo.operators.automaton import expressions_in
from veritempo.operators.scope import by_user


@dataclass(frozen=True)
class Alias:
    """Expressions that mean a concept, and what a proposal must and must not be for that."""

    primitive: str
    expressions: tuple[str, ...]
    keys: dict[str, str]
    subjects: tuple[str, ...] = ()
    objects: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()  # of change, condition, link
    forbids: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    priority: int = 10


def _link(key: str, objects: tuple[str, ...], needs: tuple[str, ...] = ("link",), priority: int = 10) -> Alias:
    return Alias("relation", tuple(V.RELATION_ALIASES[key]), {"relation": key}, ("person",), objects, needs, priority=priority)


_CHATS = ("troquei ideia", "trocar ideia", "exchange idea", "changed mind", "troquei reais", "trocar reais", "troquei de roupa", "trocar de roupa")

# The aliases of the core concepts.
ALIASES = [
    _link("relation.employed_by", ("organization",)),
    _link("relation.resides_at", ("place",)),
    _link("relation.owns", ()),
    _link("relation.likes", (), needs=()),
    _link("relation.married_to", ("person",)),
    _link("relation.parent_of", ("person",)),
    _link("relation.provider_for", ("person",), priority=8),
    Alias("state", ("broken", "quebrada", "quebrado", "broken down"), {"dimension": "state.operational_condition", "value": "state.value.broken"}, needs=("condition",)),
    Alias("state", ("open", "aberta", "aberto", "is open"), {"dimension": "state.openness", "value": "state.value.open"}, needs=("condition",)),
    Alias("state", ("overdue", "atrasada", "atrasado", "late bill"), {"dimension": "state.due_status", "value": "state.value.overdue"}, needs=("condition",)),
    Alias("state", ("depleted", "acabou", "ran out", "empty", "esgotado", "esgotada"), {"dimension": "state.availability", "value": "state.value.depleted"}, needs=("condition",)),
    Alias("state", ("unemployed", "desempregado", "desempregada"), {"dimension": "state.availability", "value": "state.value.depleted"}, needs=("condition",), priority=5),
    Alias("state", ("working", "funcionando", "operational"), {"dimension": "state.operational_condition", "value": "state.value.working"}, needs=("condition",), priority=9),
    Alias("state", ("fechado", "fechada", "closed"), {"dimension": "state.openness", "value": "state.value.closed"}, needs=("condition",)),
    Alias("state", ("nao pago", "unpaid"), {"dimension": "state.payment_status", "value": "state.value.unpaid"}, needs=("condition",)),
    Alias("state", ("valido", "valid"), {"dimension": "state.validity", "value": "state.value.valid"}, needs=("condition",)),
    Alias("state", ("vencido", "vencida", "expired"), {"dimension": "state.validity", "value": "state.value.expired"}, needs=("condition",)),
    Alias("event", ("replace clutch", "substitui a embreagem", "troquei a embreagem", "substituir a embreagem", "trocar a embreagem"), {"action": "action.replace", "event_type": "event.vehicle_maintenance"}, needs=("change",), forbids=_CHATS, domains=("domain.vehicle",)),
    Alias("event", ("troquei o", "troquei a", "trocar o", "trocar a", "substitui o", "substitui a", "replaced the", "replace the"), {"action": "action.replace"}, needs=("change",), forbids=(*_CHATS, "instalou", "instalei", "instalacoes"), priority=9),
    Alias("event", ("broke", "quebrou", "break", "failed"), {"event_type": "event.maintenance"}, needs=("change",)),
    Alias("event", ("opened", "abriu", "open event"), {"event_type": "event.maintenance"}, needs=("change",)),
    Alias("event", ("oil change", "trocar oleo", "troquei o oleo"), {"action": "action.oil_change", "event_type": "event.vehicle_maintenance"}, needs=("change",), domains=("domain.vehicle",), priority=11),
    Alias("event", ("instalou", "instalei", "instalaram", "instalar", "installed", "install", "instalacao", "instalacao do", "fez a instalacao"), {"action": "action.install"}, needs=("change",), forbids=("instalacoes", "facilities", "instalacoes da empresa", "sao novas"), priority=12),
    Alias("event", ("consertei", "consertei o", "consertei a", "consertar", "repaired", "repaired the"), {"action": "action.maintain", "event_type": "event.maintenance"}, needs=("change",), forbids=("instalou", "instalei", "troquei", "substitu"), priority=9),
    Alias("blocked", ("exchange idea", "troquei ideia", "trocar ideia", "changed mind"), {}, priority=20),
]
#: Senses that a result names, the first that a proposal shows.
NAMED_SENSES = ["exchange_idea", "clothing_change", "currency_exchange", "install", "facilities", "ambiguous_pass", "replace_physical", "property_new"]
KEYS = ["relation", "dimension", "value", "action", "event_type", "attribute"]
EXPRESSIONS = ["action_expression", "relation_expression", "state_expression", "attribute_expression", "event_expression", "raw_input"]

ALIAS_SCHEMA = "alias_id int, primitive string, expressions array<string>, forbids array<string>, subjects array<string>, objects array<string>, needs array<string>, priority int, relation string, dimension string, value string, action string, event_type string, attribute string, domains array<string>"


def alias_frame(spark: SparkSession, aliases: list[Alias] = ALIASES) -> DataFrame:
    """Aliases as rows; more of them may be added by union, with ids of their own."""
    rows = [(i, a.primitive, list(a.expressions), list(a.forbids), list(a.subjects), list(a.objects), list(a.needs), a.priority, *(a.keys.get(k) for k in KEYS), list(a.domains)) for i, a in enumerate(aliases)]
    return spark.createDataFrame(rows, ALIAS_SCHEMA)


def _vetoed(senses: Column, subject: Column, object_: Column) -> Column:
    """Why an alias's keys must not be used for a proposal with these senses and kinds of ends, or null."""
    has = lambda s: F.array_contains(senses, s)
    thing = F.coalesce(subject.isin("appliance", "thing", "vehicle"), F.lit(False))
    replace = F.coalesce(*[F.when(has(s), f"{s}_sense") for s in ("install", "exchange_idea", "currency_exchange", "clothing_change")], F.when(~has("replace_physical"), "no_physical_evidence"))
    install = F.when(has("facilities"), "facilities_sense").when(~has("install"), "no_install_sense")
    broken = F.when(has("property_new"), "property_new_sense").when(~has("operational_broken") & ~thing, "no_operational_context")
    employed = F.when(thing, "subject_no_person").when(object_.isNotNull() & (object_ != "organization"), "object_no_organization")
    new = F.when(has("property_new"), "property_new_sense")
    return (
        F.when(F.col("action") == "action.replace", replace)
        .when(F.col("action") == "action.install", install)
        .when(F.col("value") == "state.value.working", F.coalesce(new, F.when(has("facilities"), "facilities_sense")))
        .when(F.col("value") == "state.value.broken", broken)
        .when(F.col("value") == "state.value.open", new)
        .when(F.col("relation") == "relation.employed_by", employed)
    )


def alias_candidates(proposals: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, alias columns and veto of every alias that a proposal's words and flags allow.

    Every alias's expressions, and those that forbid it, are sought at once in the proposal's words; a candidate is an
    alias of the proposal's primitive, or a blocked one, with an expression found, none found that forbids it, and its
    constraints met. Ownership gives way to a relation that the proposal states in other words.
    """
    told = aliases.select("alias_id", F.explode(F.concat(F.transform("expressions", lambda x: F.struct(x.alias("expression"), F.lit(False).alias("forbids"))), F.transform("forbids", lambda x: F.struct(x.alias("expression"), F.lit(True).alias("forbids"))))).alias("x"))
    told = told.select("alias_id", fold(F.col("x.expression")).alias("expression"), "x.forbids").withColumn("expression_id", F.xxhash64("expression"))
    hits = expressions_in(proposals.select(*keys, F.col("words").alias("text")), told.select("expression_id", "expression"), keys)
    found = hits.join(told, "expression_id").groupBy(*keys, "alias_id").agg(F.max("forbids").alias("forbidden")).where("not forbidden").drop("forbidden")
    ordered = aliases.withColumn("first_expression", F.array_min(F.transform("expressions", fold)))
    flags = proposals.select(*keys, F.col("primitive").alias("wanted"), "subject_kind", "object_kind", "change", "condition", "link", "senses", F.coalesce(fold("relation_expression"), F.lit("")).alias("stated"))
    rows = found.join(ordered, "alias_id").join(flags, keys)
    kinds = [(F.size(c) == 0) | F.coalesce(F.array_contains(c, F.col(k)), F.lit(False)) for c, k in (("subjects", "subject_kind"), ("objects", "object_kind"))]
    needs = [~F.array_contains("needs", flag) | F.col(flag) for flag in ("change", "condition", "link")]
    preempted = (F.col("relation") == "relation.owns") & (F.col("stated") != "") & ~F.array_contains(F.transform("expressions", fold), F.col("stated"))
    fits = (F.col("primitive") == F.col("wanted")) & kinds[0] & kinds[1] & needs[0] & needs[1] & needs[2] & ~F.coalesce(preempted, F.lit(False))
    rows = rows.where((F.col("primitive") == "blocked") | fits)
    return rows.withColumn("veto", _vetoed(F.col("senses"), F.col("subject_kind"), F.col("object_kind")))


def _gap(primitive: Column, senses: Column, installs: Column) -> Column:
    """struct(status, sense) of what is understood but has no concept, or null."""
    has = lambda s: F.array_contains(senses, s)
    say = lambda status, sense: F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), F.lit(sense).alias("sense"))
    event_install = has("install") & (primitive == "event")
    later = (
        F.when(has("facilities") & has("property_new"), say(F.when(primitive == "attribute", "ontology_gap").otherwise("safe_partial"), "facilities"))
        .when(has("currency_exchange"), say("ontology_gap", "currency_exchange"))
        .when(has("clothing_change"), say("unresolved", "clothing_change"))
        .when(has("exchange_idea"), say("blocked", "exchange_idea"))
        .when(has("ambiguous_pass"), say("ambiguous", "ambiguous_pass"))
    )
    return F.when(event_install, F.when(~installs, say("ontology_gap", "install"))).otherwise(later)


def with_senses(proposals: DataFrame) -> DataFrame:
    """Proposals with words (all their expressions, folded), senses and surface (the expression that they are about)."""
    told = F.array_compact(F.array(*[F.nullif(fold(F.col(c)), F.lit("")) for c in EXPRESSIONS]))
    shown = ["action_expression", "state_expression", "attribute_expression", "relation_expression", "event_expression"]
    rows = proposals.withColumn("words", F.array_join(told, " "))
    p = {"text": F.col("words"), "change": F.col("change"), "link": F.col("link"), "relation": F.col("relation_expression"), "subject_kind": F.col("subject_kind"), "object_kind": F.col("object_kind"), "condition": F.col("condition"), "state": F.col("state_expression"), "stable": F.col("stable"), "classification": F.col("classification")}
    return rows.withColumns({"senses": interpret.senses(p), "surface": F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in shown])})


def _in_catalogue(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """alias_id, a_... (its keys that the catalogue has), a_domains and lacks (whether it has keys that the catalogue lacks)."""
    told = aliases.select("alias_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("concept")) for k in KEYS])).alias("x")).select("alias_id", "x.*").where("concept is not null")
    told = told.join(concepts.select("concept", F.lit(True).alias("known")).distinct(), "concept", "left")
    held = [F.max(F.when((F.col("kind") == k) & F.col("known"), F.col("concept"))).alias(f"a_{k}") for k in KEYS]
    found = told.groupBy("alias_id").agg(*held, F.coalesce(F.bool_or(F.col("known").isNull()), F.lit(False)).alias("lacks"))
    return found.join(aliases.select("alias_id", F.col("domains").alias("a_domains")), "alias_id")


def different_proposals(proposals: DataFrame) -> DataFrame:
    """Proposals of each user that say the same in every column as one, with their number n and the largest proposal_id.

    What a proposal means depends on what it says alone, so rules over words, which cost far more than grouping, need to
    read each different one once.
    """
    said = [c for c in proposals.columns if c != "proposal_id"]
    return proposals.groupBy(*said).agg(F.max("proposal_id").alias("proposal_id"), F.count("*").alias("n"))


def resolve_concepts(proposals: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """proposal_id, primitive, status, sense, surface, reason, the keys, domains, value and companions of each proposal.

    proposals: proposal_id (and user_id), primitive, the expressions (action_expression ... raw_input), subject_kind and
    object_kind (null: no such end is stated), change, condition, link, stable and classification (flags), tense,
    measure_dimension, measure_number and measure_unit, claim_dimension, claim_text, claim_number and claim_unit.
    concepts: concept, what the catalogue has. Status: resolved, unresolved, ambiguous, blocked, ontology_gap or
    safe_partial. A blocked alias goes before all others; then the one of the highest priority whose veto is null, and two
    with equal evidence are ambiguous; else what the senses say is missing; else a relation with both ends is learned under
    a key of its own. Keys that the catalogue lacks are taken back.
    """
    keys = [*by_user(proposals), "proposal_id"]
    rows = with_senses(proposals)
    found = alias_candidates(rows.where(~F.col("primitive").isin("type", "attribute", "measurement")), aliases, keys)
    free = F.col("veto").isNull() & (F.col("primitive") != "blocked")
    rank = F.struct((-F.col("priority")).alias("p"), F.col("first_expression").alias("e"), F.coalesce("relation", "action", "value", "event_type", F.lit("")).alias("k"))
    # as many as a proposal has matching aliases, so few
    ranked = F.sort_array(F.collect_list(F.when(free, F.struct(rank.alias("rank"), F.col("alias_id")))))
    best = found.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.col("primitive") == "blocked"), F.lit(False)).alias("is_blocked"),
        ranked.alias("r"),
        F.min(F.when(F.col("veto").isNotNull(), F.struct("alias_id", "veto"))).alias("v"),
    )
    best = best.withColumns({"b": F.get("r", 0), "tied": F.get("r", 0)["rank"] == F.get("r", 1)["rank"]}).drop("r")
    rows = rows.join(best, keys, "left").withColumn("alias_id", F.col("b.alias_id")).join(_in_catalogue(aliases, concepts), "alias_id", "left")
    installs = F.lit(not concepts.where("concept = 'action.install'").isEmpty())

    p = {c: F.col(c) for c in ("attribute_expression", "raw_input", "subject_kind", "stable", "classification", "claim_dimension", "claim_text", "claim_number", "claim_unit", "tense")}
    rows = rows.withColumns({"first_value": attribute_values.attribute_value(p), "companions": attribute_values.companions(p), "gap": _gap(F.col("primitive"), F.col("senses"), installs), "learned": F.concat(F.lit("relation.learned."), slug(F.col("relation_expression")))})
    is_attribute, is_measurement = F.col("primitive") == "attribute", F.col("primitive") == "measurement"
    value = F.coalesce("first_value", F.get("companions", 0))
    measured = V.measure_dimension_of(F.col("measure_dimension")).isNotNull() & decimal_of(F.col("measure_number")).isNotNull()
    learns = (F.col("primitive") == "relation") & F.col("subject_kind").isNotNull() & F.col("object_kind").isNotNull() & F.col("learned").isNotNull()
    path = (
        F.when(F.col("primitive") == "type", "type")
        .when(is_attribute, F.when(F.col("gap").isNotNull(), "gap").when(value.isNotNull(), "value").otherwise("no_value"))
        .when(is_measurement, F.when(measured, "measured").otherwise("not_measured"))
        .when(F.col("is_blocked"), "blocked")
        .when(F.col("b").isNotNull(), F.when(F.coalesce("tied", F.lit(False)), "tied").otherwise("alias"))
        .when(F.col("gap").isNotNull(), "gap")
        .when(learns, "learned")
        .otherwise("none")
    )
    rows = rows.withColumn("path", path)
    rows = rows.withColumn("taken_back", (F.col("path") == "alias") & F.col("lacks"))
    kept = [F.when(F.col("path") == "alias", F.col(f"a_{k}")).when((F.col("path") == "learned") & F.lit(k == "relation"), F.col("learned")).alias(k) for k in KEYS]
    sense = F.coalesce(*[F.when(F.array_contains("senses", s), s) for s in NAMED_SENSES])
    status = (
        F.when(F.col("path").isin("type", "not_measured"), "safe_partial")
        .when(F.col("path") == "gap", F.col("gap.status"))
        .when(F.col("path").isin("value", "measured", "learned"), "resolved")
        .when(F.col("path") == "alias", F.when(F.col("taken_back"), "unresolved").otherwise("resolved"))
        .when(F.col("path") == "blocked", "blocked")
        .when(F.col("path") == "tied", "ambiguous")
        .otherwise("unresolved")
    )
    shown = F.when(F.col("path") == "type", "classification").when(is_measurement, "measurement").when(F.col("path") == "gap", F.col("gap.sense")).when(F.col("path") != "tied", sense)
    reason = (
        F.when(F.col("path") == "type", "classification").when(F.col("path") == "no_value", "no_safe_value").when(F.col("path") == "not_measured", "incomplete_measurement")
        .when(F.col("path") == "blocked", "blocked_alias").when(F.col("path") == "tied", "equal_evidence").when(F.col("path") == "gap", "no_concept_for_sense")
        .when(F.col("taken_back"), "unknown_key").when(F.col("path") == "none", F.coalesce(F.col("v.veto"), F.lit("no_alias")))
    )
    stated = F.when(F.col("path") == "value", value)
    return rows.select(
        *keys, "primitive", status.alias("status"), shown.alias("sense"), "surface", reason.alias("reason"), *kept,
        F.when(F.col("path") == "alias", F.col("a_domains")).otherwise(F.array().cast("array<string>")).alias("domains"),
        stated.alias("attribute_value"),
        F.when(F.col("path") == "value", F.filter("companions", lambda c: c["dimension"] != value["dimension"])).alias("companions"),
        F.when(F.col("path") == "value", attribute_values.is_current(p)).alias("is_current"),
    )
