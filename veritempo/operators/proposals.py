"""Rules over interpreted proposals: query modes, vetoes on canonical keys, roles of mentions, propagated hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.operators.events import closure
from veritempo.operators.scope import by_user

# Cues in lower-case text that decide a query's mode.
VALUE_CUE = r"\besta|\besta[vr]|\bera\b|\btinha\b|\bficou\b|\bj[aá]\s+(esteve|ficou|foi)\b|\bwas\b|\bwere\b|\bhad\b"
LAST_CUE = r"\b[uú]ltim[ao]\s+(leitura|medi[cç][aã]o|observa[cç][aã]o|valor)\b|\blast\s+(reading|measurement|observation)\b"
RANGE_CUE = r"\bquais\b|\bleituras\b|\bmedi[cç][oõ]es\b|\bwhich\s+(were|readings)\b"
ASKING_CUE = r"\bquantos?\b|\bquanta\b|\bqual\b"
PRESENT_CUE = r"\b(tem|est[aá]|is|are)\b"
EXISTED_CUE = r"\bj[aá]\s+foi\b|\balready\s+was\b|\bhas\s+been\b"
PAST_CUE, IN_YEAR_CUE = r"\bera\b|\bwas\b", r"\bem\s+\d{4}\b|\bin\s+\d{4}\b"
OPEN_CUE = r"\bqual\b|\bquanto\b|\bquantos\b|\bquanta\b|\bwhat\b|\bhow\s+much\b|\bcomo\b"

#: For each canonical key: senses that forbid it, and a sense that it needs (or none).
GATES = {
    "action.replace": (["install", "exchange_idea", "currency_exchange", "clothing_change"], "replace_physical"),
    "action.install": (["facilities"], "install"),
    "state.value.working": (["property_new", "facilities"], None),
    "state.value.broken": (["property_new"], None),
    "state.value.open": (["property_new"], None),
}


def measurement_mode(text: Column, has_number: Column, has_time: Column) -> Column:
    """value_proposition, latest_observation, observations_in_range or observation_at_time, by ordered cues."""
    low = F.lower(text)
    return (
        F.when(has_number & low.rlike(VALUE_CUE), "value_proposition")
        .when(low.rlike(LAST_CUE), "latest_observation")
        .when(low.rlike(RANGE_CUE), "observations_in_range")
        .when(has_time | low.rlike(r"\b(agora|atual|atualmente|now|currently)\b"), "observation_at_time")
        .when(low.rlike(PRESENT_CUE) & low.rlike(ASKING_CUE), "observation_at_time")
        .otherwise("latest_observation")
    )


def attribute_mode(text: Column, selection: Column, is_query: Column, has_value: Column) -> Column:
    """value_lookup, historical_existence or proposition; a structured selection goes before all cues."""
    low = F.lower(text)
    return (
        F.when(selection.isin("previous", "first", "last", "before"), "value_lookup")
        .when(low.rlike(EXISTED_CUE) | (low.rlike(PAST_CUE) & low.rlike(IN_YEAR_CUE)), "historical_existence")
        .when(is_query, F.when(has_value, "proposition").otherwise("value_lookup"))
        .when(low.rlike(OPEN_CUE), "value_lookup")
        .otherwise("proposition")
    )


def gate(key: Column, senses: Column) -> Column:
    """Why a canonical key must not be used for a text with these senses, or null."""
    out = F.lit(None).cast("string")
    for name, (forbidden, needed) in GATES.items():
        why = F.when(F.arrays_overlap(senses, F.array(*map(F.lit, forbidden))), "forbidden_sense")
        if needed:
            why = why.when(~F.array_contains(senses, needed), "missing_sense")
        out = F.when(key == name, why).otherwise(out)
    return out


def event_roles(mentions: DataFrame) -> DataFrame:
    """proposal_id, mention_id and role of mentions(proposal_id, mention_id, text, slot, kind, hint, change, intransitive).

    A person as subject acts if hinted so or if something changes; the subject of an intransitive change is affected, and
    then nobody acts; places and organisations are context, each text once.
    """
    person, place = F.col("kind") == "person", F.col("kind").isin("place", "organization")
    affected = (F.col("slot") == "subject") & F.col("intransitive") & ~person
    key = [*by_user(mentions), "proposal_id"]
    any_affected = F.max(affected.cast("int")).over(Window.partitionBy(*key)) == 1
    role = (
        F.when(affected, "role.patient")
        .when(~any_affected & person & ((F.col("hint") == "actor") | ((F.col("slot") == "subject") & F.col("change"))), "role.actor")
        .when((F.col("slot") == "object") | (F.col("hint") == "object"), "role.object")
        .when(place, "role.context")
    )
    rows = mentions.withColumn("role", role).where("role is not null")
    first = F.row_number().over(Window.partitionBy(*key, "role", F.lower(F.trim("text"))).orderBy("mention_id"))
    return rows.withColumn("n", F.when(F.col("role") == "role.context", first).otherwise(1)).where("n = 1").select(*key, "mention_id", "role")


def propagated_hints(mentions: DataFrame) -> DataFrame:
    """mention_id and class_hint, where a proposal's only hint also counts for its mentions without one."""
    key = [*by_user(mentions), "proposal_id"]
    only = mentions.groupBy(*key).agg(F.count_distinct("class_hint").alias("n"), F.min("class_hint").alias("only"))
    rows = mentions.join(only, key)
    return rows.select(*by_user(mentions), "mention_id", F.coalesce("class_hint", F.when(F.col("n") == 1, F.col("only"))).alias("class_hint"))


def type_evidence(candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """candidates(mention_id, entity_id, type_key, hint) with evidence: type_match, type_descendant_match or null."""
    below = closure(concepts).select(F.col("concept").alias("type_key"), F.col("ancestor").alias("hint"), "depth")
    rows = candidates.join(below, ["type_key", "hint"], "left")
    return rows.select(*by_user(candidates), "mention_id", "entity_id", F.when(F.col("depth") == 0, "type_match").when(F.col("depth") > 0, "type_descendant_match").alias("evidence"))


def resolve_contextual(mentions: DataFrame, recent: DataFrame, concepts: DataFrame) -> DataFrame:
    """mention_id, status and entity_id: the most recent entity of the conversation whose type fits the hint.

    mentions: mention_id, conv_id, hint. recent: conv_id, position, entity_id, type_key.
    """
    below = closure(concepts).select(F.col("concept").alias("type_key"), F.col("ancestor").alias("hint"))
    user = by_user(mentions, recent)
    found = mentions.join(recent, [*user, "conv_id"]).join(below, ["type_key", "hint"], "left_semi")
    best = found.groupBy(*user, "mention_id").agg(F.max_by("entity_id", F.struct("position", "entity_id")).alias("entity_id"))
    rows = mentions.select(*user, "mention_id").join(best, [*user, "mention_id"], "left")
    return rows.select(*user, "mention_id", F.when(F.col("entity_id").isNull(), "unresolved").otherwise("resolved").alias("status"), "entity_id")
