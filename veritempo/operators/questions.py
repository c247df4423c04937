"""What a question means: a resolved proposal becomes the columns of a query specification, or says why it can't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions.attribute_values import COLORS
from veritempo.functions.text import decimal_of, fold
from veritempo.operators.claims import relative_span
from veritempo.operators.repairs import PLACEHOLDERS, SNAPSHOT

# Patterns over folded text that decide the result.
NOW = r"\bagora\b|\batualmente\b|\bneste\s+momento\b|\bno\s+momento\b|\bright\s+now\b|\bcurrently\b"
NOW_SAID = r"\bagora\b|\batualmente\b|\bneste\s+momento\b|\bno\s+momento\b"
PROPOSED = r"\besta|\bera\b|\btinha\b|\bficou\b|\bja\s+(?:esteve|ficou|foi)\b|\bwas\b|\bwere\b|\bhad\b"
LAST_READING = r"\bultim[ao]\s+(?:leitura|medicao|observacao|valor)\b|\blast\s+(?:reading|measurement|observation)\b"
ALL_READINGS = r"\bquais\b|\bleituras\b|\bmedicoes\b|\bwhich\s+(?:were|readings)\b"
PRESENT, PRESENT_HERE, HOW_MUCH = r"\b(?:tem|esta|is|are)\b", r"\b(?:tem|esta)\b", r"\b(?:quanto|quantos|quanta|qual)\b"
EVER, WAS, IN_YEAR = r"\bja\s+foi\b|\balready\s+was\b|\bhas\s+been\b", r"\b(?:era|was)\b", r"\b(?:em|in)\s+\d{4}\b"

#: The columns of a specification that a question may fill, with their types.
SPEC = {
    "intent": "string", "association": "string", "mode": "string", "aggregate": "string", "action": "string", "event_type": "string", "relation": "string", "object_type": "string", "state_dimension": "string", "state_value": "string",
    "dimension": "string", "value_kind": "string", "value_text": "string", "value_number": "decimal(38,6)", "value_unit": "string", "value_currency": "string", "value_year": "int", "version_policy": "string", "sort": "string", "limit": "int",
}


def stated_time(p: dict[str, Column], surface: Column) -> Column:
    """struct(period, date_from, date_to, text): the time that a question states, or null where it states none.

    The present moment goes before all, even before a day that says today: it is an instant and not a calendar day. A month
    needs its year; without it, as with words that mean no period, only the text is kept.
    """
    text, month, year = F.coalesce(p["time_text"], F.lit("")), p["partial_month"], p["partial_year"]
    now = surface.rlike(NOW) | fold(text).rlike(NOW_SAID)
    dated = year.isNotNull() & (month.isNull() | month.between(1, 12))
    first = F.when(dated, F.make_date(year, F.coalesce(month, F.lit(1)), F.lit(1)))
    last = F.when(dated, F.add_months(first, F.when(month.isNull(), 12).otherwise(1)))
    day = F.when(month.isNull() & year.isNull() & p["relative_day"].isin("yesterday", "today"), p["relative_day"])
    period = F.when(now, "now").otherwise(day)
    said = now | month.isNotNull() | year.isNotNull() | day.isNotNull() | (F.trim(text) != "")
    made = F.struct(period.alias("period"), F.when(~now, first).alias("date_from"), F.when(~now, last).alias("date_to"), F.coalesce(F.nullif(text, F.lit("")), period, year.cast("string")).alias("text"))
    return F.when(said, made)


def measurement_mode(surface: Column, time: Column, has_number: Column) -> Column:
    """How measurements are asked for. What is asked about the present is an observation now, never the latest one."""
    ranged = time["period"].isNotNull() | time["date_from"].isNotNull()
    return (
        F.when(has_number & surface.rlike(PROPOSED), "proposition")
        .when(surface.rlike(LAST_READING), "latest")
        .when(surface.rlike(ALL_READINGS), "in_range")
        .when(surface.rlike(NOW) | F.coalesce(ranged, F.lit(False)) | (surface.rlike(PRESENT) & surface.rlike(HOW_MUCH)), "at_time")
        .otherwise("latest")
    )


def attribute_mode(surface: Column, selected: Column, has_value: Column) -> Column:
    """How attributes are asked for: a chosen version goes before words of the past, and those before a value."""
    ever = surface.rlike(EVER) | (surface.rlike(WAS) & surface.rlike(IN_YEAR))
    return F.when(selected, "value_lookup").when(ever, "existence").when(has_value, "proposition").otherwise("value_lookup")


def specified(proposals: DataFrame) -> DataFrame:
    """user_id, request_id, primitive, status, note, the columns of `SPEC`, time_text, period, start and end.

    proposals: user_id, request_id, primitive; concept_status and sense of `concepts.resolve_concepts`, and its action,
    event_type, relation, dimension (as state_dimension), value (as state_value) and attribute_value; mentions (an array of
    text and role), has_subject, object_text, object_class (whether the object names a class) and object_type;
    attribute_dimension; measure_dimension, measure_number, measure_unit and measure_currency; raw_input and the four
    expressions; change; time_text, partial_year, partial_month, relative_day, selection and relation_to_reference; now and
    zone. Status: resolved, safe_unresolved, safe_ambiguous, ontology_gap or insufficient; only resolved ones have a
    specification. Ranges are half-open moments: dates begin at midnight in the asker's zone.
    """
    raw = lambda *cs: fold(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cs]))
    rows = proposals.withColumns({"__measured": raw("raw_input", "measure_expression", "attribute_expression"), "__described": raw("raw_input", "attribute_expression"), "__n": F.size(F.array_distinct(F.coalesce("mentions", F.array().cast("array<struct<text:string,role:string>>"))))})
    rows = rows.withColumn("__time", stated_time({c: F.col(c) for c in ("time_text", "partial_year", "partial_month", "relative_day")}, F.col("__measured")))
    number = decimal_of(F.col("measure_number"))
    selected = F.coalesce(F.col("selection").isin("previous", "first", "last") | (F.col("relation_to_reference") == "before"), F.lit(False))
    snapshot = F.coalesce(F.trim("attribute_expression") == SNAPSHOT, F.lit(False))
    attribute = F.when(snapshot, "snapshot").otherwise(attribute_mode(F.col("__described"), selected, F.col("attribute_value").isNotNull()))
    rows = rows.withColumns({"__mmode": measurement_mode(F.col("__measured"), F.col("__time"), F.col("measure_number").isNotNull()), "__amode": attribute, "__selected": selected, "__number": number})

    is_ = lambda p: F.col("primitive") == p
    placeholder = F.col("object_text").isNull() | (F.trim("object_text") == "") | fold(F.col("object_text")).isin(*PLACEHOLDERS)
    classed = ~placeholder & F.coalesce("object_class", F.lit(False))
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    nothing = F.col("action").isNull() & F.col("event_type").isNull() & ~F.coalesce("change", F.lit(False)) & ~filled("action_expression") & ~filled("event_expression")
    proposed = F.col("__mmode") == "proposition"
    unsure = (F.col("concept_status") == "ambiguous") & (F.col("sense") == "ambiguous_pass")
    kept_back = F.when(F.col("concept_status") == "blocked", "blocked").when(unsure, "ambiguous_pass").when(F.col("concept_status") == "ontology_gap", "ontology_gap").when(is_("unknown"), "unknown_primitive")
    lacking = (
        F.when(is_("event") & nothing, "event_query_missing_constraints")
        .when(is_("state") & F.col("state_value").isNull(), "state_value_unresolved")
        .when(is_("relation") & (F.col("relation").isNull() | ~F.coalesce("has_subject", F.lit(False))), "relation_identity_incomplete")
        .when(is_("relation") & classed & F.col("object_type").isNull(), "class_constraint_unresolved")
        .when(is_("attribute") & ~snapshot & F.col("attribute_dimension").isNull(), "attribute_dimension_unresolved")
        .when(is_("attribute") & (F.col("__n") == 0), "attribute_entity_missing")
        .when(is_("measurement") & ~filled("measure_dimension"), "measurement_dimension_unresolved")
        .when(is_("measurement") & (F.col("__n") == 0), "measurement_entity_missing")
        .when(is_("measurement") & proposed & F.col("__number").isNull(), "measurement_proposition_value_unresolved")
        .when(is_("measurement") & proposed & F.col("measure_unit").isNotNull() & F.col("measure_currency").isNotNull(), "measurement_unit_currency_coexist")
        .when(is_("type"), "type_query_not_attribute")
        .when(~F.coalesce(F.col("primitive").isin("event", "state", "relation", "attribute", "measurement"), F.lit(False)), "unsupported_query_primitive")
    )
    status = F.when(kept_back == "blocked", "safe_unresolved").when(kept_back == "ontology_gap", "ontology_gap").when(kept_back.isNotNull(), "safe_ambiguous").when(lacking.isNotNull(), "insufficient").otherwise("resolved")
    rows = rows.withColumns({"status": status, "note": F.coalesce(kept_back, lacking)})

    # an observation asked for now has the present moment as its time, if nothing else is said
    present = is_("measurement") & (F.col("__mmode") == "at_time") & F.col("__time").isNull() & (F.col("__measured").rlike(NOW) | F.col("__measured").rlike(PRESENT_HERE))
    timeless = is_("state") | is_("relation")
    period = F.when(~timeless, F.when(present, "now").otherwise(F.col("__time.period")))
    dated = lambda c: F.when(~timeless, F.to_utc_timestamp(F.col(f"__time.{c}").cast("timestamp"), F.col("zone")))
    rows = rows.withColumns({"__period": period, "__span": relative_span(period, F.col("now"), F.col("zone"))})

    valued = is_("attribute") & F.col("__amode").isin("proposition", "existence")
    color = F.nullif(F.regexp_extract(F.col("__described"), rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(sorted(COLORS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}_])", 1), F.lit(""))
    seen = F.when(valued & (F.col("__amode") == "existence") & F.col("attribute_value").isNull(), color)
    value = lambda field: F.when(valued, F.col(f"attribute_value.{field}"))
    counts = F.col("__period").isNotNull() | F.col("__time.date_from").isNotNull()
    history, lone = is_("attribute") & F.col("__selected") & ~snapshot, is_("measurement") & proposed
    spec = {
        "intent": F.when(is_("event"), F.when(counts, "aggregate").otherwise("list")).otherwise(F.col("primitive")),
        "association": F.when(is_("relation"), "relation_subject").when(is_("event") & (F.col("__n") > 1), "event_context").otherwise("subject"),
        "mode": F.when(is_("attribute"), F.col("__amode")).when(is_("measurement"), F.col("__mmode")).when(is_("relation") & ~placeholder, "boolean").when(is_("relation"), "list"),
        "aggregate": F.when(is_("event") & counts, "count"),
        "action": F.when(is_("event"), F.col("action")),
        "event_type": F.when(is_("event"), F.col("event_type")),
        "relation": F.when(is_("relation"), F.col("relation")),
        "object_type": F.when(is_("relation") & classed, F.col("object_type")),
        "state_dimension": F.when(is_("state"), F.col("state_dimension")),
        "state_value": F.when(is_("state"), F.col("state_value")),
        "dimension": F.when(is_("attribute") & ~snapshot, F.col("attribute_dimension")).when(is_("measurement"), F.trim("measure_dimension")),
        "value_kind": F.coalesce(value("kind"), F.when(seen.isNotNull(), "text"), F.when(lone, "number")),
        "value_text": F.coalesce(value("text"), seen),
        "value_number": F.coalesce(value("number"), F.when(lone, F.col("__number"))),
        "value_unit": F.coalesce(value("unit"), F.when(lone, F.col("measure_unit"))),
        "value_currency": F.when(lone, F.upper("measure_currency")),
        "value_year": value("year"),
        "version_policy": F.when(history, "history"),
        "sort": F.when(history, F.when(F.col("selection") == "first", "event_time_asc").otherwise("event_time_desc")),
        "limit": F.when(history, 1),
    }
    good = F.col("status") == "resolved"
    return rows.select(
        "user_id", "request_id", "primitive", "status", "note", *[F.when(good, c).cast(SPEC[n]).alias(n) for n, c in spec.items()],
        F.when(good & ~timeless, F.coalesce("__time.text", F.when(F.col("__period") == "now", "now"))).alias("time_text"), F.when(good, F.col("__period")).alias("period"),
        F.when(good, F.coalesce(dated("date_from"), "__span.start")).alias("start"), F.when(good, F.coalesce(dated("date_to"), "__span.end")).alias("end"),
    )
