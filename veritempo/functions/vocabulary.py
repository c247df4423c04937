"""Closed vocabularies: aliases of dimensions, relations and kinds, and the columns that look them up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritempo.functions.text import decimal_of, fold, name_like, slug

# Aliases that decide a key, over folded text.
DIMENSION_ALIASES = {
    "color": ["cor", "color", "cores", "colour", "colours"],
    "model_year": ["ano", "ano do carro", "ano do veiculo", "model year", "model_year", "year"],
    "weight": ["peso", "weight", "pesa"],
    "height": ["altura", "height"],
    "area": ["area", "metros quadrados", "metro quadrado", "m2", "m²"],
    "capacity": ["capacidade", "capacity", "capacidade do tanque"],
    "name": ["nome", "name", "chamo", "chama"],
    "brand": ["marca", "brand"],
    "model": ["modelo", "model"],
    "sex": ["sex", "sexo", "gender", "genero"],
    "profession": ["profession", "occupation", "profissao", "profesion"],
}
MEASURE_ALIASES = {
    "temperature": ["temperatura", "temperature", "temp"],
    "weight": ["peso", "weight"],
    "balance": ["saldo", "balance"],
    "height": ["altura", "height"],
    "volume": ["volume"],
    "pressure": ["pressao", "pressure"],
    "distance": ["distancia", "distance"],
}
NOT_DIMENSIONS = ["percent", "%", "kg", "liters", "l", "value", "reading", "r$", "$", "unit"]
RELATION_ALIASES = {
    "relation.employed_by": ["works at", "work at", "trabalha em", "trabalha na", "employed by"],
    "relation.resides_at": ["lives in", "mora em", "resides at", "reside em"],
    "relation.owns": ["owns", "possui", "is mine", "e meu"],
    "relation.likes": ["gosta de", "gosto de", "gostam de", "likes", "curte", "adora"],
    "relation.married_to": ["married to", "casada com", "casado com", "marriage"],
    "relation.parent_of": ["parent of", "mae de", "pai de", "parent"],
    "relation.provider_for": ["provider for", "cardiologista", "medico", "provider"],
}
INVERSE_RELATIONS = {"relation.employs": "relation.employed_by", "relation.owned_by": "relation.owns", "relation.child_of": "relation.parent_of", "relation.client_of": "relation.provider_for"}
KINDS = ["person", "organization", "place", "thing", "appliance", "vehicle", "document", "medication", "unknown"]
KIND_ALIASES = {"automobile": "vehicle", "car": "vehicle", "org": "organization", "company": "organization", "people": "person", "human": "person", "location": "place", "object": "thing", "item": "thing"}
KIND_TYPES = {
    "person": "entity.person",
    "organization": "entity.organization",
    "place": "entity.place",
    "appliance": "entity.appliance",
    "vehicle": "entity.automobile",
    "document": "entity.document",
    "medication": "entity.medication",
    "thing": "entity.thing",
}
CLAIM_PRIMITIVES = {
    "entity": "entity",
    "classification": "classification",
    "attribute": "property",
    "intrinsic_property": "property",
    "relation": "relation",
    "event": "event",
    "measurement": "measurement",
}
ROUTE_PRIMITIVES = {"event": "event", "relation": "relation", "attribute": "property", "type": "classification", "measurement": "measurement"}


def flat(table: dict[str, list[str]]) -> dict[str, str]:
    """alias -> key."""
    return {alias: key for key, aliases in table.items() for alias in aliases}


def looked_up(value: Column, table: dict[str, str]) -> Column:
    """The table's entry for a value, or null; the table is one literal, which the optimiser makes a map of once."""
    pairs = F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items()))
    return F.try_element_at(F.str_to_map(pairs, F.lit("\x01"), F.lit("\x02")), value)


def dimension_of(alias: Column) -> Column:
    """An attribute's dimension by its exact alias, or null."""
    return looked_up(fold(alias), flat(DIMENSION_ALIASES))


def measure_dimension_of(answer: Column) -> Column:
    """A measurement's dimension from an answer: the whole of it, the first word before a comma, or the first two words."""
    text = fold(answer)
    head = F.substring_index(F.trim(F.substring_index(text, ",", 1)), " ", 1)
    table = flat(MEASURE_ALIASES)
    return F.coalesce(*[looked_up(c, table) for c in (text, head, F.substring_index(text, " ", 2))])


def measurement_value(dimension: Column, number: Column, unit: Column, currency: Column) -> Column:
    """struct(dimension, number, unit, currency, error): the value of a stated measurement, or why there is none."""
    key, value = F.trim(dimension), decimal_of(number)
    error = (
        F.when(key.isNull() | (key == ""), "dimension_missing")
        .when(F.lower(key).isin(NOT_DIMENSIONS), "dimension_forbidden")
        .when(number.isNull(), "number_missing")
        .when(value.isNull(), "number_invalid")
        .when(unit.isNotNull() & currency.isNotNull(), "unit_and_currency")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, key).alias("dimension"), F.when(ok, value).alias("number"), F.when(ok & currency.isNull(), unit).alias("unit"), F.when(ok, F.upper(currency)).alias("currency"), error.alias("error"))


def relation_key(predicate: Column) -> Column:
    """The stored key of a predicate: a key as it is, an alias's or its bare name's, else a learned one; null without letters."""
    known, folded = flat(RELATION_ALIASES), fold(predicate)
    names = {key.removeprefix("relation."): key for key in RELATION_ALIASES} | {key.removeprefix("relation."): key for key in INVERSE_RELATIONS}
    dotted = F.replace(folded, F.lit(" "), F.lit("_"))
    learned = F.concat(F.lit("relation.learned."), slug(predicate))
    given = F.trim(predicate)
    return F.when(given.startswith("relation."), given).when(given != "", F.coalesce(looked_up(dotted, names), looked_up(folded, known), learned))


def stored_relation(key: Column) -> Column:
    """struct(key, swapped): inverse keys are stored under their forward key with the ends swapped."""
    forward = looked_up(key, INVERSE_RELATIONS)
    return F.struct(F.coalesce(forward, key).alias("key"), forward.isNotNull().alias("swapped"))


def entity_type_of(hint: Column) -> Column:
    """The entity type of a class hint: that of its kind, else a learned one from its slug."""
    word = F.lower(F.trim(hint))
    kind = F.coalesce(looked_up(word, KIND_ALIASES), word)
    return F.coalesce(looked_up(kind, KIND_TYPES), F.concat(F.lit("entity.learned."), slug(hint)))


def brand_like(text: Column, brands: list[str]) -> Column:
    """A brand of the closed list, its first letter upper; else null."""
    name = name_like(text)
    return F.when(F.lower(name).isin(brands), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(F.lower(name), 2, 200)))


def display_value(text: Column, number: Column, unit: Column, year: Column, day: Column) -> Column:
    """How a value of an attribute is shown: text, number with unit, year, date; empty if it has none."""
    amount = F.concat_ws(" ", number.cast("string"), F.when(unit != "", unit))
    return F.coalesce(text, F.when(number.isNotNull(), amount), year.cast("string"), day.cast("string"), F.lit(""))


def graph_primitive(kind: Column, routed: bool = False) -> Column:
    """The graph's primitive for the kind of a claim, or for a routed primitive; null for states and unknown kinds."""
    return looked_up(kind, ROUTE_PRIMITIVES if routed else CLAIM_PRIMITIVES)


def decoded(kind: Column, value: Column) -> Column:
    """struct of typed fields from an encoded value: number, flag, amount and currency, reference, json or text."""
    return F.struct(
        F.when(kind.isin("int", "decimal"), value.try_cast("decimal(38,6)")).alias("number"),
        F.when(kind == "bool", value == "true").alias("flag"),
        F.when(kind == "money", F.substring_index(value, " ", 1).try_cast("decimal(38,6)")).alias("amount"),
        F.when(kind == "money", F.substring_index(value, " ", -1)).alias("currency"),
        F.when(kind == "ref", value).alias("reference"),
        F.when(kind.isin("string", "json"), value).alias("text"),
    )
