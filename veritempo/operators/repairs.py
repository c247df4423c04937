"""Repairs of interpreted proposals: ordered rules that rewrite a proposal's slots, with the rules that changed it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions import vocabulary as V
from veritempo.functions.attribute_values import COLORS, TRIMMED, dimension_in
from veritempo.functions.text import fold, normalize

#: What stands for all attributes of a thing in a question.
SNAPSHOT = "*"
# Patterns over folded text that decide the result.
ARTICLES, POSSESSIVES = r"(?:o|a|os|as|the)\s+", r"(?:meu|minha|meus|minhas|my)"
SELF_NAMED = r"(?i)^\s*(?:meu\s+nome\s+(?:e|é|=)|eu\s+me\s+chamo|me\s+chamo)\s+(.+?)\s*\.?\s*$"
NAME_ASKED = r"^(?:qual(?:\s+e)?\s+(?:o\s+)?meu\s+nome|como(?:\s+eu)?\s+me\s+chamo|como(?:\s+e)?\s+(?:o\s+)?meu\s+nome|voce\s+sabe(?:\s+o)?\s+meu\s+nome)$"
NOT_NAME_ASKED = r"\b(nome\s+do|nome\s+da|amigo|armazen|artistico|carro|veiculo|usuario|pergunt)\b"
HAVES = r"^(?:eu\s+)?(?:tenho|tem|possuo|have)\s+(?:um|uma|o|a|uns|umas)?\s*([\p{L}\p{N}_\-]+)$"
ASKS = r"\b(qual|quais|quanto|quanta|quantos|what|how|como)\b|\?$"
OVERVIEWS = r"\b(o\s+que|what)\b.*\b(sabe|souber|conhece|know)\b.*\b(sobre|about|d[oea]|do|da)\b|\b(me\s+)?(conta|fala|diz|tell)\b.*\b(sobre|about|d[oea]|do|da)\b"
IDENTITY = rf"^(?:qual|quais|what)(?:\s+(?:e|is))?\s+(?:o|a|os|as|the)?\s+{POSSESSIVES}\s+([\p{{L}}\p{{N}}_\-]+)$"
COPULA = rf"^(?:o|a|os|as)?\s*{POSSESSIVES}\s+([\p{{L}}\p{{N}}_\-]+)\s+(?:e|=|is)\s+(?:um\s+|uma\s+|a\s+|an\s+)?(.+)$"
POSSESSED = rf"\b{POSSESSIVES}\s+(?:um|uma|a|an\s+)?([\p{{L}}\p{{N}}_\-]+)"
MY_CAR = r"(?i)^\s*meu\s+carro\s+(?:e|é|=)\s+(?:um\s+|uma\s+)?(.+?)\s*\.?\s*$"
LIKES = r"\b(?:gosto|gosta|gostam|likes|curte|adora|adoro|prefiro|prefere|fan|fa)\b"
PLACEHOLDERS = ["que", "o que", "do que", "de que", "what", "which"]
NOUN_KINDS = {
    "vehicle": ["carro", "car", "veiculo", "auto", "moto", "motocicleta", "bicicleta", "bike"],
    "place": ["casa", "apartamento", "house"],
    "person": ["amigo", "amiga", "filho", "filha"],
    "appliance": ["porta", "telefone", "celular", "phone"],
}
TELLS = ["assert", "change", "none", "describe"]
YEAR = r"\b((?:19|20)\d{2})\b"

#: The columns that rules read and rewrite.
SLOTS = [
    "utterance_kind", "primitive_hint", "raw_input", *(f"{end}_{c}" for end in ("subject", "object") for c in ("text", "kind", "reference")), "attribute_expression", "relation_expression", "action_expression", "event_expression",
    "change", "condition", "link", "stable", "classification", "measures", "correction", "has_claims", "measure_dimension", "lifecycle", "aspect",
]

Update = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """A condition over a proposal's columns, and the new values of some of them where it holds."""

    name: str
    when: Callable[[], Column]
    to: Callable[[], Update]


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def attribute_slots(expression: Column, **more: Column) -> Update:
    """The slots of a proposal that states or asks an attribute, with those of other primitives cleared."""
    off = F.lit(False)
    slots = {"primitive_hint": F.lit("attribute"), "stable": F.lit(True), "classification": off, "change": off, "condition": off, "link": off, "measures": off, "relation_expression": _null(), "action_expression": _null(), "event_expression": _null()}
    slots["lifecycle"] = F.when(~F.col("lifecycle").isin("start", "end"), F.col("lifecycle"))
    slots["aspect"] = F.when(F.col("aspect") != "happened", F.col("aspect"))
    return slots | {"attribute_expression": expression} | more


def _mention(text: Column, kind: Column, reference: str) -> Update:
    return {"subject_text": text, "subject_kind": kind, "subject_reference": F.lit(reference)}


def _self() -> Update:
    return _mention(F.lit("eu"), F.lit("person"), "contextual")


def _owned(noun: Column) -> Update:
    """The possessed thing as subject; a noun that names a dimension belongs to the speaker."""
    kind = F.coalesce(*[F.when(noun.isin(nouns), F.lit(k)) for k, nouns in NOUN_KINDS.items()])
    own = V.dimension_of(noun).isNotNull()
    return {"subject_text": F.when(own, "eu").otherwise(noun), "subject_kind": F.when(own, "person").otherwise(kind), "subject_reference": F.when(own, "contextual").otherwise(F.lit("possessive"))}


def _dimension(text: Column) -> Column:
    return dimension_in(text, V.flat(V.DIMENSION_ALIASES))


def _registered() -> Column:
    """Whether the attribute expression names a dimension."""
    expression = F.coalesce(F.col("attribute_expression"), F.lit(""))
    return ~F.trim(expression).isin("", SNAPSHOT) & F.col("named_dimension").isNotNull()


def _head(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), rf"(?i)^{ARTICLES}", ""), rf"(?i)^{POSSESSIVES}\s+", ""))
    return F.when(bare == "", text).otherwise(bare)


def _written(dimension: Column, value: Column) -> Column:
    """An attribute expression with a value: a year alone, a colour after its name, else after the dimension's first name."""
    said = F.regexp_replace(value, TRIMMED, "")
    color = F.get(F.filter(F.split(said, r"[^\p{L}\p{N}_\-]+"), lambda w: w.isin(COLORS)), 0)
    first = V.looked_up(dimension, {k: names[0] for k, names in V.DIMENSION_ALIASES.items()})
    return F.when(dimension == "model_year", F.coalesce(_found(said, YEAR), said)).when(dimension == "color", F.concat(F.lit("cor "), F.coalesce(color, said))).otherwise(F.concat_ws(" ", first, said))


def _first_name(dimension: Column) -> Column:
    return F.coalesce(V.looked_up(dimension, {k: names[0] for k, names in V.DIMENSION_ALIASES.items()}), dimension)


def rules() -> list[Rule]:
    """All rules in their order. They read what `repaired` adds: low (the folded utterance without its last signs),
    noun (what is possessed in it), low_dimension and named_dimension (of the utterance and of the attribute expression)."""
    c = F.col
    tells = c("utterance_kind").isin(*TELLS)
    asks = c("utterance_kind") == "query"
    free = ~c("correction") & ~c("has_claims") & (c("low") != "")
    leftovers = c("change") | F.coalesce(c("primitive_hint") == "event", F.lit(False)) | c("action_expression").isNotNull() | c("event_expression").isNotNull() | F.coalesce(c("aspect") == "happened", F.lit(False)) | F.coalesce(c("lifecycle").isin("start", "end"), F.lit(False))
    self_name = F.nullif(F.regexp_replace(_found(c("raw_input"), SELF_NAMED), TRIMMED, ""), F.lit(""))
    attribute_like = c("stable") | c("attribute_expression").isNull() | F.coalesce(fold("attribute_expression").rlike("name|nome"), F.lit(False))
    misparsed = c("subject_text").isNull() | (c("subject_reference") == "contextual") | ((c("subject_reference") == "named") & (normalize(c("subject_text")) == normalize(self_name)))
    noun_dimension = V.dimension_of(c("noun"))
    have = _found(c("low"), HAVES)
    identity = _found(c("low"), IDENTITY)
    owned, rest = _found(c("low"), COPULA), _found(c("low"), COPULA, 2)
    color = F.get(F.filter(F.split(rest, r"[^\p{L}\p{N}_\-]+"), lambda w: w.isin(COLORS)), 0)
    aligned = c("subject_text").isNotNull() & ~c("change") & F.coalesce(c("named_dimension").isNotNull() & (c("low_dimension").isNull() | (c("low_dimension") == c("named_dimension"))), F.lit(False)) & (c("primitive_hint").isNull() | c("primitive_hint").isin("unknown", "attribute")) & asks
    names = "|".join(sorted(V.flat(V.DIMENSION_ALIASES), key=lambda x: (-len(x), x)))
    write = rf"\b({names})\b\s+(?:d[oa]s?\s+)?{POSSESSIVES}\s+([\p{{L}}\p{{N}}_\-]+)\s+(?:e|=|is)\s+(.+)$"
    car, my_car = {**_mention(F.lit("carro"), F.lit("vehicle"), "contextual")}, F.nullif(F.regexp_replace(_found(c("raw_input"), MY_CAR), TRIMMED, ""), F.lit(""))
    one_color = fold(my_car).isin(COLORS)
    no_object: Update = {"object_text": _null(), "object_kind": _null(), "object_reference": _null()}
    possessive_free = free & ~aligned
    likes_text = F.coalesce(fold("raw_input"), F.lit("")).rlike(LIKES) | F.coalesce(fold("relation_expression"), F.lit("")).rlike(LIKES)
    return [
        Rule("slot_align", lambda: F.lit(True), lambda: {f"{s}_text": F.when(c(f"{s}_reference") == "possessive", _head(c(f"{s}_text"))).otherwise(c(f"{s}_text")) for s in ("subject", "object")}),
        Rule(
            "slot_align", lambda: c("utterance_kind").isin("assert", "change", "describe") & ~c("correction") & ~c("measures") & _registered() & leftovers & (c("subject_text").isNotNull() | c("object_text").isNotNull()),
            lambda: attribute_slots(c("attribute_expression"), utterance_kind=F.lit("assert"), subject_text=F.coalesce("subject_text", "object_text"), subject_kind=F.when(c("subject_text").isNull(), c("object_kind")).otherwise(c("subject_kind")), subject_reference=F.when(c("subject_text").isNull(), c("object_reference")).otherwise(c("subject_reference"))),
        ),
        Rule("slot_align", lambda: asks & (c("subject_reference") == "possessive") & _registered(), lambda: attribute_slots(c("attribute_expression"))),
        Rule("slot_align", lambda: asks & (c("subject_reference") == "possessive") & ~_registered() & (c("classification") | F.coalesce(c("primitive_hint") == "type", F.lit(False)) | (F.trim(F.coalesce("attribute_expression", F.lit(""))) != "")), lambda: attribute_slots(F.lit(SNAPSHOT))),
        Rule(
            "self_reference", lambda: c("utterance_kind").isin("assert", "correction", "describe", "change", "none") & ~c("correction") & self_name.isNotNull() & (c("primitive_hint").isNull() | c("primitive_hint").isin("unknown", "attribute", "event")) & attribute_like & misparsed,
            lambda: attribute_slots(F.coalesce("attribute_expression", F.concat(F.lit("name is "), self_name)), utterance_kind=F.lit("assert"), **{k: F.when(F.coalesce(c("subject_reference") == "contextual", F.lit(False)), c(k)).otherwise(v) for k, v in _self().items()}),
        ),
        Rule("name_query", lambda: c("low").rlike(NAME_ASKED) & ~c("low").rlike(NOT_NAME_ASKED), lambda: attribute_slots(F.lit("nome"), utterance_kind=F.lit("query"), **_self())),
        Rule(
            "possessive", lambda: free & have.isNotNull() & V.dimension_of(have).isNull(),
            lambda: {"utterance_kind": F.lit("query"), "primitive_hint": F.lit("relation"), "link": F.lit(True), "stable": F.lit(False), "change": F.lit(False), "relation_expression": F.lit("owns"), "attribute_expression": _null(), "object_text": have, "object_kind": _owned(have)["subject_kind"], "object_reference": F.lit("class"), **_self()},
        ),
        Rule("possessive", lambda: possessive_free & c("noun").isNotNull() & c("low_dimension").isNotNull() & c("asked") & ~c("low").rlike(r"^(19|20)\d{2}$"), lambda: attribute_slots(_first_name(c("low_dimension")), utterance_kind=F.lit("query"), **_owned(c("noun")))),
        Rule("possessive", lambda: possessive_free & ~c("asked") & c("low").rlike(write), lambda: attribute_slots(_written(V.dimension_of(_found(c("low"), write)), _found(c("low"), write, 3)), utterance_kind=F.lit("assert"), **_owned(_found(c("low"), write, 2)))),
        Rule("possessive", lambda: possessive_free & c("noun").isNotNull() & c("low_dimension").isNull() & c("low").rlike(OVERVIEWS) & noun_dimension.isNull(), lambda: attribute_slots(F.lit(SNAPSHOT), utterance_kind=F.lit("query"), **_owned(c("noun")))),
        Rule("possessive", lambda: possessive_free & identity.isNotNull() & c("low_dimension").isNull() & c("named_dimension").isNull(), lambda: attribute_slots(F.lit(SNAPSHOT), utterance_kind=F.lit("query"), **_owned(identity))),
        Rule("possessive", lambda: possessive_free & tells & owned.isNotNull() & V.dimension_of(owned).isNull() & color.isNotNull() & (F.size(F.split(F.trim(rest), r"\s+")) <= 2), lambda: attribute_slots(F.concat(F.lit("cor "), color), utterance_kind=F.lit("assert"), **_owned(owned))),
        Rule("possessive", lambda: possessive_free & tells & owned.isNotNull() & V.dimension_of(owned).isNull() & color.isNull() & _found(rest, YEAR).isNotNull() & F.coalesce(c("low_dimension") == "model_year", F.lit(True)), lambda: attribute_slots(_found(rest, YEAR), utterance_kind=F.lit("assert"), **_owned(owned))),
        Rule("vehicle_attribute", lambda: c("utterance_kind").isin("assert", "correction") & ~c("correction") & ~c("has_claims") & my_car.isNotNull(), lambda: attribute_slots(F.when(one_color, F.concat(F.lit("cor "), fold(my_car))).otherwise(my_car), **car, **no_object)),
        Rule("vehicle_query", lambda: c("low_dimension").isNull() & ~F.coalesce(F.trim("attribute_expression") == SNAPSHOT, F.lit(False)) & ~(c("attribute_expression").isNotNull() & asks) & c("low").rlike(r"\bqual\b") & c("low").rlike(r"\bmeu\s+carro\b"), lambda: attribute_slots(F.lit(SNAPSHOT), utterance_kind=F.lit("query"), **car)),
        Rule(
            "likes_inventory", lambda: asks & ~c("correction") & ~c("measures") & c("measure_dimension").isNull() & ~c("stable") & ~(c("attribute_expression").isNotNull() & F.coalesce(c("primitive_hint") == "attribute", F.lit(False))) & likes_text,
            lambda: {
                "primitive_hint": F.lit("relation"), "link": F.lit(True), "relation_expression": F.coalesce("relation_expression", F.lit("gosto de")),
                **{k: F.when(F.trim(F.coalesce("subject_text", F.lit(""))) == "", v).otherwise(c(k)) for k, v in _self().items()},
                **{k: F.when(~fold("object_text").isin("", *PLACEHOLDERS), c(k)) for k in no_object},
            },
        ),
    ]


def repaired(proposals: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """Proposals after all rules in order, with repairs: the names of those that changed something.

    proposals: utterance_kind, primitive_hint, raw_input, subject_text, subject_kind and subject_reference (and object_...),
    attribute_expression, relation_expression, action_expression, event_expression, change, condition, link, stable,
    classification, measures, correction and has_claims (flags), measure_dimension, lifecycle and aspect. Proposals that say
    the same in all of these are read once; other columns pass.
    """
    said = F.struct(*[c for c in proposals.columns if c in SLOTS])
    different = proposals.select(said.alias("said")).distinct()
    rows = _repaired(different.select("said", "said.*"), rules() if chosen is None else chosen)
    same = [F.col(f"fixed.{c}") if c in SLOTS else F.col(f"given.{c}") for c in proposals.columns]
    return proposals.alias("given").join(rows.alias("fixed"), F.struct(*[F.col(f"given.{c}") for c in proposals.columns if c in SLOTS]) == F.col("fixed.said")).select(*same, "fixed.repairs")


def _repaired(proposals: DataFrame, chosen: list[Rule]) -> DataFrame:
    low = F.trim(F.regexp_replace(fold(F.coalesce("raw_input", F.lit(""))), r"[?!.…]+$", ""))
    rows = proposals.withColumn("low", low)
    rows = rows.withColumns({"asked": F.coalesce(F.trim("raw_input").endswith("?"), F.lit(False)) | F.col("low").rlike(ASKS), "noun": _found(F.col("low"), POSSESSED), "low_dimension": _dimension(F.col("low")), "repairs": F.array().cast("array<string>")})
    for rule in chosen:
        rows = rows.withColumn("named_dimension", _dimension(fold("attribute_expression")))
        rows = rows.withColumn("hit", F.coalesce(rule.when(), F.lit(False)))
        new = {k: F.when(F.col("hit"), v.cast(proposals.schema[k].dataType)).otherwise(F.col(k)) for k, v in rule.to().items()}
        changes = reduce(lambda acc, x: acc | x, [~F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in new])
        rows = rows.withColumns({f"new_{k}": v for k, v in new.items()})
        rows = rows.withColumn("repairs", F.when(changes & ~F.array_contains("repairs", rule.name), F.array_append("repairs", F.lit(rule.name))).otherwise(F.col("repairs")))
        rows = rows.withColumns({k: F.col(f"new_{k}") for k in new}).drop(*[f"new_{k}" for k in new])
    return rows.drop("low", "noun", "asked", "low_dimension", "named_dimension", "hit")
