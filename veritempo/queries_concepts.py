"""Queries of concept resolution: what proposals mean in concepts and typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions import attribute_values
from veritempo.operators import concepts, repairs
from veritempo.registry import query_of_two_users
from veritempo.sources.frames import KnowledgeFrames
from veritempo.storage import checkpoint

#: What is said, for each primitive.
SAID = {
    "event": ["troquei a embreagem do carro", "Troquei o óleo", "trocamos ideia ontem, changed mind", "A instalação do ar foi ontem", "as instalações da empresa são novas", "quebrou hoje", "troquei reais por dólares", "troquei de roupa", "passei no mercado", "consertei a porta", "abriu a loja", "nada disso"],
    "relation": ["trabalha em", "mora em", "é meu", "GOSTA DE", "casada com", "mãe de", "médico", "joga xadrez com", "instalações novas", "", "possui", "123"],
    "state": ["quebrada", "está aberta", "atrasado", "acabou", "desempregado", "funcionando, é nova", "fechada", "não pago", "válido", "vencida", "tranquila", "quebrado e é novo"],
}
CONCEPTS = [
    "relation.employed_by", "relation.resides_at", "relation.owns", "relation.likes", "relation.married_to", "relation.parent_of", "state.operational_condition", "state.openness", "state.due_status", "state.availability", "state.payment_status", "state.validity",
    "state.value.broken", "state.value.open", "state.value.overdue", "state.value.depleted", "state.value.working", "state.value.closed", "state.value.unpaid", "state.value.valid", "action.replace", "action.oil_change", "action.maintain", "event.vehicle_maintenance", "event.maintenance",
]


def _pick(key: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _proposals(f: KnowledgeFrames, primitive: str) -> DataFrame:
    """One proposal for each order: what is said goes round the list, kinds and flags go with the other keys."""
    key = F.col("o_orderkey")
    said = _pick(key, SAID[primitive])
    nothing = F.lit(None).cast("string")
    fields = {c: nothing for c in concepts.EXPRESSIONS} | {c: nothing for c in ("claim_dimension", "claim_text", "claim_number", "claim_unit", "measure_dimension", "measure_number", "measure_unit", "tense")}
    fields |= {f"{'action' if primitive == 'event' else primitive}_expression": said, "raw_input": F.concat(F.lit("Disse: "), said)}
    return f.owned("orders", "o_orderkey").select(
        "user_id", key.alias("proposal_id"), F.lit(primitive).alias("primitive"), *[c.alias(k) for k, c in fields.items()],
        _pick(F.col("o_custkey"), ["person", "thing", None]).alias("subject_kind"), _pick(F.floor(key / 12), ["organization", "person", "place", None]).alias("object_kind"),
        (F.col("o_custkey") % 7 != 2).alias("change"), (F.col("o_custkey") % 7 != 3).alias("condition"), (F.col("o_custkey") % 7 != 4).alias("link"), F.lit(False).alias("stable"), F.lit(False).alias("classification"),
    )


def _resolved(f: KnowledgeFrames, primitive: str, shown: list[str]) -> DataFrame:
    known = f.spark.createDataFrame([(c,) for c in CONCEPTS], "concept string")
    different = checkpoint(concepts.different_proposals(_proposals(f, primitive)))
    rows = concepts.resolve_concepts(different.drop("n"), concepts.alias_frame(f.spark), known).join(different.select("user_id", "proposal_id", "n"), ["user_id", "proposal_id"])
    empty = F.lit("")
    return rows.groupBy("user_id", "surface", "status", *[F.coalesce(c, empty).alias(c) for c in ("sense", "reason", *shown)]).agg(F.sum("n").alias("n"), F.max("proposal_id").alias("last"))


@query_of_two_users
def concepts_of_relations(f):
    return _resolved(f, "relation", ["relation"])


@query_of_two_users
def concepts_of_states(f):
    return _resolved(f, "state", ["dimension", "value"])


@query_of_two_users
def concepts_of_events(f):
    return _resolved(f, "event", ["action", "event_type"])


@query_of_two_users
def attribute_values_stated(f):
    """Texts about parts, put together from what a part has, read again as typed values."""
    key = F.col("p_partkey")
    brand, size, year = _pick(key, ["Honda", "fiat", "Brand#11"]), (F.col("p_size") + 1).cast("string"), (F.lit(1990) + key % 30).cast("string")
    forms = [
        F.concat(F.lit("nome é Peça "), key.cast("string"), F.lit("!")),
        F.concat(F.lit("marca é "), brand),
        F.concat(F.lit("modelo = Civic "), (key % 7).cast("string")),
        F.concat(F.lit("capacidade de "), size, F.lit(",5 litros")),
        F.concat(F.lit("peso "), size, F.lit(" kg")),
        F.concat(F.lit("área de "), size, F.lit(" m²")),
        year,
        F.concat(F.lit("ano era "), year),
        F.concat(F.lit("a cor é "), _pick(key, ["azul", "prata", "verde-água"])),
        F.concat(F.lit("cor: "), _pick(key, ["Verde Água", "cor", "azul"])),
        F.concat(F.lit("altura "), size, F.lit(" metros")),
        F.lit("sem nada"),
    ]
    said = F.coalesce(*[F.when(key % 12 == i, form) for i, form in enumerate(forms)])
    raw = F.when(key % 24 == 23, F.concat(F.lit("Meu carro é um "), brand, F.lit(" Civic")))
    nothing = F.lit(None).cast("string")
    p = {"attribute_expression": F.when(key % 24 != 23, said), "raw_input": raw, "subject_kind": F.lit("vehicle"), "stable": F.lit(True), "classification": key % 29 == 0, "tense": nothing} | {c: nothing for c in ("claim_dimension", "claim_text", "claim_number", "claim_unit")}
    # parts are few bytes in few files, and rules over words take long: dealt anew, so that all cores share them
    rows = f.owned("part", "p_partkey").select("user_id", "p_partkey", "p_brand", "p_size").repartition("user_id", "p_partkey")
    rows = rows.withColumn("pair", attribute_values.brand_and_model(p["attribute_expression"], p["raw_input"], p["subject_kind"]))
    p |= {"pair": F.col("pair")}
    value, others = attribute_values.attribute_value(p), attribute_values.companions(p)
    rows = rows.select("user_id", key.alias("proposal_id"), value.alias("v"), F.array_join(F.transform(others, lambda c: F.concat_ws("=", c["dimension"], c["text"])), " ").alias("companions"), attribute_values.is_current(p).alias("is_current"))
    return rows.select("user_id", "proposal_id", *[F.coalesce(F.col(f"v.{c}"), F.lit("")).alias(c) for c in ("dimension", "kind", "text", "unit")], F.coalesce(F.col("v.number").cast("decimal(18,2)").cast("string"), F.lit("")).alias("number"), F.coalesce(F.col("v.year").cast("string"), F.lit("")).alias("year"), "companions", "is_current")


#: Proposals as an interpreter may get them wrong: utterance, its kind, and the slots that are filled.
MISREAD: list[dict] = [
    {"raw_input": "Meu nome é Ana.", "utterance_kind": "assert", "primitive_hint": "event", "subject_text": "Ana", "subject_reference": "named"},
    {"raw_input": "Qual é o meu nome?", "utterance_kind": "query"},
    {"raw_input": "Qual a cor do meu carro?", "utterance_kind": "query", "primitive_hint": "type", "classification": True},
    {"raw_input": "eu tenho carro", "utterance_kind": "assert", "stable": True},
    {"raw_input": "A cor da minha casa é azul", "utterance_kind": "assert", "action_expression": "pintar", "change": True},
    {"raw_input": "Meu carro é prata", "utterance_kind": "assert", "relation_expression": "ser", "link": True},
    {"raw_input": "Meu carro é um Honda Civic.", "utterance_kind": "assert"},
    {"raw_input": "Qual é o meu carro?", "utterance_kind": "query"},
    {"raw_input": "o que você sabe sobre minha casa?", "utterance_kind": "query"},
    {"raw_input": "do que eu gosto?", "utterance_kind": "query", "object_text": "o que"},
    {"raw_input": "em agosto choveu?", "utterance_kind": "query"},
    {"raw_input": "está azul", "utterance_kind": "assert", "attribute_expression": "cor azul", "action_expression": "pintar", "change": True, "object_text": "minha bicicleta", "object_kind": "vehicle", "object_reference": "possessive"},
    {"raw_input": "trabalho?", "utterance_kind": "query", "classification": True, "subject_text": "meu trabalho", "subject_reference": "possessive"},
    {"raw_input": "Meu nome é Ana.", "utterance_kind": "assert", "correction": True},
    {"raw_input": "Meu carro é prata", "utterance_kind": "assert", "has_claims": True},
    {"raw_input": "nada", "utterance_kind": "assert"},
]
TEXT_SLOTS = ["utterance_kind", "primitive_hint", "raw_input", "subject_text", "subject_kind", "subject_reference", "object_text", "object_kind", "object_reference", "attribute_expression", "relation_expression", "action_expression", "event_expression", "measure_dimension", "lifecycle", "aspect"]
FLAGS = ["change", "condition", "link", "stable", "classification", "measures", "correction", "has_claims"]


@query_of_two_users
def repaired_proposals(f):
    key = F.col("o_orderkey")
    slots = [_pick(key, [m.get(c) for m in MISREAD]).cast("string").alias(c) for c in TEXT_SLOTS]
    flags = [F.element_at(F.array(*[F.lit(m.get(c, False)) for m in MISREAD]), (key % len(MISREAD) + 1).cast("int")).alias(c) for c in FLAGS]
    rows = repairs.repaired(f.owned("orders", "o_orderkey").select("user_id", key.alias("proposal_id"), *slots, *flags))
    shown = ["subject_text", "subject_kind", "subject_reference", "object_text", "attribute_expression", "relation_expression", "action_expression", "primitive_hint"]
    return rows.select("user_id", "proposal_id", "utterance_kind", *[F.coalesce(c, F.lit("")).alias(c) for c in shown], "link", "stable", "change", F.array_join("repairs", " ").alias("repairs"))
