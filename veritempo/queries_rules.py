"""Queries of the rules over texts and proposals, on texts put together from parts so that rules meet each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritempo.functions import text as X
from veritempo.functions import vocabulary as V
from veritempo.operators import interpret, proposals
from veritempo.registry import query

# Parts of texts; the SQL puts the same together.
GUARD_PARTS = (
    ["Corrigindo:", "Não,", "Na verdade", "Agora", "Eu disse que", "Li errado,", "Errei o valor,", "", "Ele", "Medi de novo:", "Foram 12 e"],
    ["foi em 2025", "não mora mais aqui", "isso estava errado", "não era dez, era doze", "está aberto", "de novo", "bom", "em março"],
    [".", "?", "! Não.", "? Não.", " — quis dizer ontem"],
)
SENSE_PARTS = (
    ["Fez a", "As", "Troquei o", "troquei ideia com", "Passei no", "A peça", "O componente", "Instalou", "Troquei"],
    ["instalação do", "instalações", "óleo", "embreagem", "reais por dólares", "de roupa", "porta"],
    ["é nova", "são novos", "quebrado", "ontem", "no facilities center", "renovado"],
)
RELATION_PARTS = ["trabalha na", "works at", "possui", "é meu", "mora em", ""]
STATE_PARTS = ["quebrado", "aberta", "atrasada desde ontem", "acabou", "Broken and open", "novo", ""]
SOCIAL_PARTS = (
    ["Oi", "Bom dia", "Olá, assistente", "Obrigado", "Ok", "Quanto", "Tudo bem", "Que dia bonito", "Até logo", "Ele disse bom dia", "Foi mal"],
    ["!", ",", ".", " ", " ontem,"],
    ["obrigada", "qual é a cor do carro?", "o rato roeu a roupa", "tudo bem?", "valeu", "registre 10 kg", "", "a reunião foi adiada", "como você está, o banco guarda dados?"],
)
REPLY_PARTS = (
    ["Ainda não sei", "Não", "Você não tem", "Sim", "Não consegui consultar", "O registro diz", "{", "Pelo que sei, não", "A siamesa tem"],
    [" isso.", " 1234 anos.", " agora.", ", {name}.", " {name}: {value}.", " palavra inventada totalmente nova.", ""],
)
MEASURE_PARTS = (["era", "última leitura do", "quais foram os", "quanto tem de", "agora", "quanto", "qual é o", "já esteve em"], ["10 kg", "peso", "valores", "som em 2020", "está"])
ATTRIBUTE_PARTS = (["já foi", "era", "qual a cor", "como", "azul", "was it"], ["azul", "azul em 2020", "?", "in 1999"])


def _picked(key: Column, parts: list[str], step: int = 1) -> Column:
    """The part that a key names, counted on after `step` keys."""
    return F.element_at(F.array(*map(F.lit, parts)), (F.floor(key / step) % len(parts) + 1).cast("int"))


def said(key: Column, parts: tuple[list[str], ...], between: str = " ") -> Column:
    """A text of one part of each list; keys one after another run through all combinations."""
    step, chosen = 1, []
    for p in parts:
        chosen.append(_picked(key, p, step))
        step *= len(p)
    return F.concat_ws(between, *chosen) if between else F.concat(*chosen)


def _number(f):
    """Orders with a number from their key that runs without gaps in small residues."""
    return f.table("orders").withColumn("k", F.col("o_orderkey") * 7 + F.col("o_custkey"))


@query
def correction_guard(f):
    rows = _number(f).select(interpret.correction_guard(said(F.col("k"), GUARD_PARTS), F.col("o_custkey") % 2 == 0).alias("g"))
    return rows.groupBy(F.col("g.outcome").alias("outcome"), F.col("g.reason").alias("reason")).agg(F.count("*").alias("n"))


def _sense_columns(k: Column) -> dict[str, Column]:
    return {
        "text": said(k, SENSE_PARTS), "change": k % 2 == 0, "link": k % 3 == 0, "relation": _picked(k, RELATION_PARTS, 2), "subject_kind": F.when(k % 4 != 0, "person"), "object_kind": F.when(k % 5 < 3, "organization").otherwise("place"),
        "condition": k % 3 != 1, "state": _picked(k, STATE_PARTS, 3), "stable": k % 7 == 0, "classification": k % 11 == 0,
    }


@query
def sense_recognition(f):
    rows = _number(f).select(F.explode(interpret.senses(_sense_columns(F.col("k")))).alias("sense"))
    return rows.groupBy("sense").agg(F.count("*").alias("n"))


@query
def canonical_gate(f):
    """Canonical keys against the senses of real texts."""
    k = F.col("k")
    name = _picked(k, sorted(proposals.GATES))
    return _number(f).groupBy(name.alias("key"), proposals.gate(name, interpret.senses(_sense_columns(k))).alias("why")).agg(F.count("*").alias("n"))


@query
def social_opening(f):
    found = interpret.social(said(F.col("k"), SOCIAL_PARTS, ""))
    return _number(f).select(found.alias("s")).groupBy("s.intent", "s.task").agg(F.count("*").alias("n"))


@query
def groundedness_check(f):
    """Assistants' turns against the users' turns before them, whole texts on both sides."""
    turns = f.table("conversations").select("conv_id", "turn", "role", "text")
    reply = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("reply"))
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    rows = reply.join(asked, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", (F.length(F.trim("reply")) > interpret.LONGEST_REPLY).alias("too_long"), F.size(interpret.unattested(F.col("reply"), [F.col("question")])).alias("n_unattested"))


def _presented(f):
    k = F.col("k")
    name, value = F.col("c_name"), F.col("c_mktsegment")
    reply = F.replace(F.replace(said(k, REPLY_PARTS, ""), F.lit("{name}"), name), F.lit("{value}"), value)
    status = _picked(k, ["answered", "no_results", "error", "needs_clarification", "committed"], 2)
    rows = f.table("customer").withColumn("k", F.col("c_custkey") * 3 + F.col("c_nationkey"))
    none = F.array().cast("array<string>")
    return rows.select(
        "c_custkey", "k", reply.alias("reply"), status.alias("status"), F.when(k % 4 == 0, "attribute").when(k % 4 == 1, "relation").alias("kind"), F.when(k % 3 == 0, k % 2 == 0).alias("relation_answer"), (k % 6 == 0).alias("technical"),
        F.when(k % 5 == 0, F.array(value, F.lit("yes"))).otherwise(none).alias("values"), F.when(k % 7 == 0, F.array(name)).otherwise(none).alias("entities"), F.array(name, value).alias("candidates"), value.alias("question"), name.alias("name"),
    )


@query
def presenter_guard(f):
    names = ["status", "kind", "relation_answer", "technical", "values", "entities", "candidates"]
    p = {n: F.col(n) for n in names} | {"sources": [F.col("question"), F.col("status"), F.array_join("values", " "), F.array_join("entities", " "), F.array_join("candidates", " ")]}
    return _presented(f).groupBy("status", interpret.presenter_fault(F.col("reply"), p).alias("fault")).agg(F.count("*").alias("n"))


@query
def fallback_replies(f):
    k = F.col("k")
    status = _picked(k, ["answered", "no_results", "needs_clarification", "deferred", "unsupported", "partial", "error"])
    p = {
        "status": status, "kind": F.when(k % 3 == 0, "attribute").when(k % 3 == 1, "measurement"), "name": F.when(k % 4 != 0, F.col("name")), "dimension": F.when(k % 5 == 0, "weight").when(k % 5 == 1, "temperature"), "value": F.when(k % 6 != 0, F.col("question")),
        "unit": F.when(k % 2 == 0, "kg"), "candidates": F.col("candidates"), "relation_answer": F.when(k % 8 == 0, k % 16 == 0), "operation": F.when(k % 2 == 1, "knowledge_write"),
    }
    return _presented(f).select("c_custkey", F.coalesce(interpret.fallback_text(p), F.lit("")).alias("reply"))


def _evidence(k: Column) -> dict[str, Column]:
    return {
        "utterance_kind": F.when(k % 13 == 0, "query").otherwise("assertion"), "measures": k % 3 == 0, "hint": F.when(k % 4 == 0, "measurement").when(k % 4 == 1, "state").otherwise("unknown"), "measure_expression": F.when(k % 8 == 0, "kg"), "measure_dimension": F.lit(None).cast("string"), "measure_number": F.when(k % 5 == 0, "10"),
        "change": k % 7 == 0, "lifecycle": F.when(k % 11 == 0, "start").otherwise("none"), "subject": _picked(k, ["O termômetro da sala", "Maria", "a balança", None, "Meu relógio"], 2), "action_text": _picked(k, ["mediu", "medi", "comprou", None, "Marcou"], 3),
        "event_text": F.when(k % 6 == 0, "visita"), "has_object": k % 2 == 0, "link": k % 9 == 0, "relation_text": F.when(k % 18 == 0, "mora em"), "aspect": F.when(k % 2 == 1, "happened").when(k % 10 == 0, "ongoing").otherwise("none"),
        "classification": k % 17 == 0, "attribute_claim": k % 26 == 0, "stable": k % 19 == 0, "attribute": k % 4 == 3, "condition": k % 6 == 1, "state": k % 23 == 0,
    }


def _routed(p: dict[str, Column]) -> Column:
    acts = p["action_text"].isNotNull() | p["event_text"].isNotNull()
    return interpret.route(p | {"relation": p["relation_text"].isNotNull(), "measurement": interpret.measurement_evidence(p), "occurrence": interpret.occurrence_evidence(p), "reading": interpret.instrument_reading(p), "action": acts})


def _lines(f):
    return f.table("lineitem").withColumn("k", F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_partkey"))


def _different_evidence(f):
    """Each different evidence of the lines once, as columns, with the number of its lines: rules run on these only."""
    p = _evidence(F.col("k"))
    rows = _lines(f).select(*[c.alias(n) for n, c in p.items()])
    return rows.groupBy(*p).agg(F.count("*").alias("n_lines")), {n: F.col(n) for n in p}


@query
def primitive_routing(f):
    """Evidence is worked out once for each different proposal, then the route; what it is in the graph only for each route."""
    rows, p = _different_evidence(f)
    rows = rows.withColumns({"is_measured": interpret.measurement_evidence(p), "is_occurrence": interpret.occurrence_evidence(p), "is_reading": interpret.instrument_reading(p)})
    acts = p["action_text"].isNotNull() | p["event_text"].isNotNull()
    route = interpret.route(p | {"relation": p["relation_text"].isNotNull(), "measurement": F.col("is_measured"), "occurrence": F.col("is_occurrence"), "reading": F.col("is_reading"), "action": acts})
    found = rows.groupBy(route.alias("primitive")).agg(F.sum("n_lines").alias("n"))
    return found.select("primitive", V.graph_primitive(F.col("primitive"), routed=True).alias("graph"), "n")


@query
def assertion_collection(f):
    rows, p = _different_evidence(f)
    rows = rows.select("n_lines", F.posexplode(interpret.assertions(p, _routed(p))).alias("position", "primitive"))
    return rows.groupBy("primitive", "position").agg(F.sum("n_lines").alias("n"))


@query
def evidence_flags(f):
    rows, p = _different_evidence(f)
    flags = [interpret.measurement_evidence(p).alias("measurement"), interpret.instrument_reading(p).alias("reading"), interpret.occurrence_evidence(p).alias("occurrence")]
    return rows.groupBy(*flags).agg(F.sum("n_lines").alias("n"))


@query
def measurement_query_mode(f):
    k = F.col("k")
    mode = proposals.measurement_mode(said(k, MEASURE_PARTS), k % 5 != 0, k % 7 == 0)
    return _number(f).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query
def attribute_query_mode(f):
    k = F.col("k")
    mode = proposals.attribute_mode(said(k, ATTRIBUTE_PARTS), F.when(k % 11 == 0, "first").otherwise("none"), k % 3 == 0, k % 5 == 0)
    return _number(f).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


# Vocabularies -------------------------------------------------------------------------------------------------------

ALIAS_SAID = ["Cor", "peso", "  Ano do carro", "PRESSÃO, na sala", "temp externa", "altura", "sabor", "gênero", "saldo hoje", "m²"]
PREDICATES = ["trabalha em", "Mora em", "owns", "relation.likes", "child of", "é amiga de", "parent", "employed_by", "42 vezes", "?!", "married to"]
CLASS_HINTS = ["car", "Person", "company", "Cardiologist clinic", "thing", "unknown", "12 monkeys", "", "location"]


@query
def vocabulary_lookups(f):
    k = F.col("k")
    answer, predicate, hint = _picked(k, ALIAS_SAID), _picked(k, PREDICATES), _picked(k, CLASS_HINTS)
    key = V.relation_key(predicate)
    rows = _number(f).select(answer.alias("answer"), V.dimension_of(answer).alias("dimension"), V.measure_dimension_of(answer).alias("measure"), predicate.alias("predicate"), key.alias("relation"), V.stored_relation(key).alias("s"), hint.alias("hint"), V.entity_type_of(hint).alias("type_key"))
    return rows.groupBy("answer", "dimension", "measure", "predicate", "relation", F.col("s.key").alias("stored"), F.col("s.swapped").alias("swapped"), "hint", "type_key").agg(F.count("*").alias("n"))


@query
def stated_measurements(f):
    k = F.col("event_id")
    v = V.measurement_value(F.when(k % 9 == 0, " KG ").when(k % 9 != 1, F.col("event_type")), F.when(k % 7 == 0, "many").when(k % 7 != 1, F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))), F.when(k % 3 == 0, "kg"), F.when(k % 4 == 0, "brl"))
    return f.table("events").select("event_id", v.alias("v")).select("event_id", "v.dimension", F.col("v.number").cast("decimal(18,2)").alias("number"), "v.unit", "v.currency", "v.error")


@query
def display_values(f):
    a = f.attribute
    shown = V.display_value(F.col("text_value"), F.col("numeric_value"), F.col("unit"), F.when(F.col("is_current"), F.year("temporal.date")), F.col("temporal.date"))
    return a.select("attribute_id", shown.alias("shown"), V.brand_like(F.when(F.col("dimension") == "brand", F.concat(F.lit(" "), F.upper("text_value"), F.lit(" "))), ["brand#11", "brand#23"]).alias("brand"), X.model_like(F.when(F.col("dimension") == "type", F.col("text_value"))).alias("model"))


@query
def value_round_trip(f):
    """Values encoded and decoded again."""
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, F.col("props")).when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.when(k % 2 == 0, "true").otherwise("False")).when(k % 5 == 3, F.concat(F.lit('{"amount": "'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit('", "currency": "BRL"}'))).otherwise(F.concat(F.lit('{"entity_id": "e:'), k.cast("string"), F.lit('"}')))
    v = X.encode_value(raw)
    rows = f.table("events").select("event_id", V.decoded(v["kind"], v["value"]).alias("d"))
    return rows.select("event_id", F.col("d.number").cast("decimal(18,2)").alias("number"), F.col("d.flag").cast("string").alias("flag"), F.col("d.amount").cast("decimal(18,2)").alias("amount"), "d.currency", "d.reference", "d.text")
