"""Deterministic rules around language: routing, senses, correction guard, cordiality, groundedness, vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions.text import fold, let, normalize

# Patterns over folded text that decide the result.
CORRECTION_STRONG = [
    r"\bcorrigindo\b",
    r"\bcorrecao\b",
    r"\bretificando\b",
    r"\beu me enganei\b",
    r"\bme enganei\b",
    r"\beu errei\b",
    r"\bops errei\b",
    r"\berrei:",
    r"\berrei,",
    r"\berrei —",
    r"\berrei -",
    r"\berrei o (valor|ano|mes|nome)\b",
    r"\bfalei errado\b",
    r"\bdisse errado\b",
    r"\bquis dizer\b",
    r"\beu quis dizer\b",
    r"\bdesconsidere\b",
    r"\bdesconsiderar\b",
]
CORRECTION_REPLACES = [r"\bnao era\b.+\bera\b", r"\bnao foi\b.+\bfoi\b", r"\beri?a(m)?\s+\d", r"\bforam\s+\d", r"\bnao,?\s+falei errado\b"]
CORRECTION_MISREAD = [r"\bli errado\b", r"\bolhei errado\b"]
CORRECTION_WEAK = [r"\bna verdade\b", r"\bao contrario\b", r"\bisso estava errado\b", r"\bestava errado\b", r"\beu estava enganado\b"]
CORRECTION_SHORT = [r"^nao,\s+foi\b", r"^nao,\s+era\b", r"^nao,\s+em\b", r"^foi em\b", r"^era\b"]
TERMINATION_CUES = [r"\bnao\b.+\bmais\b", r"\bnao trabalha mais\b", r"\bnao mora mais\b"]
EVOLUTION_CUES = [r"\bagora\b"]
REPETITION_CUES = [r"\bde novo\b", r"\bnovamente\b"]
OBSERVATION_CUES = [r"\bagora (esta|ta|deu|marcou)\b", r"\bmedi (de )?novo\b"]
PRONOUNS = r"\b(ele|ela|isso|aquilo)\b"
REPORTED_QUESTION = r"\beu disse que\b"
SENSES = {
    "exchange_idea": [r"\btroquei ideia\b", r"\btrocar ideia\b", r"\bexchange idea\b", r"\bchanged mind\b"],
    "currency_exchange": [r"\btroquei reais\b", r"\btrocar reais\b", r"\bpor dolares\b", r"\bcurrency exchange\b"],
    "clothing_change": [r"\btroquei de roupa\b", r"\btrocar de roupa\b", r"\bchanged clothes\b"],
    "property_new": [r"\be nova\b", r"\be novo\b", r"\bsao novas\b", r"\bsao novos\b", r"\bis new\b", r"\bnovas\b", r"\bnovo\b"],
    "ambiguous_pass": [r"\bpassei no\b", r"\bpassei em\b", r"\bpassed by\b"],
}
FACILITIES = [r"\binstalacoes\b", r"\bfacilities\b"]
INSTALLS = [
    r"\binstalacao do\b",
    r"\binstalacao da\b",
    r"\bfez a instalacao\b",
    r"\binstalou\b",
    r"\binstalei\b",
    r"\binstalaram\b",
    r"\binstalar\b",
    r"\binstall(ed)?\b",
    r"\binstalacao\b",
]
REPLACES = [r"\bembreagem\b", r"\boleo\b", r"\bcomponent\b", r"\bpeca\b", r"\bsubstitu", r"\btroquei a\b", r"\btroquei o\b", r"\btrocar a\b", r"\btrocar o\b"]
#: Parts of a state's words that show a sense.
STATE_SENSES = {
    "operational_broken": ["quebrad", "broken", "failed"],
    "openness_open": ["abert", "open"],
    "overdue": ["atrasad", "overdue"],
    "depleted": ["acabou", "depleted", "esgotad"],
}
EMPLOYS, OWNS = ["trabalh", "works at", "employed"], ["possui", "owns", "meu", "mine"]
INSTRUMENTS = ["sensor", "termometro", "balanca", "medidor", "relogio", "termopar"]
INSTRUMENT_ACTIONS = ["mediu", "marcou", "mostrou", "indicou", "leu", "registrou"]
#: The word by which an assistant is addressed is `assistente` here; an application's own name for it goes in its place.
SOCIAL = [
    ("greeting", r"^(bom\s+dia|boa\s+tarde|boa\s+noite)([,\s]+assistente)?\b"),
    ("greeting", r"^(ola|oi|e\s+ai|eae|hey|hi)([,\s]+assistente)?\b"),
    ("farewell", r"^(ate\s+mais|ate\s+logo|ate\s+depois|ate\s+amanha|tchau|falamos\s+depois|flw)([,\s]+assistente)?\b"),
    ("thanks", r"^(muito\s+obrigad[oa]|obrigad[oa]|valeu|agradeco)([,\s]+assistente)?\b"),
    ("wellbeing", r"^(tudo\s+bem|tudo\s+certo(\s+por\s+ai)?|como\s+(voce|vc)\s+esta|como\s+estao\s+as\s+coisas|esta\s+tudo\s+certo(\s+por\s+ai)?)([,\s]+assistente)?\b"),
    ("apology", r"^(desculpa|desculpe|foi\s+mal|perdao)([,\s]+assistente)?\b"),
    ("acknowledgement", r"^(entendi|certo|ok|okay|perfeito|beleza|combinado|show)([,\s]+assistente)?\b"),
    ("small_talk", r"^(que\s+dia\s+bonito|hoje\s+esta\s+corrido|estou\s+cansado(\s+hoje)?)\b"),
]
SOCIAL_EXACT = {
    "greeting": ["bom dia", "boa tarde", "boa noite", "ola", "oi", "e ai", "eae", "hey", "hi"],
    "farewell": ["ate mais", "ate logo", "ate depois", "ate amanha", "tchau", "falamos depois", "flw"],
    "thanks": ["obrigado", "obrigada", "muito obrigado", "muito obrigada", "valeu", "agradeco"],
    "wellbeing": ["tudo bem", "tudo certo", "tudo certo por ai", "como voce esta", "como vc esta", "como estao as coisas", "esta tudo certo por ai"],
    "apology": ["desculpa", "desculpe", "foi mal", "perdao"],
    "acknowledgement": ["entendi", "certo", "ok", "okay", "perfeito", "beleza", "combinado"],
    "small_talk": ["que dia bonito", "hoje esta corrido", "estou cansado", "estou cansado hoje"],
}
NOT_SOCIAL = [r"\b(e uma expressao|significa|usado em|usado no|em portugues)\b", r"\b(me deu|lhe deu|deu bom dia|disse bom dia|falou bom dia)\b"]
NOT_SOCIAL_PAIRS = [
    (r"\b(ontem|anteontem|semana passada)\b", r"\b(bom dia|boa tarde|boa noite|ola|oi)\b"),
    (r"\b(como voce esta|como vc esta|como esta)\b", r"\b(armazen|guard|salv|persist|banco|dados|nome|conhecimento)\b"),
]
TASK_CUES = [r"\?", r"\b(qual|quais|quem|onde|quando|quanto|como|meu|minha|lembre|anote|registre|guarde)\b", r"\b(e|eh|sou|chamo|nome|carro|cor|modelo|marca)\b"]
#: What a presented reply must not say, or must say, by the status of what it presents.
LONGEST_REPLY = 420
INTERNAL_WORDS = r"\b(persistido|persistida|banco de dados|consulta|entidade|materializado|materializada|canonical|registrado|registrada|registro|query|entity)\b"
BARE_NO = r"^\s*(nao|no)\.?\s*$"
SAYS_UNKNOWN = r"\b(ainda nao sei|nao sei|i (do not|don't) know|aun no se|no se)\b"
SAYS_NO = r"\b(voce nao tem|you don't have|you do not have|no tienes|nao, voce nao|pelo que sei,\s*nao)\b"
SAYS_FAILED = r"\b(nao consegui|consultar|agora|indisponivel|couldn't|could not|right now|ahora)\b"
COMMON_WORDS = [
    "a", "ao", "aos", "as", "o", "os", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das", "em", "no", "na", "nos", "nas", "por", "para", "com", "sem", "e", "ou", "que", "se", "seu", "sua", "seus", "suas",
    "meu", "minha", "meus", "minhas", "teu", "tua", "dele", "dela", "deles", "delas", "voce", "voces", "eu", "tu", "ele", "ela", "the", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are",
    "was", "were", "be", "been", "it", "its", "her", "his", "your", "you", "my", "name", "nome", "sim", "nao", "yes", "ainda", "sei", "pelo", "isso", "essa", "esse", "isto", "aqui", "como", "qual", "what",
    "have", "has", "tem", "tenho", "chamada", "chama", "called", "llama", "llamo", "llaman", "color", "cor", "azul", "cat", "gato", "gata", "carro", "car", "bicicleta", "bike", "vou", "lembrar", "entendi",
    "certo", "ok", "bem", "pois", "entao", "ja", "el", "la", "los", "las", "un", "una", "su", "tus", "mi", "mis",
]
INVENTED_WORDS = ["siamesa", "siames", "anos", "years", "year"]


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def holds_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda acc, p: acc | text.contains(p), parts, F.lit(False))


def correction_guard(text: Column, has_prior: Column) -> Column:
    """struct(outcome, reason) of an utterance proposed as a correction, by ordered rules."""
    return let(fold(F.coalesce(text, F.lit(""))), lambda low: _guarded(low, has_prior))


def _guarded(low: Column, has_prior: Column) -> Column:
    meta, replaces, misread, weak = (any_of(low, p) for p in (CORRECTION_STRONG, CORRECTION_REPLACES, CORRECTION_MISREAD, CORRECTION_WEAK))
    strong = meta | replaces | (misread & has_prior)
    asks = low.endswith("?") | (low.rlike(REPORTED_QUESTION) & low.contains("?"))

    def say(outcome: str, reason: str) -> Column:
        return F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))

    return (
        F.when(asks, say("reject", "query_form"))
        .when(~strong & any_of(low, TERMINATION_CUES), say("reject", "termination_cue"))
        .when(~strong & any_of(low, REPETITION_CUES), say("reject", "repetition_cue"))
        .when(~strong & any_of(low, EVOLUTION_CUES) & ~weak, say("reject", "evolution_cue"))
        .when(~strong & any_of(low, OBSERVATION_CUES), say("reject", "new_observation_cue"))
        .when(meta | replaces, say("accept", "supported"))
        .when(misread & ~has_prior, say("clarify", "context_required"))
        .when(misread, say("accept", "supported"))
        .when(has_prior & any_of(low, CORRECTION_SHORT), say("accept", "supported"))
        .when(weak & has_prior & low.rlike(PRONOUNS), say("clarify", "target_ambiguous"))
        .when(weak & has_prior, say("accept", "supported"))
        .otherwise(say("reject", "signal_insufficient"))
    )


def senses(p: dict[str, Column]) -> Column:
    """Sorted array of the senses that a proposal shows.

    p: text (all its expressions), change, link, relation (its expression), subject_kind, object_kind, condition, state
    (its expression), stable and classification.
    """
    folded = F.struct(fold(p["text"]).alias("low"), fold(F.coalesce(p["relation"], F.lit(""))).alias("relation"), fold(F.coalesce(p["state"], F.lit(""))).alias("state"))
    return let(folded, lambda x: _senses(p, x["low"], x["relation"], x["state"]))


def _senses(p: dict[str, Column], low: Column, relation: Column, state: Column) -> Column:
    facilities, new = any_of(low, FACILITIES), any_of(low, SENSES["property_new"])
    found = [F.when(facilities, "facilities").when(any_of(low, INSTALLS), "install"), F.when(any_of(low, REPLACES) & p["change"], "replace_physical")]
    found += [F.when(any_of(low, patterns), sense) for sense, patterns in SENSES.items()]
    works = holds_any(relation, EMPLOYS) & (F.coalesce(p["subject_kind"], F.lit("")) == "person") & (F.coalesce(p["object_kind"], F.lit("")) == "organization")
    found.append(F.when(p["link"] & (relation != "") & works, "employment"))
    found += [F.when(p["condition"] & holds_any(state, parts), sense) for sense, parts in STATE_SENSES.items()]
    found.append(F.when((p["stable"] | new) & (facilities | low.contains("nov")), "property_new"))
    found += [F.when(p["link"] & holds_any(relation, OWNS), "ownership"), F.when(p["classification"], "classification")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def measurement_evidence(p: dict[str, Column]) -> Column:
    """Whether a proposal states a quantity: by its own flag, or by a hint with an expression, dimension or number.

    p: measures (flag), hint, measure_expression, measure_dimension, measure_number.
    """
    given = p["measure_expression"].isNotNull() | p["measure_dimension"].isNotNull() | p["measure_number"].isNotNull()
    return p["measures"] | ((p["hint"] == "measurement") & given)


def instrument_reading(p: dict[str, Column]) -> Column:
    """Whether an instrument reports a reading, which is no occurrence of its own.

    p: those of `measurement_evidence`, and change, lifecycle, subject, action_text, event_text, has_object.
    """
    measured = measurement_evidence(p)
    instrument = let(fold(F.coalesce(p["subject"], F.lit(""))), lambda subject: holds_any(subject, INSTRUMENTS))
    reports = let(fold(F.coalesce(p["action_text"], F.lit(""))), lambda action: (action == "") | action.isin(INSTRUMENT_ACTIONS) | action.startswith("medi"))
    shape = (reports & ~p["has_object"]) | ((p["hint"] == "measurement") & p["event_text"].isNull())
    return ~p["change"] & ~p["lifecycle"].isin("start", "end") & measured & instrument & shape


def occurrence_evidence(p: dict[str, Column]) -> Column:
    """Whether a proposal states that something happened. p: those of `instrument_reading`, and link, relation_text."""
    acts = p["action_text"].isNotNull() | p["event_text"].isNotNull()
    only_link = p["link"] & p["relation_text"].isNotNull() & ~acts
    return ~instrument_reading(p) & (p["change"] | F.when(p["lifecycle"].isin("start", "end"), ~only_link).otherwise(acts))


def assertions(p: dict[str, Column], primary: Column) -> Column:
    """The primitives that a proposal asserts: its primary one, and a measurement beside it where it states a quantity."""
    both = occurrence_evidence(p) & measurement_evidence(p)
    alone = F.array(primary)
    told = F.when(both, F.array(F.lit("event"), F.lit("measurement"))).when(measurement_evidence(p) & (primary != "measurement"), F.array(primary, F.lit("measurement"))).otherwise(alone)
    return F.when(p["utterance_kind"] == "query", alone).otherwise(told)


def route(p: dict[str, Column]) -> Column:
    """The primitive of a proposal, by ordered rules over its columns.

    p: utterance_kind, link, relation, classification, measurement (its evidence), occurrence (its evidence), reading (an
    instrument's), attribute_claim, stable, attribute, condition, state, change, lifecycle, aspect, action (an action or
    event expression), hint; flags are booleans.
    """
    link = p["link"] | p["relation"]
    stable = p["stable"] | (p["attribute"] & ~p["condition"])
    query = (
        F.when(link, "relation").when(p["classification"], "type").when(p["measurement"], "measurement")
        .when(stable | p["attribute_claim"], "attribute").when(p["condition"] | p["state"], "state").otherwise("event")
    )
    happened = (p["aspect"] == "happened") & p["action"]
    ends = p["lifecycle"].isin("start", "end")
    told = (
        F.when(p["occurrence"] & p["measurement"], "event")
        .when((p["change"] | ends) & p["link"] & p["relation"] & ~p["change"] & ~p["action"], "relation")
        .when(p["change"] | ends, "event")
        .when(happened & ~p["reading"], "event")
        .when(link, "relation")
        .when(p["classification"], "type")
        .when(p["stable"] | (p["attribute"] & ~p["condition"] & ~p["measurement"]), "attribute")
        .when(p["measurement"], "measurement")
        .when((p["condition"] | (p["aspect"] == "ongoing")) & p["attribute"] & ~p["state"], "attribute")
        .when(p["condition"] | (p["aspect"] == "ongoing"), "state")
        .when(p["action"] & ~p["reading"], "event")
        .when(p["state"], "state")
        .when(p["hint"].isin("event", "relation", "type", "attribute", "measurement", "state"), p["hint"])
        .otherwise("unknown")
    )
    return F.when(p["utterance_kind"] == "query", query).otherwise(told)


def social(text: Column) -> Column:
    """struct(intent, task): the cordial opening of a message and what is left of it, folded; none where there is no opening.

    Talk about greetings is no greeting. A rest that is cordial too, or none, leaves no task; a rest of four words or
    more without a cue of a task is a statement, and the whole message stays.
    """

    def bare(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"[!?.…]+$", ""), r"[,\s]+assistente\.?$", ""))

    def exact(c: Column) -> Column:
        return F.coalesce(*[F.when(c.isin(words), intent) for intent, words in SOCIAL_EXACT.items()])

    def opened(low: Column) -> Column:
        rest = F.coalesce(*[F.when(low.rlike(pattern), F.regexp_replace(low, pattern, "")) for _, pattern in SOCIAL])
        opening = F.coalesce(*[F.when(low.rlike(pattern), intent) for intent, pattern in SOCIAL])
        veto = any_of(low, NOT_SOCIAL) | reduce(lambda acc, x: acc | (low.rlike(x[0]) & low.rlike(x[1])), NOT_SOCIAL_PAIRS, F.lit(False))
        return F.struct(low.alias("low"), opening.alias("opening"), F.trim(F.regexp_replace(rest, r"^[,.;:\-\s]+", "")).alias("rest"), veto.alias("veto"))

    def judged(o: Column) -> Column:
        low, opening, rest = o["low"], o["opening"], o["rest"]
        also, alone = let(bare(rest), exact), let(bare(low), exact)
        said = F.when((opening == "acknowledgement") & (rest == "") & low.rlike(r"\b(obrigad[oa]|valeu|agradeco)\b"), "thanks").when(also == "thanks", "thanks").otherwise(opening)
        statement = (rest != "") & also.isNull() & ~any_of(rest, TASK_CUES) & (F.size(F.split(rest, r"\s+")) >= 4)
        none = F.struct(F.lit("none").alias("intent"), low.alias("task"))
        task = F.regexp_replace(rest, r"^[,.;:!?\-\s]+|[,.;:!?\-\s]+$", "")
        found = F.struct(said.alias("intent"), F.when(also.isNotNull(), "").otherwise(task).alias("task"))
        whole = F.struct(alone.alias("intent"), F.lit("").alias("task"))
        return F.when((low == "") | o["veto"], none).when(opening.isNotNull() & ~statement, found).when(opening.isNull() & alone.isNotNull(), whole).otherwise(none)

    plain = F.regexp_replace(F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"\s+", " ")), r"[!?.…]+$", "")
    return let(let(plain, opened), judged)


def words_of(text: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def unattested(reply: Column, sources: list[Column], shortest: int = 4) -> Column:
    """Words of a reply, of some length, that no source has and that are not common; numbers of that length always count.

    The sources' words are made once for each reply and taken away as a set, not once for each of its words.
    """
    known = F.concat(*[words_of(s) for s in sources], F.array(*map(F.lit, COMMON_WORDS)))
    long = F.filter(words_of(reply), lambda w: F.length(w) >= shortest)
    return let(long, lambda words: F.array_sort(F.array_union(F.filter(words, lambda w: w.rlike("^[0-9]+$")), F.array_except(words, known))))


def presenter_fault(reply: Column, p: dict[str, Column]) -> Column:
    """Why a reply must be discarded, or null.

    p: status, kind, relation_answer, technical (a question about the system), values, entities and candidates (arrays),
    and sources, a list of all columns whose words a reply may use.
    """
    said, status = F.trim(F.coalesce(reply, F.lit(""))), p["status"]
    low = fold(said)
    held = F.filter(p["values"], lambda v: ~F.lower(F.trim(v)).isin("yes", "no", "unknown", "true", "false"))
    names = F.filter(p["entities"], lambda v: F.trim(v) != "")
    listed = F.when(p["kind"].isin("measurement", "attribute", "state", "intrinsic_property"), F.array_union(names, held)).when(F.size(names) > 0, names).otherwise(held)
    required = F.when(status.isin("no_results", "unknown", "error", "unsupported", "insufficient"), F.array().cast("array<string>")).when(status == "needs_clarification", p["candidates"]).otherwise(listed)
    unknown, no, bare, failed = low.rlike(SAYS_UNKNOWN), low.rlike(SAYS_NO), low.rlike(BARE_NO), low.rlike(SAYS_FAILED)
    extra = unattested(said, p["sources"])
    all_extra = let(extra, lambda words: F.size(F.filter(words_of(said), lambda w: F.array_contains(words, w))))
    return (
        F.when(said == "", "empty")
        .when(F.length(said) > LONGEST_REPLY, "too_long")
        .when(said.startswith("{") | said.startswith("```"), "malformed")
        .when(~p["technical"] & low.rlike(INTERNAL_WORDS), "implementation_term")
        .when(F.exists(required, lambda v: ~F.contains(low, fold(v))), "missing_value")
        .when((status == "no_results") & (bare | (no & ~unknown)), "no_results_as_false")
        .when((status == "no_results") & ~unknown, "no_results_missing_unknown")
        .when((status == "answered") & ~p["relation_answer"] & unknown & ((~no & ~bare) | low.contains("ainda")), "false_as_unknown")
        .when((status == "error") & unknown & ~failed, "error_as_unknown")
        .when((status == "error") & ~failed, "error_not_failure")
        .when(status.isin("answered", "committed", "no_results", "needs_clarification") & (all_extra >= 3), "unattested_facts")
        .when((status == "answered") & F.exists(extra, lambda w: w.rlike("^[0-9]+$") | w.isin(INVENTED_WORDS)), "unattested_facts")
    )


#: Names of dimensions in replies.
DIMENSION_NAMES = {"weight": "peso", "mass": "peso", "height": "altura", "temperature": "temperatura", "length": "comprimento"}


def fallback_text(p: dict[str, Column]) -> Column:
    """The plain reply for a structured result, or null. p: status, kind, name, dimension, value, unit, candidates, relation_answer, operation."""
    status, kind, name, value = p["status"], F.coalesce(p["kind"], F.lit("")), p["name"], p["value"]
    dimension = F.lower(F.coalesce(p["dimension"], F.lit("")))
    spoken = F.create_map(*[F.lit(x) for pair in DIMENSION_NAMES.items() for x in pair])[dimension]
    unit = F.when(F.coalesce(p["unit"], F.lit("")) != "", F.concat(F.lit(" "), p["unit"])).otherwise("")
    amount, named = F.concat(value, unit), name.isNotNull()
    measured = (kind == "measurement") | dimension.isin("weight", "height", "temperature", "mass")
    return (
        F.when(status == "error", "Não consegui consultar isso agora.")
        .when(status == "committed", "Entendi.")
        .when(status == "partial", "Entendi parte disso, mas não consegui guardar tudo.")
        .when(status.isin("deferred", "unsupported") & (p["operation"] == "knowledge_write"), "Entendi o que você quis dizer, mas ainda não consigo guardar essa informação corretamente.")
        .when((status == "no_results") | (kind == "absence"), F.when(named & spoken.isNotNull(), F.format_string("Ainda não sei a %s da %s.", spoken, name)).when(named, F.format_string("Ainda não sei isso sobre %s.", name)).otherwise("Ainda não sei isso."))
        .when((status == "needs_clarification") & (F.size(p["candidates"]) > 0), F.format_string("Você está falando da %s?", F.array_join(p["candidates"], " ou ")))
        .when(status == "unsupported", "Não consegui interpretar isso com segurança.")
        .when(status == "insufficient", "Preciso de um pouco mais de detalhe para responder.")
        .when(p["relation_answer"], "Sim.")
        .when(~p["relation_answer"], "Pelo que sei, não.")
        .when(measured & value.isNull(), F.lit(None).cast("string"))
        .when(measured & named & dimension.isin("weight", "mass", "peso"), F.format_string("A %s pesa %s.", name, amount))
        .when(measured & named & dimension.isin("temperature", "temperatura"), F.format_string("A %s está a %s.", name, amount))
        .when(measured & named, F.format_string("%s: %s.", name, amount))
        .when(measured, F.concat(amount, F.lit(".")))
        .when(kind.isin("attribute", "intrinsic_property", "state") & value.isNotNull() & named & (F.lower(value) != F.lower(name)), F.format_string("%s: %s.", name, value))
        .when((kind.isin("attribute", "intrinsic_property", "state") | (status == "answered")) & value.isNotNull(), F.concat(value, F.lit(".")))
    )


def alias_matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per text the best alias inside it: text_id, alias, concept. aliases: alias, concept, priority.

    A text's runs of as many words as some alias has meet the aliases by equality, so no text is carried to a join.
    """
    keyed = aliases.withColumn("needle", normalize("alias")).where("needle != ''")
    lengths = keyed.agg(F.collect_set(F.size(F.split("needle", " "))).alias("lengths"))  # one row of a few whole numbers

    def runs(words: Column):
        def of(n: Column) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
            return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<string>"))

        return of

    said = texts.select("text_id", normalize("text").alias("low")).crossJoin(lengths)
    every = let(F.split("low", " "), lambda words: F.array_distinct(F.flatten(F.transform("lengths", runs(words)))))
    hits = said.select("text_id", F.explode(every).alias("needle")).join(keyed, "needle")
    order = Window.partitionBy("text_id").orderBy(F.desc("priority"), F.desc(F.length("needle")), "needle", "concept")
    return hits.withColumn("n", F.row_number().over(order)).where("n = 1").select("text_id", "alias", "concept")


def projected(status: Column, value: Column, values: Column) -> Column:
    """struct(status, kind): how an answer is shown, in fixed precedence."""
    kind = F.when(status.isin("unknown", "temporally_unknown"), "unknown").when(F.size(values) > 1, "list").when(value.isNotNull(), "value").otherwise("empty")
    return F.struct(status.alias("status"), kind.alias("kind"))
