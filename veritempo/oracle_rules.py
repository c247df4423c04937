"""SQL of the rules over texts and proposals: every rule is evaluated again, on the same texts put together in SQL."""

from __future__ import annotations

import re

from veritempo.functions import vocabulary as V
from veritempo.operators import interpret as I
from veritempo.operators import proposals as P
from veritempo.oracle import _ATTRIBUTE, _fold, _slug, _with
from veritempo.queries_rules import ALIAS_SAID, ATTRIBUTE_PARTS, CLASS_HINTS, GUARD_PARTS, MEASURE_PARTS, PREDICATES, RELATION_PARTS, REPLY_PARTS, SENSE_PARTS, SOCIAL_PARTS, STATE_PARTS


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values: list) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _pick(parts: list, step: int = 1) -> str:
    return f"{_list(parts)}[k // {step} % {len(parts)} + 1]"


def _said(parts: tuple[list[str], ...], between: str = " ") -> str:
    step, chosen = 1, []
    for p in parts:
        chosen.append(_pick(p, step))
        step *= len(p)
    return f" || {_text(between)} || ".join(chosen) if between else " || ".join(chosen)


def _cue(pattern: str) -> str:
    """A cue with word edges that know letters with marks, which DuckDB's \\b does not."""
    opened = re.sub(r"(^|\|)\\b", r"\1(?:^|[^\\p{L}\\p{N}_])", pattern)
    return _text(opened.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])"))


def _any(column: str, patterns: list[str]) -> str:
    return f"regexp_matches({column}, {_text('|'.join(f'(?:{p})' for p in patterns))})"


def _holds(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_text(p)})" for p in parts) + ")"


def _one_of(column: str, values: list[str]) -> str:
    return f"list_contains({_list(values)}, {column})"


_ORDERS = "n AS (SELECT *, o_orderkey * 7 + o_custkey AS k FROM orders)"
_LINES = "n AS (SELECT *, l_orderkey * 7 + l_linenumber * 3 + l_partkey AS k FROM lineitem)"

_SENSED = f"""
said AS (SELECT *, {_fold(_said(SENSE_PARTS))} AS t, {_fold(_pick(RELATION_PARTS, 2))} AS rel, {_fold(_pick(STATE_PARTS, 3))} AS st FROM n),
sensed AS (SELECT *, list_filter([CASE WHEN {_any("t", I.FACILITIES)} THEN 'facilities' WHEN {_any("t", I.INSTALLS)} THEN 'install' END,
    CASE WHEN {_any("t", I.REPLACES)} AND k % 2 = 0 THEN 'replace_physical' END,
    {", ".join(f"CASE WHEN {_any('t', patterns)} THEN '{sense}' END" for sense, patterns in I.SENSES.items() if sense != "property_new")},
    CASE WHEN {_any("t", I.SENSES["property_new"])} OR (k % 7 = 0 AND ({_any("t", I.FACILITIES)} OR contains(t, 'nov'))) THEN 'property_new' END,
    CASE WHEN k % 3 = 0 AND {_holds("rel", I.EMPLOYS)} AND k % 4 != 0 AND k % 5 < 3 THEN 'employment' END,
    {", ".join(f"CASE WHEN k % 3 != 1 AND {_holds('st', parts)} THEN '{sense}' END" for sense, parts in I.STATE_SENSES.items())},
    CASE WHEN k % 3 = 0 AND {_holds("rel", I.OWNS)} THEN 'ownership' END, CASE WHEN k % 11 = 0 THEN 'classification' END], lambda x: x IS NOT NULL) AS senses FROM said)"""

_EVIDENCE = f"""
flags AS (SELECT *, k % 3 = 0 OR (k % 4 = 0 AND (k % 8 = 0 OR k % 5 = 0)) AS mea, {_fold(f"coalesce({_pick(['O termômetro da sala', 'Maria', 'a balança', None, 'Meu relógio'], 2)}, '')")} AS subj,
    {_pick(["mediu", "medi", "comprou", None, "Marcou"], 3)} AS act, k % 6 = 0 AS ev, k % 7 = 0 AS chg, k % 11 = 0 AS life, k % 9 = 0 AS link, k % 18 = 0 AS rel FROM n),
read AS (SELECT *, NOT chg AND NOT life AND mea AND {_holds("subj", I.INSTRUMENTS)}
    AND (((act IS NULL OR {_one_of("lower(act)", I.INSTRUMENT_ACTIONS)} OR starts_with(lower(act), 'medi')) AND k % 2 != 0) OR (k % 4 = 0 AND NOT ev)) AS reading, act IS NOT NULL OR ev AS acts FROM flags),
evidence AS (SELECT *, NOT reading AND (chg OR CASE WHEN life THEN NOT (link AND rel AND NOT acts) ELSE acts END) AS occ FROM read),
routed AS (SELECT *, CASE WHEN k % 13 = 0 THEN CASE WHEN link OR rel THEN 'relation' WHEN k % 17 = 0 THEN 'type' WHEN mea THEN 'measurement' WHEN k % 19 = 0 OR (k % 4 = 3 AND k % 6 != 1) OR k % 26 = 0 THEN 'attribute'
        WHEN k % 6 = 1 OR k % 23 = 0 THEN 'state' ELSE 'event' END
    WHEN occ AND mea THEN 'event' WHEN life AND link AND rel AND NOT chg AND NOT acts THEN 'relation' WHEN chg OR life THEN 'event' WHEN k % 2 = 1 AND acts AND NOT reading THEN 'event'
    WHEN link OR rel THEN 'relation' WHEN k % 17 = 0 THEN 'type' WHEN k % 19 = 0 OR (k % 4 = 3 AND k % 6 != 1 AND NOT mea) THEN 'attribute' WHEN mea THEN 'measurement'
    WHEN k % 6 = 1 OR (k % 2 = 0 AND k % 10 = 0) THEN CASE WHEN k % 4 = 3 AND k % 23 != 0 THEN 'attribute' ELSE 'state' END WHEN acts AND NOT reading THEN 'event' WHEN k % 23 = 0 THEN 'state'
    WHEN k % 4 = 0 THEN 'measurement' WHEN k % 4 = 1 THEN 'state' ELSE 'unknown' END AS primitive FROM evidence)"""

_KNOWN_WORDS = _list(I.COMMON_WORDS)


def _words(text: str) -> str:
    return f"regexp_extract_all({_fold(text)}, '[a-z0-9]+')"


def _extra(reply: str, source: str) -> str:
    return f"list_filter({_words(reply)}, lambda w: len(w) >= 4 AND (regexp_matches(w, '^[0-9]+$') OR NOT (list_contains({_words(source)}, w) OR list_contains({_KNOWN_WORDS}, w))))"


_PRESENTED = f"""
c AS (SELECT *, c_custkey * 3 + c_nationkey AS k FROM customer),
shown AS (SELECT *, trim(replace(replace({_said(REPLY_PARTS, "")}, '{{name}}', c_name), '{{value}}', c_mktsegment)) AS reply, {_pick(["answered", "no_results", "error", "needs_clarification", "committed"], 2)} AS status FROM c),
told AS (SELECT *, {_fold("reply")} AS low, CASE WHEN k % 3 = 0 THEN k % 2 = 0 END AS ra,
    CASE WHEN status IN ('no_results', 'error') THEN [] WHEN status = 'needs_clarification' THEN [c_name, c_mktsegment] WHEN k % 4 = 0 THEN list_distinct((CASE WHEN k % 7 = 0 THEN [c_name] ELSE [] END) || (CASE WHEN k % 5 = 0 THEN [c_mktsegment] ELSE [] END))
        WHEN k % 7 = 0 THEN [c_name] WHEN k % 5 = 0 THEN [c_mktsegment] ELSE [] END AS required,
    {_extra("reply", "c_mktsegment || ' ' || status || ' yes ' || c_name")} AS with_yes, {_extra("reply", "c_mktsegment || ' ' || status || ' ' || c_name")} AS extra FROM shown)"""

#: guarded: the rows of t(t, prior, ..) with the guard's outcome and reason in x.
GUARDED = f"""
    f AS (SELECT *, {_any("t", I.CORRECTION_STRONG)} AS meta, {_any("t", I.CORRECTION_REPLACES)} AS repl, {_any("t", I.CORRECTION_MISREAD)} AS mis, {_any("t", I.CORRECTION_WEAK)} AS weak FROM t),
    guarded AS (SELECT *, CASE WHEN t LIKE '%?' OR (regexp_matches(t, {_text(I.REPORTED_QUESTION)}) AND contains(t, '?')) THEN 'reject query_form'
        WHEN NOT (meta OR repl OR (mis AND prior)) AND {_any("t", I.TERMINATION_CUES)} THEN 'reject termination_cue' WHEN NOT (meta OR repl OR (mis AND prior)) AND {_any("t", I.REPETITION_CUES)} THEN 'reject repetition_cue'
        WHEN NOT (meta OR repl OR (mis AND prior)) AND NOT weak AND {_any("t", I.EVOLUTION_CUES)} THEN 'reject evolution_cue' WHEN NOT (meta OR repl OR (mis AND prior)) AND {_any("t", I.OBSERVATION_CUES)} THEN 'reject new_observation_cue'
        WHEN meta OR repl OR (mis AND prior) THEN 'accept supported' WHEN mis THEN 'clarify context_required' WHEN prior AND {_any("t", I.CORRECTION_SHORT)} THEN 'accept supported'
        WHEN weak AND prior AND regexp_matches(t, {_text(I.PRONOUNS)}) THEN 'clarify target_ambiguous' WHEN weak AND prior THEN 'accept supported' ELSE 'reject signal_insufficient' END AS x FROM f)"""

SQL: dict[str, str] = {
    "correction_guard": f"""WITH {_ORDERS}, t AS (SELECT {_fold(_said(GUARD_PARTS))} AS t, o_custkey % 2 = 0 AS prior FROM n),{GUARDED}
        SELECT split_part(x, ' ', 1) AS outcome, split_part(x, ' ', 2) AS reason, count(*) AS n FROM guarded GROUP BY ALL""",
    "sense_recognition": f"WITH {_ORDERS},{_SENSED} SELECT sense, count(*) AS n FROM (SELECT unnest(senses) AS sense FROM sensed) GROUP BY 1",
    "canonical_gate": f"""WITH {_ORDERS},{_SENSED}, g AS (SELECT {_pick(sorted(P.GATES))} AS key, senses FROM sensed)
        SELECT key, CASE {" ".join(f"WHEN key = '{key}' AND list_has_any(senses, {_list(forbidden)}) THEN 'forbidden_sense'" + (f" WHEN key = '{key}' AND NOT list_contains(senses, '{needed}') THEN 'missing_sense'" if needed else "") for key, (forbidden, needed) in P.GATES.items())} END AS why, count(*) AS n FROM g GROUP BY ALL""",
    "social_opening": f"""WITH {_ORDERS}, t AS (SELECT regexp_replace(trim(regexp_replace({_fold(_said(SOCIAL_PARTS, ""))}, '\\s+', ' ', 'g')), '[!?.…]+$', '') AS low FROM n),
        o AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(low, {_text(p)}) THEN '{i}'" for i, p in I.SOCIAL)} END AS opening,
            trim(regexp_replace(CASE {" ".join(f"WHEN regexp_matches(low, {_text(p)}) THEN regexp_replace(low, {_text(p)}, '')" for _, p in I.SOCIAL)} END, '^[,.;:\\-\\s]+', '')) AS rest,
            {_any("low", I.NOT_SOCIAL)} OR {" OR ".join(f"(regexp_matches(low, {_text(a)}) AND regexp_matches(low, {_text(b)}))" for a, b in I.NOT_SOCIAL_PAIRS)} AS veto FROM t),
        b AS (SELECT *, trim(regexp_replace(regexp_replace(trim(low), '[!?.…]+$', ''), '[,\\s]+assistente\\.?$', '')) AS bare_low, trim(regexp_replace(regexp_replace(trim(rest), '[!?.…]+$', ''), '[,\\s]+assistente\\.?$', '')) AS bare_rest FROM o),
        e AS (SELECT *, CASE {" ".join(f"WHEN {_one_of('bare_low', w)} THEN '{i}'" for i, w in I.SOCIAL_EXACT.items())} END AS exact, CASE {" ".join(f"WHEN {_one_of('bare_rest', w)} THEN '{i}'" for i, w in I.SOCIAL_EXACT.items())} END AS also FROM b),
        s AS (SELECT *, rest != '' AND also IS NULL AND NOT {_any("rest", I.TASK_CUES)} AND len(regexp_split_to_array(rest, '\\s+')) >= 4 AS statement FROM e),
        r AS (SELECT CASE WHEN low = '' OR veto THEN ['none', low] WHEN opening IS NOT NULL AND NOT statement THEN [CASE WHEN opening = 'acknowledgement' AND rest = '' AND regexp_matches(low, '\\b(obrigad[oa]|valeu|agradeco)\\b') THEN 'thanks'
                WHEN also = 'thanks' THEN 'thanks' ELSE opening END, CASE WHEN also IS NOT NULL THEN '' ELSE regexp_replace(rest, '^[,.;:!?\\-\\s]+|[,.;:!?\\-\\s]+$', '', 'g') END] WHEN opening IS NULL AND exact IS NOT NULL THEN [exact, ''] ELSE ['none', low] END AS r FROM s)
        SELECT r[1] AS intent, r[2] AS task, count(*) AS n FROM r GROUP BY ALL""",
    "groundedness_check": f"""WITH pairs AS (SELECT r.conv_id, r.turn, r.text AS reply, q.text AS question FROM conversations r JOIN conversations q ON q.conv_id = r.conv_id AND q.turn + 1 = r.turn AND r.role = 'assistant' AND q.role = 'user')
        SELECT conv_id, turn, len(trim(reply)) > {I.LONGEST_REPLY} AS too_long, len(list_distinct({_extra("reply", "question")}))::INT AS n_unattested FROM pairs""",
    "presenter_guard": f"""WITH{_PRESENTED}, w AS (SELECT *, CASE WHEN k % 5 = 0 THEN with_yes ELSE extra END AS x FROM told),
        u AS (SELECT *, regexp_matches(low, {_text(I.SAYS_UNKNOWN)}) AS unk, regexp_matches(low, {_text(I.SAYS_NO)}) AS no, regexp_matches(low, {_text(I.BARE_NO)}) AS bare, regexp_matches(low, {_text(I.SAYS_FAILED)}) AS failed FROM w)
        SELECT status, CASE WHEN reply = '' THEN 'empty' WHEN len(reply) > {I.LONGEST_REPLY} THEN 'too_long' WHEN starts_with(reply, '{{') THEN 'malformed' WHEN k % 6 != 0 AND regexp_matches(low, {_text(I.INTERNAL_WORDS)}) THEN 'implementation_term'
            WHEN len(list_filter(required, lambda v: NOT contains(low, {_fold("v")}))) > 0 THEN 'missing_value' WHEN status = 'no_results' AND (bare OR (no AND NOT unk)) THEN 'no_results_as_false' WHEN status = 'no_results' AND NOT unk THEN 'no_results_missing_unknown'
            WHEN status = 'answered' AND ra = false AND unk AND ((NOT no AND NOT bare) OR contains(low, 'ainda')) THEN 'false_as_unknown' WHEN status = 'error' AND unk AND NOT failed THEN 'error_as_unknown' WHEN status = 'error' AND NOT failed THEN 'error_not_failure'
            WHEN status != 'error' AND len(x) >= 3 THEN 'unattested_facts' WHEN status = 'answered' AND len(list_filter(x, lambda w: regexp_matches(w, '^[0-9]+$') OR {_one_of("w", I.INVENTED_WORDS)})) > 0 THEN 'unattested_facts' END AS fault, count(*) AS n FROM u GROUP BY ALL""",
    "fallback_replies": f"""WITH c AS (SELECT *, c_custkey * 3 + c_nationkey AS k FROM customer),
        p AS (SELECT *, {_pick(["answered", "no_results", "needs_clarification", "deferred", "unsupported", "partial", "error"])} AS s, CASE k % 3 WHEN 0 THEN 'attribute' WHEN 1 THEN 'measurement' ELSE '' END AS kind, CASE WHEN k % 4 != 0 THEN c_name END AS name,
            CASE k % 5 WHEN 0 THEN 'weight' WHEN 1 THEN 'temperature' ELSE '' END AS d, CASE WHEN k % 6 != 0 THEN c_mktsegment END AS v, CASE WHEN k % 2 = 0 THEN ' kg' ELSE '' END AS u, CASE WHEN k % 8 = 0 THEN k % 16 = 0 END AS ra FROM c)
        SELECT c_custkey, coalesce(CASE WHEN s = 'error' THEN 'Não consegui consultar isso agora.' WHEN s = 'partial' THEN 'Entendi parte disso, mas não consegui guardar tudo.'
            WHEN s IN ('deferred', 'unsupported') AND k % 2 = 1 THEN 'Entendi o que você quis dizer, mas ainda não consigo guardar essa informação corretamente.'
            WHEN s = 'no_results' THEN CASE WHEN name IS NOT NULL AND d != '' THEN 'Ainda não sei a ' || CASE d WHEN 'weight' THEN 'peso' ELSE 'temperatura' END || ' da ' || name || '.' WHEN name IS NOT NULL THEN 'Ainda não sei isso sobre ' || name || '.' ELSE 'Ainda não sei isso.' END
            WHEN s = 'needs_clarification' THEN 'Você está falando da ' || c_name || ' ou ' || c_mktsegment || '?' WHEN s = 'unsupported' THEN 'Não consegui interpretar isso com segurança.' WHEN ra THEN 'Sim.' WHEN NOT ra THEN 'Pelo que sei, não.'
            WHEN kind = 'measurement' OR d != '' THEN CASE WHEN v IS NULL THEN NULL WHEN name IS NOT NULL AND d = 'weight' THEN 'A ' || name || ' pesa ' || v || u || '.' WHEN name IS NOT NULL AND d = 'temperature' THEN 'A ' || name || ' está a ' || v || u || '.'
                WHEN name IS NOT NULL THEN name || ': ' || v || u || '.' ELSE v || u || '.' END
            WHEN kind = 'attribute' AND v IS NOT NULL AND name IS NOT NULL THEN name || ': ' || v || '.' WHEN (kind = 'attribute' OR s = 'answered') AND v IS NOT NULL THEN v || '.' END, '') AS reply FROM p""",
    "primitive_routing": f"WITH {_LINES},{_EVIDENCE} SELECT primitive, CASE primitive WHEN 'attribute' THEN 'property' WHEN 'type' THEN 'classification' WHEN 'state' THEN NULL WHEN 'unknown' THEN NULL ELSE primitive END AS graph, count(*) AS n FROM routed GROUP BY ALL",
    "assertion_collection": f"""WITH {_LINES},{_EVIDENCE}, a AS (SELECT CASE WHEN k % 13 = 0 THEN [primitive] WHEN occ AND mea THEN ['event', 'measurement'] WHEN mea AND primitive != 'measurement' THEN [primitive, 'measurement'] ELSE [primitive] END AS a FROM routed)
        SELECT primitive, position::INT AS position, count(*) AS n FROM (SELECT unnest(a) AS primitive, unnest(range(len(a))) AS position FROM a) GROUP BY ALL""",
    "evidence_flags": f"WITH {_LINES},{_EVIDENCE} SELECT mea AS measurement, reading, occ AS occurrence, count(*) AS n FROM evidence GROUP BY ALL",
    "measurement_query_mode": f"""WITH {_ORDERS}, t AS (SELECT *, lower({_said(MEASURE_PARTS)}) AS t FROM n)
        SELECT CASE WHEN k % 5 != 0 AND regexp_matches(t, {_cue(P.VALUE_CUE)}) THEN 'value_proposition' WHEN regexp_matches(t, {_cue(P.LAST_CUE)}) THEN 'latest_observation' WHEN regexp_matches(t, {_cue(P.RANGE_CUE)}) THEN 'observations_in_range'
            WHEN k % 7 = 0 OR regexp_matches(t, '\\b(agora|atual|atualmente|now|currently)\\b') THEN 'observation_at_time' WHEN regexp_matches(t, {_cue(P.PRESENT_CUE)}) AND regexp_matches(t, {_cue(P.ASKING_CUE)}) THEN 'observation_at_time' ELSE 'latest_observation' END AS mode, count(*) AS n FROM t GROUP BY 1""",
    "attribute_query_mode": f"""WITH {_ORDERS}, t AS (SELECT *, lower({_said(ATTRIBUTE_PARTS)}) AS t FROM n)
        SELECT CASE WHEN k % 11 = 0 THEN 'value_lookup' WHEN regexp_matches(t, {_cue(P.EXISTED_CUE)}) OR (regexp_matches(t, {_cue(P.PAST_CUE)}) AND regexp_matches(t, {_cue(P.IN_YEAR_CUE)})) THEN 'historical_existence'
            WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN 'proposition' ELSE 'value_lookup' END WHEN regexp_matches(t, {_cue(P.OPEN_CUE)}) THEN 'value_lookup' ELSE 'proposition' END AS mode, count(*) AS n FROM t GROUP BY 1""",
    "vocabulary_lookups": f"""WITH {_ORDERS}, p AS (SELECT {_pick(ALIAS_SAID)} AS answer, {_pick(PREDICATES)} AS predicate, {_pick(CLASS_HINTS)} AS hint FROM n),
        f AS (SELECT *, {_fold("answer")} AS a, {_fold("predicate")} AS q, lower(trim(hint)) AS h FROM p),
        r AS (SELECT *, CASE {" ".join(f"WHEN {_one_of('a', aliases)} THEN '{key}'" for key, aliases in V.DIMENSION_ALIASES.items())} END AS dimension,
            coalesce({", ".join(f"CASE {' '.join(f'WHEN {_one_of(c, aliases)} THEN {_text(key)}' for key, aliases in V.MEASURE_ALIASES.items())} END" for c in ("a", "split_part(trim(split_part(a, ',', 1)), ' ', 1)", "array_to_string(string_split(a, ' ')[1:2], ' ')"))}) AS measure,
            CASE WHEN starts_with(trim(predicate), 'relation.') THEN trim(predicate) ELSE coalesce(CASE WHEN {_one_of("'relation.' || replace(q, ' ', '_')", [*V.RELATION_ALIASES, *V.INVERSE_RELATIONS])} THEN 'relation.' || replace(q, ' ', '_') END,
                CASE {" ".join(f"WHEN {_one_of('q', aliases)} THEN '{key}'" for key, aliases in V.RELATION_ALIASES.items())} END, 'relation.learned.' || {_slug("predicate")}) END AS relation,
            coalesce(CASE {" ".join(f"WHEN h = '{a}' THEN '{V.KIND_TYPES[k]}'" for a, k in V.KIND_ALIASES.items())} {" ".join(f"WHEN h = '{k}' THEN '{t}'" for k, t in V.KIND_TYPES.items())} END, 'entity.learned.' || {_slug("hint")}) AS type_key FROM f)
        SELECT answer, dimension, measure, predicate, relation, CASE relation {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.INVERSE_RELATIONS.items())} ELSE relation END AS stored, coalesce({_one_of("relation", list(V.INVERSE_RELATIONS))}, false) AS swapped, hint, type_key, count(*) AS n FROM r GROUP BY ALL""",
    "stated_measurements": """WITH e AS (SELECT event_id, event_id % 9 AS a, event_id % 7 AS b, event_id % 3 = 0 AS unit, event_id % 4 = 0 AS cur, event_type, value::DECIMAL(18,2) AS v FROM events),
        r AS (SELECT *, CASE WHEN a = 1 THEN 'dimension_missing' WHEN a = 0 THEN 'dimension_forbidden' WHEN b = 1 THEN 'number_missing' WHEN b = 0 THEN 'number_invalid' WHEN unit AND cur THEN 'unit_and_currency' END AS error FROM e)
        SELECT event_id, CASE WHEN error IS NULL THEN event_type END AS dimension, CASE WHEN error IS NULL THEN v END AS number, CASE WHEN error IS NULL AND unit THEN 'kg' END AS unit, CASE WHEN error IS NULL AND cur THEN 'BRL' END AS currency, error FROM r""",
    "display_values": f"""{_with(_ATTRIBUTE)} SELECT attribute_id, coalesce(text_value, numeric_value::VARCHAR || CASE WHEN unit IS NOT NULL THEN ' ' || unit ELSE '' END, '') AS shown,
        CASE WHEN dimension = 'brand' AND lower(text_value) IN ('brand#11', 'brand#23') THEN 'B' || lower(text_value)[2:] END AS brand, CASE WHEN dimension = 'type' AND len(string_split(text_value, ' ')) <= 3 THEN text_value END AS model FROM attribute""",
    "value_round_trip": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN event_id::DECIMAL(18,2) END AS number, CASE event_id % 5 WHEN 2 THEN (event_id % 2 = 0)::VARCHAR END AS flag, CASE event_id % 5 WHEN 3 THEN value::DECIMAL(18,2) END AS amount,
        CASE event_id % 5 WHEN 3 THEN 'BRL' END AS currency, CASE event_id % 5 WHEN 4 THEN 'e:' || event_id END AS reference, CASE event_id % 5 WHEN 0 THEN props END AS text FROM events""",
}
