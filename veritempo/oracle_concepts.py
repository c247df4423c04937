"""SQL of concept resolution, with lists and rules of its own: nothing of the code under test is read here."""

from __future__ import annotations

# What is said, as the tables' rows go round it: words, senses by hand (a sense with ! only if something changes).
_EVENTS = [
    ("troquei a embreagem do carro", "replace_physical!"),
    ("Troquei o óleo", "replace_physical!"),
    ("trocamos ideia ontem, changed mind", "exchange_idea"),
    ("A instalação do ar foi ontem", "install"),
    ("as instalações da empresa são novas", "facilities property_new"),
    ("quebrou hoje", ""),
    ("troquei reais por dólares", "currency_exchange"),
    ("troquei de roupa", "clothing_change"),
    ("passei no mercado", "ambiguous_pass"),
    ("consertei a porta", ""),
    ("abriu a loja", ""),
    ("nada disso", ""),
]
_RELATIONS = [("trabalha em", ""), ("mora em", ""), ("é meu", ""), ("GOSTA DE", ""), ("casada com", ""), ("mãe de", ""), ("médico", ""), ("joga xadrez com", ""), ("instalações novas", "facilities property_new"), ("", ""), ("possui", ""), ("123", "")]
_STATES = [("quebrada", "operational_broken?"), ("está aberta", ""), ("atrasado", ""), ("acabou", ""), ("desempregado", ""), ("funcionando, é nova", "property_new"), ("fechada", ""), ("não pago", ""), ("válido", ""), ("vencida", ""), ("tranquila", ""), ("quebrado e é novo", "operational_broken? property_new")]


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in values)


def _base(said: list[tuple[str, str]]) -> str:
    return f"""WITH said AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_rows(said)}) AS v(surface, senses)),
        p AS (SELECT u AS user_id, o_orderkey AS proposal_id, o_orderkey % 12 AS i, ['person', 'thing', NULL][o_custkey % 3 + 1] AS sk, ['organization', 'person', 'place', NULL][o_orderkey // 12 % 4 + 1] AS ok,
                o_custkey % 7 != 2 AS change, o_custkey % 7 != 3 AS condition, o_custkey % 7 != 4 AS link FROM orders, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE u = 1 OR o_orderkey % 2 = 0)"""


def _out(columns: str) -> str:
    return f"SELECT user_id, nullif(surface, '') AS surface, status, coalesce(sense, '') AS sense, coalesce(reason, '') AS reason, {columns}, count(*) AS n, max(proposal_id) AS last FROM r GROUP BY ALL"


SQL: dict[str, str] = {
    # A relation's words name its key; ends, and that it is a link, decide whether the key may be used. Else both ends make a learned key.
    "concepts_of_relations": f"""{_base(_RELATIONS)},
        a AS (SELECT * FROM (VALUES (0, 'relation.employed_by', 'organization', true), (1, 'relation.resides_at', 'place', true), (2, 'relation.owns', '', true), (3, 'relation.likes', '', false), (4, 'relation.married_to', 'person', true), (5, 'relation.parent_of', 'person', true), (6, 'relation.provider_for', 'person', true), (10, 'relation.owns', '', true)) AS v(i, key, needs_object, needs_link)),
        slugs AS (SELECT * FROM (VALUES (0, 'trabalha_em'), (1, 'mora_em'), (2, 'e_meu'), (3, 'gosta_de'), (4, 'casada_com'), (5, 'mae_de'), (6, 'medico'), (7, 'joga_xadrez_com'), (8, 'instalacoes_novas'), (10, 'possui'), (11, 'r_123')) AS v(i, slug)),
        m AS (SELECT p.*, surface, key, slug, coalesce(sk = 'person' AND (needs_object = '' OR needs_object = ok) AND (link OR NOT needs_link), false) AS fits FROM p JOIN said USING (i) LEFT JOIN a USING (i) LEFT JOIN slugs USING (i)),
        r AS (SELECT *, CASE WHEN fits AND key = 'relation.provider_for' THEN 'unresolved' WHEN fits THEN 'resolved' WHEN i = 8 THEN 'safe_partial' WHEN sk IS NOT NULL AND ok IS NOT NULL AND slug IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status,
                CASE WHEN i = 8 THEN 'facilities' END AS sense,
                CASE WHEN fits AND key = 'relation.provider_for' THEN 'unknown_key' WHEN fits THEN NULL WHEN i = 8 THEN 'no_concept_for_sense' WHEN sk IS NOT NULL AND ok IS NOT NULL AND slug IS NOT NULL THEN NULL ELSE 'no_alias' END AS reason,
                CASE WHEN fits AND key = 'relation.provider_for' THEN '' WHEN fits THEN key WHEN i != 8 AND sk IS NOT NULL AND ok IS NOT NULL THEN coalesce('relation.learned.' || slug, '') ELSE '' END AS relation FROM m)
        {_out("relation")}""",
    # The words of a state name its value, unless it is not said of a condition; new things are neither open, broken nor working.
    "concepts_of_states": f"""{_base(_STATES)},
        a AS (SELECT * FROM (VALUES (0, 'state.operational_condition', 'state.value.broken'), (1, 'state.openness', 'state.value.open'), (2, 'state.due_status', 'state.value.overdue'), (3, 'state.availability', 'state.value.depleted'), (4, 'state.availability', 'state.value.depleted'),
                (5, 'state.operational_condition', 'state.value.working'), (6, 'state.openness', 'state.value.closed'), (7, 'state.payment_status', 'state.value.unpaid'), (8, 'state.validity', 'state.value.valid'), (9, 'state.validity', NULL), (11, 'state.operational_condition', 'state.value.broken')) AS v(i, dim, val)),
        m AS (SELECT p.*, surface, dim, val, dim IS NOT NULL AND condition AS said_so, i IN (5, 11) AS vetoed FROM p JOIN said USING (i) LEFT JOIN a USING (i)),
        r AS (SELECT *, CASE WHEN NOT said_so OR vetoed OR val IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN i IN (5, 11) THEN 'property_new' END AS sense,
                CASE WHEN NOT said_so THEN 'no_alias' WHEN vetoed THEN 'property_new_sense' WHEN val IS NULL THEN 'unknown_key' END AS reason,
                CASE WHEN said_so AND NOT vetoed THEN dim ELSE '' END AS dimension, CASE WHEN said_so AND NOT vetoed THEN coalesce(val, '') ELSE '' END AS value FROM m)
        {_out("dimension, value")}""",
    # What happened: oil before clutch before any replacement; talk, money and clothes are none; what isn't a change has no alias.
    "concepts_of_events": f"""{_base(_EVENTS)},
        m AS (SELECT p.*, surface FROM p JOIN said USING (i)),
        r AS (SELECT *, CASE WHEN i IN (0, 1, 5, 9, 10) AND change THEN 'resolved' WHEN i = 2 THEN 'blocked' WHEN i = 3 THEN CASE WHEN change THEN 'unresolved' ELSE 'ontology_gap' END WHEN i = 4 THEN 'safe_partial' WHEN i = 6 THEN 'ontology_gap' WHEN i = 7 THEN 'unresolved' WHEN i = 8 THEN 'ambiguous' ELSE 'unresolved' END AS status,
                CASE WHEN i IN (0, 1) AND change THEN 'replace_physical' WHEN i = 2 THEN 'exchange_idea' WHEN i = 3 THEN 'install' WHEN i = 4 THEN 'facilities' WHEN i = 6 THEN 'currency_exchange' WHEN i = 7 THEN 'clothing_change' WHEN i = 8 THEN 'ambiguous_pass' END AS sense,
                CASE WHEN i IN (0, 1, 5, 9, 10) AND change THEN NULL WHEN i = 2 THEN 'blocked_alias' WHEN i = 3 THEN CASE WHEN change THEN 'unknown_key' ELSE 'no_concept_for_sense' END WHEN i IN (4, 6, 7, 8) THEN 'no_concept_for_sense' ELSE 'no_alias' END AS reason,
                CASE WHEN NOT change THEN '' WHEN i = 0 THEN 'action.replace' WHEN i = 1 THEN 'action.oil_change' WHEN i = 9 THEN 'action.maintain' ELSE '' END AS action,
                CASE WHEN NOT change THEN '' WHEN i IN (0, 1) THEN 'event.vehicle_maintenance' WHEN i IN (5, 9, 10) THEN 'event.maintenance' ELSE '' END AS event_type FROM m)
        {_out("action, event_type")}""",
    # The values that the texts were put together from.
    "attribute_values_stated": """WITH p AS (SELECT u AS user_id, p_partkey AS k, p_size + 1 AS size, 1990 + p_partkey % 30 AS y, p_partkey % 12 AS form FROM part, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE u = 1 OR p_partkey % 2 = 0),
        v AS (SELECT *, ['Honda', 'Fiat', NULL][k % 3 + 1] AS brand, k % 24 = 23 AS shown FROM p),
        d AS (SELECT *, CASE WHEN k % 29 = 0 THEN '' WHEN shown THEN CASE WHEN brand IS NULL THEN '' ELSE 'brand' END
                WHEN form = 0 THEN 'name' WHEN form = 1 THEN CASE WHEN brand IS NULL THEN '' ELSE 'brand' END WHEN form = 2 THEN 'model' WHEN form = 3 THEN 'capacity' WHEN form = 4 THEN 'weight' WHEN form = 5 THEN 'area' WHEN form IN (6, 7) THEN 'model_year'
                WHEN form = 8 AND k % 3 != 2 THEN 'color' WHEN form = 9 AND k % 3 != 1 THEN 'color' WHEN form = 10 THEN 'height' ELSE '' END AS dimension FROM v)
        SELECT user_id, k AS proposal_id, dimension, CASE WHEN dimension = '' THEN '' WHEN dimension = 'model_year' THEN 'year' WHEN dimension IN ('capacity', 'weight', 'area', 'height') THEN 'number' ELSE 'text' END AS kind,
            CASE dimension WHEN 'name' THEN 'Peça ' || k WHEN 'brand' THEN brand WHEN 'model' THEN 'civic ' || k % 7 WHEN 'color' THEN CASE WHEN form = 8 THEN ['azul', 'prata'][k % 3 + 1] ELSE ['verde agua', '', 'azul'][k % 3 + 1] END ELSE '' END AS text,
            CASE dimension WHEN 'capacity' THEN 'L' WHEN 'weight' THEN 'kg' WHEN 'area' THEN 'm²' WHEN 'height' THEN 'm' ELSE '' END AS unit,
            CASE WHEN dimension = 'capacity' THEN size || '.50' WHEN dimension IN ('weight', 'area', 'height') THEN size || '.00' ELSE '' END AS number,
            CASE WHEN dimension = 'model_year' THEN y::VARCHAR ELSE '' END AS year,
            CASE WHEN k % 29 = 0 THEN '' WHEN shown AND brand IS NOT NULL THEN 'brand=' || brand || ' model=Civic' WHEN NOT shown AND form = 1 AND brand IS NOT NULL THEN 'brand=' || brand WHEN NOT shown AND form = 2 THEN 'model=civic ' || k % 7 ELSE '' END AS companions,
            NOT (form = 7) AS is_current FROM d""",
    # What each proposal must become, stated by hand.
    "repaired_proposals": """WITH m AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES
            ('assert', 'eu', 'person', 'contextual', '', 'name is Ana', '', '', 'attribute', false, true, false, 'self_reference'),
            ('query', 'eu', 'person', 'contextual', '', 'nome', '', '', 'attribute', false, true, false, 'name_query'),
            ('query', 'carro', 'vehicle', 'possessive', '', 'cor', '', '', 'attribute', false, true, false, 'possessive'),
            ('query', 'eu', 'person', 'contextual', 'carro', '', 'owns', '', 'relation', true, false, false, 'possessive'),
            ('assert', 'casa', 'place', 'possessive', '', 'cor azul', '', '', 'attribute', false, true, false, 'possessive'),
            ('assert', 'carro', 'vehicle', 'contextual', '', 'cor prata', '', '', 'attribute', false, true, false, 'possessive vehicle_attribute'),
            ('assert', 'carro', 'vehicle', 'contextual', '', 'Honda Civic', '', '', 'attribute', false, true, false, 'vehicle_attribute'),
            ('query', 'carro', 'vehicle', 'possessive', '', '*', '', '', 'attribute', false, true, false, 'possessive'),
            ('query', 'casa', 'place', 'possessive', '', '*', '', '', 'attribute', false, true, false, 'possessive'),
            ('query', 'eu', 'person', 'contextual', '', '', 'gosto de', '', 'relation', true, false, false, 'likes_inventory'),
            ('query', '', '', '', '', '', '', '', '', false, false, false, ''),
            ('assert', 'bicicleta', 'vehicle', 'possessive', 'bicicleta', 'cor azul', '', '', 'attribute', false, true, false, 'slot_align'),
            ('query', 'trabalho', '', 'possessive', '', '*', '', '', 'attribute', false, true, false, 'slot_align'),
            ('assert', '', '', '', '', '', '', '', '', false, false, false, ''),
            ('assert', '', '', '', '', '', '', '', '', false, false, false, ''),
            ('assert', '', '', '', '', '', '', '', '', false, false, false, '')
            ) AS v(utterance_kind, subject_text, subject_kind, subject_reference, object_text, attribute_expression, relation_expression, action_expression, primitive_hint, link, stable, change, repairs))
        SELECT u AS user_id, o_orderkey AS proposal_id, m.* EXCLUDE (i) FROM orders JOIN m ON i = o_orderkey % 16, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE u = 1 OR o_orderkey % 2 = 0""",
}
