"""SQL of questions, with outcomes stated by hand and descriptions held against all candidates: no list or rule is shared."""

from __future__ import annotations

from veritempo.oracle import _ATTRIBUTE, _ENTITY, _EVENT, _MEASUREMENT, _PARTICIPANT, _RELATION, _STATE, _latest_measure, _with

#: What each form becomes: primitive, note, association, mode, other columns.
_FORMS = [
    ("event", "", "subject", "", "action=action.replace"),
    ("event", "event_query_missing_constraints", "", "", ""),
    ("event", "", "event_context", "", ""),
    ("state", "", "subject", "", "state_dimension=state.openness state_value=state.value.open"),
    ("state", "state_value_unresolved", "", "", ""),
    ("relation", "", "relation_subject", "boolean", "relation=relation.owns"),
    ("relation", "relation_identity_incomplete", "", "", ""),
    ("relation", "", "relation_subject", "boolean", "relation=relation.owns object_type=entity.vehicle"),
    ("relation", "class_constraint_unresolved", "", "", ""),
    ("relation", "", "relation_subject", "list", "relation=relation.likes"),
    ("attribute", "", "subject", "snapshot", ""),
    ("attribute", "", "subject", "value_lookup", "dimension=color"),
    ("attribute", "", "subject", "proposition", "dimension=color value_kind=text value_text=azul"),
    ("attribute", "", "subject", "existence", "dimension=color value_kind=text value_text=vermelho"),
    ("attribute", "", "subject", "value_lookup", "dimension=color version_policy=history sort=event_time_desc limit=1"),
    ("attribute", "attribute_dimension_unresolved", "", "", ""),
    ("measurement", "", "subject", "latest", "dimension=weight"),
    ("measurement", "", "subject", "in_range", "dimension=weight"),
    ("measurement", "", "subject", "timed", "dimension=weight"),
    ("measurement", "", "subject", "at_time", "dimension=weight"),
    ("measurement", "", "subject", "proposition", "dimension=weight value_kind=number value_number=70.50 value_unit=kg"),
    ("measurement", "measurement_dimension_unresolved", "", "", ""),
    ("event", "blocked", "", "", ""),
    ("event", "ambiguous_pass", "", "", ""),
    ("event", "ontology_gap", "", "", ""),
    ("unknown", "unknown_primitive", "", "", ""),
    ("type", "type_query_not_attribute", "", "", ""),
    ("measurement", "", "subject", "at_time", "dimension=weight"),
    ("measurement", "measurement_unit_currency_coexist", "", "", ""),
    ("attribute", "", "subject", "existence", "dimension=color value_kind=text value_text=azul"),
    ("attribute", "attribute_entity_missing", "", "", ""),
]
_MORE = ["action", "event_type", "relation", "object_type", "state_dimension", "state_value", "dimension", "value_kind", "value_text", "value_unit", "value_currency", "value_number", "version_policy", "sort", "limit"]
_STATUS = "CASE WHEN note = '' THEN 'resolved' WHEN note = 'blocked' THEN 'safe_unresolved' WHEN note = 'ontology_gap' THEN 'ontology_gap' WHEN note IN ('ambiguous_pass', 'unknown_primitive') THEN 'safe_ambiguous' ELSE 'insufficient' END"


def _forms() -> str:
    return ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in form) + ")" for i, form in enumerate(_FORMS))


SQL: dict[str, str] = {
    "question_specifications": f"""WITH form AS (SELECT * FROM (VALUES {_forms()}) AS v(i, primitive, note, association, mode, more)),
        p AS (SELECT u AS user_id, o_orderkey AS request_id, f.*, o_orderkey // 31 % 8 AS t, date_trunc('day', o_orderdate) + (o_orderdate - date_trunc('day', o_orderdate)) + INTERVAL 10 HOUR AS now,
                CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '-180 minutes' ELSE INTERVAL '330 minutes' END AS ahead FROM orders JOIN form f ON i = o_orderkey % 31, (VALUES (1::BIGINT), (2::BIGINT)) x(u) WHERE u = 1 OR o_orderkey % 2 = 0),
        q AS (SELECT *, date_trunc('day', now + ahead) AS day, note = '' AND primitive NOT IN ('state', 'relation') AS timed FROM p),
        r AS (SELECT *, CASE WHEN NOT timed THEN '' WHEN i = 19 OR t = 6 THEN 'now' WHEN t = 3 THEN 'yesterday' WHEN t = 4 THEN 'today' WHEN i = 27 AND t = 0 THEN 'now' ELSE '' END AS period FROM q),
        s AS (SELECT *, CASE WHEN period = 'now' THEN now WHEN period = 'yesterday' THEN day - INTERVAL 1 DAY - ahead WHEN period = 'today' THEN day - ahead WHEN timed AND t = 1 THEN TIMESTAMP '1996-03-01' - ahead WHEN timed AND t = 2 THEN TIMESTAMP '1995-01-01' - ahead END AS a,
                CASE WHEN period = 'now' THEN now + INTERVAL 1 MICROSECOND WHEN period = 'yesterday' THEN day - ahead WHEN period = 'today' THEN day + INTERVAL 1 DAY - ahead WHEN timed AND t = 1 THEN TIMESTAMP '1996-04-01' - ahead WHEN timed AND t = 2 THEN TIMESTAMP '1996-01-01' - ahead END AS b FROM r)
        SELECT user_id, request_id, primitive, {_STATUS} AS status, note, CASE WHEN note != '' THEN '' WHEN primitive = 'event' THEN CASE WHEN a IS NULL THEN 'list' ELSE 'aggregate' END ELSE primitive END AS intent,
            CASE WHEN note = '' AND primitive = 'event' AND a IS NOT NULL THEN 'count' ELSE '' END AS aggregate, association, CASE WHEN mode = 'timed' THEN CASE WHEN a IS NULL THEN 'latest' ELSE 'at_time' END ELSE mode END AS mode,
            {", ".join(f"regexp_extract(more, '(?:^| ){c}=([^ ]*)', 1) AS " + (f'"{c}"') for c in _MORE)}, period, coalesce(strftime(a, '%Y-%m-%d %H:%M:%S.%f'), '') AS "start", coalesce(strftime(b, '%Y-%m-%d %H:%M:%S.%f'), '') AS "end" FROM s""",
    # Every description against every candidate of its user and kind.
    "described_targets": f"""{_with(_ENTITY, _EVENT, _PARTICIPANT, _MEASUREMENT, _ATTRIBUTE, _STATE, _RELATION)},
        label AS (SELECT entity_id, lower(name) AS name FROM entity),
        shown AS (SELECT event_id, string_agg(DISTINCT name, chr(1)) AS names FROM participant JOIN label USING (entity_id) GROUP BY 1),
        cand AS (
            SELECT 'attribute' AS kind, attribute_id::VARCHAR AS id, name AS names, '' AS objects, dimension, NULL AS key, NULL::INT AS year, NULL AS action, lower(text_value) AS text, numeric_value AS number FROM attribute JOIN label USING (entity_id)
            UNION ALL SELECT 'state', state_id::VARCHAR, name, '', dimension, value, NULL, NULL, NULL, NULL FROM state JOIN label USING (entity_id)
            UNION ALL SELECT 'measurement', measurement_id::VARCHAR, '', '', dimension, NULL, year(observed_at), NULL, NULL, value FROM measurement
            UNION ALL SELECT 'relation', relation_id, f.name || chr(1) || t.name, t.name, NULL, key, NULL, NULL, NULL, NULL FROM relation JOIN label f ON f.entity_id = from_id JOIN label t ON t.entity_id = to_id
            UNION ALL SELECT 'event', event_id::VARCHAR, coalesce(names, ''), '', NULL, NULL, year(w_start), action, NULL, NULL FROM event LEFT JOIN shown USING (event_id)),
        hashed AS (SELECT *, ('0x' || substr(md5(kind || '/' || id), 1, 4))::INT AS h FROM cand),
        held AS (SELECT u AS user_id, hashed.*, (h + u) % 17 = 0 AS ended FROM hashed, (VALUES (1::BIGINT), (2::BIGINT)) x(u) WHERE u = 1 OR h % 2 = 0),
        base AS (SELECT s_suppkey AS k, form, p_name, p_brand, p_type, p_size, s_name FROM supplier JOIN part ON s_suppkey = p_partkey, range(13) f(form)),
        said AS (SELECT (k + form) % 2 + 1 AS user_id, k * 100 + form AS description_id,
            ['attribute', 'attribute', 'state', 'state', 'relation', 'relation', 'event', 'event', 'measurement', NULL, 'attribute', 'attribute', 'relation'][form + 1] AS kind,
            CASE form WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(p_name) WHEN 3 THEN lower(trim(substr(p_name, 2, 6))) WHEN 4 THEN 'customer#' || lpad((k % 40)::VARCHAR, 9, '0') WHEN 5 THEN lpad(k::VARCHAR, 9, '0') WHEN 6 THEN 'customer#' || lpad(k::VARCHAR, 9, '0') WHEN 12 THEN lower(left(s_name, 2)) END AS part,
            CASE form WHEN 4 THEN 'supplier#' || lpad((k % 7 + 1)::VARCHAR, 9, '0') WHEN 12 THEN right(s_name, 2) END AS object,
            CASE form WHEN 0 THEN 'brand' WHEN 1 THEN 'size' WHEN 2 THEN 'openness' WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'return' ELSE 'openness' END WHEN 8 THEN CASE WHEN k % 3 = 0 THEN 'click' ELSE 'purchase' END WHEN 10 THEN 'type' END AS dimension,
            CASE form WHEN 2 THEN 'O' WHEN 3 THEN CASE WHEN k % 3 = 0 THEN 'F' END WHEN 4 THEN 'buys_from' WHEN 5 THEN 'resides_at' END AS key,
            CASE form WHEN 6 THEN CASE WHEN k % 2 = 0 THEN 'action.o' END WHEN 7 THEN 'action.f' END AS action,
            CASE form WHEN 6 THEN 1996 + k % 3 WHEN 7 THEN 1992 + k % 8 WHEN 8 THEN 2024 END AS year,
            CASE form WHEN 0 THEN CASE WHEN k % 2 = 0 THEN lower(p_brand) END WHEN 10 THEN lower(p_type) END AS text,
            CASE form WHEN 1 THEN CASE WHEN k % 2 = 0 THEN p_size::DECIMAL(18,2) END WHEN 8 THEN k::DECIMAL(18,2) END AS number,
            CASE form WHEN 9 THEN CASE WHEN k % 2 = 0 THEN '10' END WHEN 11 THEN (k * 10 + k % 9)::VARCHAR END AS explicit FROM base),
        met AS (SELECT d.description_id, count(*) AS n, min(c.id) AS one FROM said d JOIN held c ON c.user_id = d.user_id AND c.kind = d.kind
            WHERE explicit IS NULL AND NOT ended AND (part IS NULL OR contains(names, part)) AND (object IS NULL OR contains(objects, object)) AND (d.dimension IS NULL OR coalesce(c.dimension = d.dimension, false)) AND (d.key IS NULL OR coalesce(c.key = d.key, false))
                AND (d.year IS NULL OR coalesce(c.year = d.year, false)) AND coalesce(c.action = d.action, true) AND coalesce(c.text = d.text, true) AND coalesce(c.number = d.number, true) GROUP BY 1),
        told AS (SELECT d.*, n, one, c.ended FROM said d LEFT JOIN met USING (description_id) LEFT JOIN held c ON c.user_id = d.user_id AND c.kind = d.kind AND c.id = d.explicit),
        r AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN explicit IS NULL THEN 'target_kind_missing' ELSE 'explicit_id_requires_kind' END
            WHEN explicit IS NOT NULL THEN CASE WHEN ended IS NULL THEN 'explicit_reference_invalid' WHEN ended THEN 'target_not_effective' ELSE 'explicit_validated_reference' END
            WHEN n IS NULL THEN 'no_effective_semantic_match' WHEN n > 1 THEN 'multiple_plausible_targets' ELSE 'unique_effective_match' END AS reason FROM told)
        SELECT user_id, description_id, CASE WHEN reason IN ('explicit_validated_reference', 'unique_effective_match') THEN 'resolved' WHEN reason = 'multiple_plausible_targets' THEN 'ambiguous' ELSE 'unresolved' END AS status, reason,
            CASE reason WHEN 'explicit_validated_reference' THEN explicit WHEN 'unique_effective_match' THEN one ELSE '' END AS target_id, coalesce(n, CASE WHEN reason = 'explicit_validated_reference' THEN 1 ELSE 0 END) AS n FROM r""",
    "one_users_graph": 'SELECT user_id, status, "at", n_values, value, n_unknown FROM (' + _latest_measure("true") + ") WHERE dimension = 'click' AND user_id = (SELECT arg_max(user_id, n * 1000000000 + user_id) FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))",
}
