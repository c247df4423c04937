"""SQL of claims, envelopes, catalogues, clarification and query building."""

from __future__ import annotations

from veritempo.functions import vocabulary as V
from veritempo.oracle import _ATTRIBUTE, _CONCEPT, _CORRECTION, _EFFECTIVE, _ENTITY, _EVENT, _FACT, _MEASUREMENT, _STATE, _fold, _slug, _with
from veritempo.oracle_rules import _list, _one_of
from veritempo.oracle_users import _TWO_ENTITIES, _USERS
from veritempo.queries_claims import DIMENSIONS, KINDS, OBJECTS, ORIGINS, PERIODS, PREDICATES, REPLIES, SUBJECTS, VALUES


def _case(column: str, table: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_one_of(column, words)} THEN '{key}'" for key, words in table.items()) + " END"


def _relation(text: str) -> str:
    """As the operator's, for predicates that are neither keys nor bare names of keys but for those listed."""
    dotted = f"'relation.' || replace({_fold(text)}, ' ', '_')"
    return f"coalesce(CASE WHEN {_one_of(dotted, [*V.RELATION_ALIASES, *V.INVERSE_RELATIONS])} THEN {dotted} END, {_case(_fold(text), V.RELATION_ALIASES)}, 'relation.learned.' || {_slug(text)})"


_CLAIMS = f"""
claims AS (SELECT l_orderkey AS p, l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10 AS position, {_list(ORIGINS)}[l_partkey % 5 + 1] AS origin, {_list(KINDS)}[(l_orderkey + l_linenumber * 3) % 7 + 1] AS kind, {_list(SUBJECTS)}[l_suppkey % 4 + 1] AS subject,
    {_list(OBJECTS)}[(l_partkey + l_suppkey) % 3 + 1] AS object, {_list(PREDICATES)}[l_suppkey % 4 + 1] AS predicate, {_list(DIMENSIONS)}[l_partkey % 5 + 1] AS dimension, {_list(VALUES)}[(l_orderkey + l_linenumber * 3) % 4 + 1] AS value FROM lineitem),
keyed AS (SELECT *, CASE kind WHEN 'relation' THEN {_relation("predicate")} WHEN 'measurement' THEN CASE dimension WHEN 'peso' THEN 'weight' WHEN 'temperatura, ontem' THEN 'temperature' END WHEN 'attribute' THEN {_case("dimension", V.DIMENSION_ALIASES)} WHEN 'intrinsic_property' THEN {_case("dimension", V.DIMENSION_ALIASES)} END AS key FROM claims),
judged AS (SELECT *, CASE WHEN origin = 'assumed' THEN 'assumed_dropped' WHEN origin = 'derived' THEN 'derived_not_materialized' WHEN kind = 'intrinsic_property' AND key IS DISTINCT FROM 'name' THEN 'unsupported_intrinsic' WHEN kind = 'attribute' AND (key IS NULL OR value IS NULL) THEN 'unsupported_attribute_dimension'
    WHEN kind = 'relation' AND (key IS NULL OR subject IS NULL) THEN 'unsupported_relation_predicate' WHEN kind = 'measurement' AND (key IS NULL OR value IS NULL OR value = 'azul') THEN 'unsupported_measurement' WHEN kind = 'mood' THEN 'unsupported_kind' END AS reason FROM keyed),
stated AS (SELECT *, CASE WHEN origin = 'assumed' THEN 'rejected' WHEN origin = 'derived' THEN 'deferred' WHEN reason IS NOT NULL THEN 'unsupported' WHEN kind IN ('entity', 'classification', 'intrinsic_property') OR key = 'name' THEN 'bound' ELSE 'overlaid' END AS status FROM judged),
copied AS (SELECT *, row_number() OVER (PARTITION BY p, status, kind, key, subject, CASE WHEN kind = 'relation' THEN object END ORDER BY position) AS copy FROM stated),
turned AS (SELECT *, count(*) FILTER (status = 'overlaid' AND copy = 1) OVER (PARTITION BY p, kind ORDER BY position) AS turn FROM copied),
laid AS (SELECT *, CASE WHEN status = 'overlaid' THEN CASE WHEN copy > 1 THEN 'duplicate' WHEN turn = 1 THEN 'primary' ELSE 'additional' END END AS slot FROM turned)"""

_OUTCOMES = ["ok", "ok", "json", "ok", "wire", "canonical", "ok", "provider"]

SQL: dict[str, str] = {
    "claim_overlay": f"WITH{_CLAIMS} SELECT origin, kind, key, status, reason, slot, count(*) AS n FROM laid GROUP BY ALL",
    "claim_reports": f"""WITH{_CLAIMS}, t AS (SELECT p, count(*) AS received, count(*) FILTER (status = 'overlaid') AS overlaid, count(*) FILTER (status = 'bound') AS bound, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'unsupported') AS unsupported,
            bool_or(slot = 'primary' AND kind = 'relation') AS r, bool_or(slot = 'primary' AND kind = 'attribute') AS a, bool_or(slot = 'primary' AND kind = 'measurement') AS m FROM laid GROUP BY 1)
        SELECT o_orderkey AS proposal_id, coalesce(received, 0) AS received, coalesce(overlaid, 0) AS overlaid, coalesce(bound, 0) AS bound, coalesce(rejected, 0) AS rejected, coalesce(deferred, 0) AS deferred, coalesce(unsupported, 0) AS unsupported,
            CASE WHEN o_orderkey % 4 = 0 THEN 'record_event' WHEN r THEN 'record_relation' WHEN a THEN 'record_attribute' WHEN m THEN 'record_measurement' WHEN o_orderkey % 3 = 0 THEN 'record_state' WHEN o_orderkey % 2 = 0 THEN 'correct' ELSE 'none' END AS intent
        FROM orders LEFT JOIN t ON p = o_orderkey""",
    "identity_mentions": f"""WITH{_CLAIMS}, e AS (SELECT p, position, CASE WHEN kind IN ('attribute', 'intrinsic_property', 'measurement', 'classification') THEN [subject] WHEN kind = 'relation' THEN [subject, object] ELSE [coalesce(subject, object)] END AS ends FROM claims WHERE origin = 'explicit'),
        u AS (SELECT p, position, unnest(range(len(ends))) AS "end", unnest(ends) AS text FROM e UNION ALL SELECT o_orderkey, 1 << 30, 0, 'meu gato' FROM orders WHERE o_orderkey % 3 = 0),
        g AS (SELECT p, text, min((position, "end")) AS place FROM u WHERE text IS NOT NULL GROUP BY 1, 2)
        SELECT p AS proposal_id, text, row_number() OVER (PARTITION BY p ORDER BY place, text)::INT AS position FROM g""",
    "identity_naming": """WITH m AS (SELECT l_orderkey AS p, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN ['irmã', 'gata', 'Rex'][l_partkey % 3 + 1] ELSE ['Ana', 'Rex', 'Mia'][l_partkey % 3 + 1] END AS text, l_partkey % 5 = 0 AS person FROM lineitem),
        r AS (SELECT p, min((text, CASE WHEN person THEN 'person' ELSE 'thing' END)) FILTER (n = 1) AS role, min((text, CASE WHEN person THEN 'person' ELSE 'thing' END)) FILTER (n = 2) AS name FROM m GROUP BY 1),
        f AS (SELECT p AS proposal_id, name[1] AS name, role[1] AS role, CASE WHEN name[2] = 'person' OR role[2] = 'person' THEN 'person_role' WHEN p % 2 = 0 THEN 'owned_instance' END AS fold FROM r WHERE lower(role[1]) != lower(name[1]))
        SELECT * FROM f WHERE fold IS NOT NULL""",
    "envelope_dispatch": f"""WITH t AS (SELECT (o_orderkey + o_custkey) % {len(REPLIES)} AS i FROM orders)
        SELECT CASE WHEN i IN (0, 7) THEN 'v2_canonical' WHEN i = 1 THEN 'semantic_v3' ELSE 'invalid' END AS route, CASE i WHEN 2 THEN 'non_json_text' WHEN 3 THEN 'empty_response' WHEN 4 THEN 'wrong_ir_kind' WHEN 5 THEN 'malformed_json' WHEN 6 THEN 'multiple_json_objects' END AS failure, count(*) AS n FROM t GROUP BY ALL""",
    "wire_mapping": """WITH w AS (SELECT o_orderkey AS k, 'c:' || o_custkey AS c, 'o:' || o_orderkey AS o, ['relation.owns', 'relation.child_of', 'relation.employs'][o_orderkey % 3 + 1] AS r, o_orderkey % 4 != 0 AS rel FROM orders)
        SELECT k, CASE WHEN k % 6 = 0 THEN 'record_event' ELSE 'none' END AS intent, CASE WHEN k % 3 = 0 THEN 'event.order' ELSE '' END AS event_type, CASE WHEN k % 3 != 0 THEN '' WHEN k % 2 = 0 THEN 'scheduled' ELSE 'completed' END AS status,
            CASE WHEN NOT rel THEN '' ELSE CASE r WHEN 'relation.child_of' THEN 'relation.parent_of' WHEN 'relation.employs' THEN 'relation.employed_by' ELSE r END END AS relation, CASE WHEN NOT rel THEN '' WHEN r = 'relation.owns' THEN c ELSE o END AS subject, CASE WHEN NOT rel THEN '' WHEN r = 'relation.owns' THEN o ELSE c END AS object,
            CASE WHEN NOT rel THEN '' WHEN k % 5 = 0 THEN 'terminate' ELSE 'assert' END AS mode, CASE WHEN k % 7 = 0 THEN 0.75 ELSE 1 END::DECIMAL(4,2) AS confidence FROM w""",
    "ontology_view": f"{_with(_CONCEPT, recursive=True)}, c AS (SELECT DISTINCT split_part(concept, '.', 1) AS kind, concept FROM concept) SELECT kind, count(*) AS n, string_agg(concept, ' ' ORDER BY concept) AS keys FROM c GROUP BY 1",
    "allowed_keys": f"{_with(_ENTITY)} SELECT CASE WHEN entity_id LIKE 's:%' THEN 'event' ELSE 'entity' END AS kind, type_key AS key, entity_id NOT LIKE 's:%' AS allowed, count(*) AS n FROM entity GROUP BY ALL",
    "learned_concepts": """WITH s AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'relation.learned.' WHEN 1 THEN 'entity.learned.' ELSE 'relation.' END || lower(o_orderstatus) || (o_custkey % 5) AS key FROM orders)
        SELECT key, count(*) AS n FROM s WHERE contains(key, '.learned.') AND key NOT IN ('relation.learned.f1', 'entity.learned.o2') GROUP BY 1""",
    "event_preservation": """WITH k AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN ['event.intent', 'event.order'][o_orderkey % 2 + 1] END AS made, CASE o_orderkey % 4 WHEN 0 THEN 'event.intent' WHEN 1 THEN 'event.order' END AS type FROM orders)
        SELECT CASE WHEN k % 2 = 0 THEN k % 3 = 0 OR k % 5 = 0 END AS preserved, coalesce(made = 'event.intent', false) AND type IS DISTINCT FROM 'event.intent' AND NOT (k % 14 = 0) AS false_type, count(*) AS n FROM k GROUP BY ALL""",
    "observable_groups": f"""{_with(_FACT, _MEASUREMENT, _CORRECTION, _EFFECTIVE)},
        g AS (SELECT user_id, dimension, value, unit, count(*) FILTER (observed_at >= TIMESTAMP '2024-01-10' AND observed_at < TIMESTAMP '2024-01-11') AS a, count(*) AS b FROM measured GROUP BY ALL),
        s AS (SELECT *, max(a) OVER (PARTITION BY user_id, dimension) > 0 AS known FROM g)
        SELECT user_id, dimension, CASE WHEN known THEN 'scope' ELSE 'candidates' END AS taken_from, count(*) AS n_groups, sum(CASE WHEN known THEN a ELSE b END)::BIGINT AS support FROM s WHERE NOT known OR a > 0 GROUP BY ALL""",
    "interpreter_metrics": f"""WITH c AS (SELECT event_type, {_list(_OUTCOMES)}[event_id % 8 + 1] AS o, floor(abs(value) * 10)::BIGINT AS ms, event_id % 100 AS p, event_id % 7 AS q FROM events),
        g AS (SELECT event_type, count(*) AS attempts, count(*) FILTER (o IN ('ok', 'canonical')) AS calls, count(*) FILTER (o = 'json') AS json_failures, count(*) FILTER (o = 'wire') AS wire_failures, count(*) FILTER (o = 'canonical') AS canonical_failures, round(avg(ms), 2) AS mean_latency, sum(p)::BIGINT AS prompt_tokens, sum(q)::BIGINT AS completion_tokens FROM c GROUP BY 1)
        SELECT *, round((attempts - json_failures) / attempts, 4) AS json_rate, round(calls / (calls + wire_failures), 4) AS wire_rate FROM g""",
    "owned_tie_break": """WITH t AS (SELECT o_custkey AS owner, 'o:' || o_orderkey AS e, o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 0),
        g AS (SELECT owner, count(*) AS n, min(e) AS one, max(e) FILTER (k % 35 = 0) AS last, count(*) FILTER (k % 15 = 0) AS n_recent, min(e) FILTER (k % 15 = 0) AS recent FROM t GROUP BY 1)
        SELECT c_custkey AS mention_id, CASE WHEN n IS NULL THEN 'create_candidate' WHEN n = 1 OR last IS NOT NULL OR n_recent = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one WHEN last IS NOT NULL THEN last WHEN n_recent = 1 THEN recent ELSE '' END AS entity_id,
            CASE WHEN n = 1 THEN 'only' WHEN last IS NOT NULL THEN 'last_of_type' WHEN n_recent = 1 THEN 'recent' ELSE '' END AS why FROM customer LEFT JOIN g ON owner = c_custkey""",
    "clarification_recovery": """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 2 + 5 ELSE o_orderkey % 2 + 1 END::BIGINT AS user_id, ['open', 'open', 'resolved', 'open', 'cancelled'][o_orderkey % 5 + 1] AS state, CASE o_orderkey % 4 WHEN 0 THEN 'subject' WHEN 1 THEN 'dimension' ELSE 'value' END AS slot,
            CASE WHEN o_orderkey % 7 = 0 THEN 'peso' ELSE '12,5' END AS answered, CASE o_orderkey % 3 WHEN 0 THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN 'peso' ELSE '12,5' END AS text, o_custkey AS c FROM orders),
        v AS (SELECT *, CASE k % 3 WHEN 0 THEN CASE WHEN c IN (SELECT c_custkey FROM customer) AND (user_id = 1 OR (user_id = 2 AND c % 2 = 0)) THEN 'c:' || c END WHEN 1 THEN 'weight' ELSE '12.50' END AS value FROM a),
        o AS (SELECT user_id, value, CASE WHEN k % 11 = 0 THEN 'rejected' WHEN state = 'resolved' AND answered = text THEN 'replay' WHEN state != 'open' OR k % 3 >= 2 THEN 'closed' WHEN NOT ((k % 3 = 0 AND slot = 'subject') OR (k % 3 = 1 AND slot = 'dimension') OR (k % 3 = 2 AND slot = 'value')) THEN 'unsupported_slot'
            WHEN value IS NOT NULL THEN 'recovered' ELSE 'asked_again' END AS outcome FROM v)
        SELECT user_id, outcome, count(*) AS n, max(CASE WHEN outcome = 'recovered' THEN value END) AS last_filled FROM o GROUP BY 1, 2""",
    "query_building": f"""{_with(_ENTITY, _USERS, _TWO_ENTITIES)}, e AS (SELECT event_id AS k, (event_id % 2 + 1)::BIGINT AS user_id, ts, CASE WHEN event_id % 2 = 0 THEN INTERVAL (-180) MINUTE ELSE INTERVAL 330 MINUTE END AS z, CASE WHEN event_id % 4 != 0 THEN 'customer#' || lpad((event_id % 300)::VARCHAR, 9, '0') END AS name, CASE WHEN event_id % 3 != 0 THEN {_list(PERIODS)}[event_id % 8 + 1] END AS period FROM events),
        n AS (SELECT user_id, lower(name) AS low, count(*) AS n, min(entity_id) AS entity_id FROM entity2 GROUP BY 1, 2),
        d AS (SELECT e.*, n.n, n.entity_id, (ts + z)::DATE AS d FROM e LEFT JOIN n ON n.user_id = e.user_id AND n.low = e.name),
        s AS (SELECT *, CASE period WHEN 'today' THEN d WHEN 'yesterday' THEN d - 1 WHEN 'this_week' THEN date_trunc('week', d) WHEN 'last_week' THEN date_trunc('week', d) - INTERVAL 7 DAY WHEN 'this_month' THEN date_trunc('month', d) WHEN 'last_month' THEN date_trunc('month', d) - INTERVAL 1 MONTH END::TIMESTAMP - z AS a,
            CASE period WHEN 'today' THEN d + 1 WHEN 'yesterday' THEN d WHEN 'this_week' THEN date_trunc('week', d) + INTERVAL 7 DAY WHEN 'last_week' THEN date_trunc('week', d) WHEN 'this_month' THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 'last_month' THEN date_trunc('month', d) END::TIMESTAMP - z AS b FROM d),
        r AS (SELECT *, CASE WHEN k % 5 = 0 THEN ts WHEN period = 'now' THEN ts ELSE a END AS s0, CASE WHEN k % 10 = 0 THEN ts - INTERVAL 1 HOUR WHEN k % 5 = 0 THEN ts + INTERVAL 1 HOUR WHEN period = 'now' THEN ts + INTERVAL 1 MICROSECOND ELSE b END AS s1 FROM s)
        SELECT user_id, k AS request_id, ['relation.employed_by', 'relation.parent_of', 'relation.learned.gosta_muito_de'][k % 3 + 1] AS relation, k % 3 = 1 AS swapped, CASE WHEN n = 1 THEN entity_id ELSE '' END AS entity_id, coalesce(strftime(s0, '%Y-%m-%d %H:%M:%S'), '') AS start, coalesce(strftime(s1, '%Y-%m-%d %H:%M:%S'), '') AS "end",
            CASE WHEN period IS NOT NULL AND k % 5 = 0 THEN 'time_twice' WHEN period = 'some_time' THEN 'period_unknown' WHEN k % 10 = 0 THEN 'range_empty' WHEN name IS NOT NULL AND n IS NULL THEN 'entity_unresolved' WHEN n > 1 THEN 'entity_ambiguous' ELSE '' END AS error FROM r""",
    "event_items_matched": f"{_with(_EVENT)}, i AS (SELECT actor_id, event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS t FROM event) SELECT actor_id, position::INT AS position, event_id, matched_count FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY t DESC, event_id DESC) AS position, count(*) OVER (PARTITION BY actor_id) AS matched_count FROM i) WHERE position <= 3",
    "assertion_listing": f"""{_with(_STATE, _ATTRIBUTE, _MEASUREMENT)}, l AS (SELECT 'state' AS kind, entity_id, state_id AS id, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at, state_id) AS position FROM state
        UNION ALL SELECT 'attribute', entity_id, attribute_id, row_number() OVER (PARTITION BY entity_id, dimension ORDER BY attribute_id) FROM attribute
        UNION ALL SELECT 'measurement', user_id::VARCHAR, measurement_id, row_number() OVER (PARTITION BY user_id, dimension ORDER BY coalesce(observed_at, TIMESTAMP '1900-01-01'), measurement_id) FROM measurement)
        SELECT kind, entity_id, id::VARCHAR AS id, position::INT AS position FROM l""",
    "concept_conflicts": f"""{_with(_CONCEPT, recursive=True)}, every AS (SELECT * FROM concept UNION ALL SELECT 'entity.part.' || lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN 'entity.brand.' || lower(p_brand) ELSE 'entity.product' END FROM part)
        SELECT concept, count(DISTINCT coalesce(parent, '')) AS parents FROM every GROUP BY 1 HAVING count(DISTINCT coalesce(parent, '')) > 1""",
    # Every request against every event.
    "counts_in_many_ranges": f"""{_with(_EVENT)}, u AS (SELECT * FROM (VALUES (1::BIGINT), (2::BIGINT)) AS t(user_id)),
        asked AS (SELECT user_id, c_custkey AS request_id, DATE '1992-06-01' + (c_custkey * 37 % 2000)::INT AS a, [1, 7, 31, 365, 1000][c_custkey % 5 + 1] AS days FROM customer, u WHERE user_id = 1 OR c_custkey % 2 = 0),
        held AS (SELECT user_id, event_id, w_start, w_end FROM event, u WHERE user_id = 1 OR event_id % 2 = 0),
        m AS (SELECT user_id, request_id, CASE WHEN w_start IS NULL THEN 'unknown' WHEN w_start >= a AND w_end <= a + days THEN 'match' WHEN w_end <= a OR w_start >= a + days THEN 'no_match' ELSE 'unknown' END AS m FROM asked JOIN held USING (user_id)),
        g AS (SELECT user_id, request_id, count(*) FILTER (m = 'match') AS n, count(*) FILTER (m = 'unknown') AS n_unknown FROM m GROUP BY 1, 2)
        SELECT user_id, request_id, n, n_unknown, CASE WHEN n_unknown > 0 THEN 'partial' ELSE 'complete' END AS completeness FROM g""",
    # Every chain is followed step by step, up to forty of them.
    "correction_chains": """WITH RECURSIVE u AS (SELECT * FROM (VALUES (1::BIGINT), (2::BIGINT)) AS t(user_id)),
        c AS (SELECT user_id, o_orderkey AS t, CASE WHEN o_orderkey % 10 = 0 THEN 'retract' ELSE 'replace' END AS action, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 50 = 43 THEN o_orderkey - 2 * user_id ELSE o_orderkey + user_id END AS r, o_orderkey % 70 = 25 AS twice
            FROM orders, u WHERE (user_id = 1 OR o_orderkey % 2 = 0) AND (o_orderkey % 10 != 0 OR o_orderkey % 30 = 0)),
        walk AS (
            SELECT user_id, t AS target_id, t AS pos, 0 AS steps, t AS least, 'open' AS outcome FROM c
            UNION ALL
            SELECT w.user_id, w.target_id, CASE WHEN c.t IS NULL OR c.twice OR c.action = 'retract' THEN w.pos ELSE c.r END, w.steps + CASE WHEN c.t IS NULL OR c.twice THEN 0 ELSE 1 END, least(w.least, coalesce(CASE WHEN NOT c.twice THEN c.r END, w.least)),
                CASE WHEN c.t IS NULL THEN 'replaced' WHEN c.twice THEN 'branched' WHEN c.action = 'retract' THEN 'retracted' WHEN w.steps >= 40 THEN 'cycle' ELSE 'open' END
            FROM walk w LEFT JOIN c ON c.user_id = w.user_id AND c.t = w.pos WHERE w.outcome = 'open')
        SELECT user_id, target_id, CASE WHEN outcome = 'cycle' THEN least ELSE pos END AS last_id, CASE WHEN outcome = 'cycle' THEN -1 ELSE steps END::INT AS steps, outcome FROM walk WHERE outcome != 'open'""",
    # The same fold, turn by turn, in lists.
    "discourse_states": """WITH RECURSIVE u AS (SELECT * FROM (VALUES (1::BIGINT), (2::BIGINT)) AS t(user_id)),
        raw AS (SELECT u.user_id, event_id AS k, event_id % 20 AS conv_id, event_type AS dim, 'e:' || event_id % 7 AS one, 'e:' || event_id % 5 AS two FROM events, u WHERE u.user_id = 1 OR event_id % 2 = 0),
        turns AS (SELECT *, row_number() OVER (PARTITION BY user_id, conv_id ORDER BY k) AS n, CASE WHEN k % 11 = 0 THEN 'pending' WHEN k % 13 = 0 THEN 'clarify' WHEN k % 2 = 0 THEN 'query' ELSE 'write' END AS kind, k % 5 != 1 AS ok,
                CASE WHEN k % 4 = 3 THEN [] WHEN k % 3 = 0 THEN CASE WHEN one = two THEN [one] ELSE [one, two] END ELSE [one] END AS ids, CASE WHEN two = 'e:1' THEN ['e:1'] ELSE ['e:1', two] END AS asked FROM raw),
        f AS (
            SELECT user_id, conv_id, 0::BIGINT AS n, []::VARCHAR[] AS focus, NULL::VARCHAR AS target_type, []::STRUCT(e VARCHAR, s DOUBLE)[] AS refs, NULL::VARCHAR AS pending, 0 AS idle, NULL::VARCHAR AS reason FROM turns GROUP BY 1, 2
            UNION ALL
            SELECT user_id, conv_id, n_next, CASE WHEN commits THEN ids WHEN clears THEN [] ELSE focus END, CASE WHEN commits THEN 't:' || split_part(one, ':', 2) WHEN clears THEN NULL ELSE target_type END,
                CASE WHEN kind = 'pending' THEN list_concat(list_transform(list_reverse(asked), lambda x: {'e': x, 's': 0.9}), list_filter(refs, lambda r: NOT list_contains(asked, r.e)))[1:8]
                    WHEN commits THEN list_concat(list_transform(list_reverse(ids), lambda x: {'e': x, 's': 1.0}), list_transform(old, lambda x: {'e': x, 's': 0.6}), list_filter(faded, lambda r: NOT list_contains(ids, r.e) AND NOT list_contains(old, r.e)))[1:8]
                    WHEN clears THEN faded ELSE refs END,
                CASE WHEN kind = 'pending' THEN dim WHEN commits AND (kind = 'query' OR k % 6 != 1) THEN NULL ELSE pending END,
                CASE WHEN kind IN ('pending', 'clarify') THEN idle WHEN commits THEN 0 ELSE idle + 1 END,
                CASE WHEN kind = 'pending' THEN 'pending_query_stored' WHEN commits THEN CASE WHEN len(focus) > 0 AND len(old) = len(focus) THEN 'topic_switch' WHEN kind = 'query' THEN 'successful_query' WHEN k % 9 = 0 THEN 'successful_attribute_write' ELSE 'successful_write' END WHEN clears THEN 'idle_cleared' ELSE reason END
            FROM (SELECT f.*, t.* EXCLUDE (user_id, conv_id, n), kind IN ('query', 'write') AND len(ids) > 0 AND (kind = 'query' OR ok) AS commits, kind IN ('query', 'write') AND NOT (len(ids) > 0 AND (kind = 'query' OR ok)) AND idle + 1 > 8 AS clears, t.n AS n_next,
                    list_filter(focus, lambda x: NOT list_contains(ids, x)) AS old, list_filter(list_transform(refs, lambda r: {'e': r.e, 's': format('{:.3f}', r.s * 0.85::DOUBLE)::DOUBLE}), lambda r: r.s >= 0.2) AS faded
                FROM f JOIN turns t ON t.user_id = f.user_id AND t.conv_id = f.conv_id AND t.n = f.n + 1) s),
        last AS (SELECT *, row_number() OVER (PARTITION BY user_id, conv_id ORDER BY n DESC) AS back FROM f)
        SELECT user_id, conv_id, n AS turns, array_to_string(focus, ' ') AS focus, coalesce(target_type, '') AS target_type, array_to_string(list_transform(refs, lambda r: r.e || '=' || format('{:.3f}', r.s)), ' ') AS referents, coalesce(pending, '') AS pending, idle::BIGINT AS idle, coalesce(reason, '') AS reason FROM last WHERE back = 1""",
}
