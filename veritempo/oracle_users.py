"""SQL of the queries over two users, per-entity lists, and the branches of the typed query."""

from __future__ import annotations

from veritempo.oracle import _ATTRIBUTE, _CONCEPT, _CORRECTION, _ENTITY, _EVENT, _FACT, _MEASUREMENT, _PARTICIPANT, _RELATION, _STATE, _YEAR, _current_state, _latest_measure, _lookup, _membership, _with
from veritempo.oracle import ORACLE_SQL as _BASE

_USERS = """
users AS (SELECT * FROM (VALUES (1::BIGINT), (2::BIGINT)) AS u(user_id))"""
_TWO_EVENTS = """
event2 AS (SELECT user_id, event.* FROM users JOIN event ON user_id = 1 OR event_id % 2 = 0)"""
_TWO_FACTS = """
fact2 AS (SELECT user_id, fact.* FROM users JOIN fact ON user_id = 1 OR (about_id % 2 = 0 AND supersedes_id IS NULL)),
correction2 AS (SELECT user_id, fact_id AS target_id FROM fact2 WHERE CASE WHEN user_id = 1 THEN fact_id % 17 = 0 OR fact_id % 19 = 0 ELSE fact_id % 13 = 0 END)"""
_TWO_ENTITIES = """
entity2 AS (SELECT user_id, entity.* FROM users JOIN entity ON user_id = 1 OR split_part(entity_id, ':', 2)::BIGINT % 2 = 0)"""
_CURRENT = "fact_id NOT IN (SELECT supersedes_id FROM fact WHERE supersedes_id IS NOT NULL) OR user_id = 2"
_EFFECTIVE = "(user_id, fact_id) NOT IN (SELECT (user_id, target_id) FROM correction2)"


def _sums(keys: str, more: str = "true") -> str:
    return f"""{_with(_EVENT, _FACT, _USERS, _TWO_EVENTS, _TWO_FACTS)},
        marked AS (SELECT *, {_membership(*_YEAR)} AS m FROM event2),
        g AS (SELECT {keys}, sum(CASE WHEN m = 'match' AND f.fact_id IS NOT NULL THEN amount END) AS s, count(f.fact_id) FILTER (m = 'match') AS n_facts
            FROM marked LEFT JOIN (SELECT user_id AS u, * EXCLUDE (user_id, created_at) FROM fact2 WHERE currency = 'BRL' AND ({_CURRENT}) AND {more}) f ON u = user_id AND about_id = event_id WHERE m != 'no_match' GROUP BY ALL),
        o AS (SELECT {keys}, count(*) FILTER (m = 'unknown') AS n_unknown_events FROM marked WHERE m != 'no_match' GROUP BY ALL)
        SELECT {keys}, coalesce(s, 0)::DECIMAL(28,2) AS total, n_facts, n_unknown_events FROM g JOIN o USING ({keys}) WHERE n_facts > 0 OR n_unknown_events > 0"""


def _event_lists(where: str, limit: int) -> str:
    return f"""{_with(_EVENT, _USERS, _TWO_EVENTS)}, m AS (SELECT user_id, event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS t FROM event2 WHERE {where}),
        n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)::INT AS position, event_id, count(*) OVER (PARTITION BY user_id) AS matched_count FROM m)
        SELECT * FROM n WHERE position <= {limit}"""


SQL: dict[str, str] = {
    "isolated_effective": f"{_with(_FACT, _USERS, _TWO_FACTS)} SELECT user_id, currency, count(*) AS n, sum(amount) AS total FROM fact2 WHERE {_EFFECTIVE} GROUP BY 1, 2",
    "isolated_current_facts": f"{_with(_FACT, _USERS, _TWO_FACTS)} SELECT user_id, count(*) AS n, sum(amount) AS total FROM fact2 WHERE {_CURRENT} GROUP BY 1",
    "isolated_sums": _sums("user_id, actor_id"),
    "isolated_event_list": f"{_with(_EVENT)} SELECT 2::BIGINT AS user_id, event_id FROM event WHERE event_id % 2 = 0 AND event_id IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 2 = 0)",
    "isolated_context": f"{_with(_EVENT, _USERS, _TWO_EVENTS)} SELECT user_id, count(*) AS n, max(event_id) AS last FROM event2 WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2) GROUP BY 1",
    "isolated_walk": f"""{_with(_USERS)},
        near AS (SELECT user_id, r_regionkey AS r, n_nationkey AS n FROM users JOIN region ON user_id = 1 OR r_regionkey % 2 = 0 LEFT JOIN nation ON n_regionkey = r_regionkey AND (user_id = 1 OR n_nationkey % 2 = 0)),
        far AS (SELECT user_id, r, c_custkey AS c FROM near JOIN customer ON c_nationkey = n AND c_custkey % 7 != 0 AND (user_id = 1 OR c_custkey % 2 = 0))
        SELECT user_id, 'r:' || r AS seed, 0 AS depth, 1::BIGINT AS n FROM (SELECT DISTINCT user_id, r FROM near) UNION ALL
        SELECT user_id, 'r:' || r, 1, count(*) FROM near WHERE n IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT user_id, 'r:' || r, 2, count(*) FROM far GROUP BY 1, 2""",
    "isolated_resolution": f"{_with(_USERS)} SELECT user_id, CASE WHEN user_id = 1 OR c_custkey % 2 = 0 THEN 'resolved' ELSE 'unresolved' END AS status, count(*) AS n, max(CASE WHEN user_id = 1 OR c_custkey % 2 = 0 THEN 'c:' || c_custkey END) AS last FROM users, customer GROUP BY 1, 2",
    "isolated_correction_errors": f"""{_with(_FACT, _USERS, _TWO_FACTS)} SELECT 2::BIGINT AS user_id, 'fact' AS kind, 'target_missing' AS reason, count(*) AS n FROM correction2 c
        WHERE user_id = 1 AND target_id NOT IN (SELECT fact_id FROM fact2 WHERE user_id = 2)""",
    "visible_ids": """WITH asked AS (SELECT (o_orderkey % 3 % 2 + 1)::BIGINT AS user_id, o_orderkey AS request_id, o_custkey AS c, o_orderkey % 2 = 0 AS region, o_orderkey % 4 = 0 AS bare, (o_orderkey % 5 = 0 AND o_orderkey % 2 = 0) OR o_orderkey % 7 = 0 AS free FROM orders),
        hidden AS (SELECT *, list_sort(list_filter([CASE WHEN (user_id = 2 AND c % 2 != 0) OR c NOT IN (SELECT c_custkey FROM customer) THEN 'c:' || c END, CASE WHEN user_id = 2 AND request_id % 2 != 0 THEN request_id::VARCHAR END], lambda x: x IS NOT NULL)) AS h FROM asked)
        SELECT user_id, request_id, CASE WHEN bare AND NOT free THEN 'association_missing' WHEN len(h) > 0 THEN 'isolation' END AS error, len(h) AS n_hidden, h[1] AS first_hidden FROM hidden""",
    "user_facts_with_sources": f"{_with(_FACT, _USERS, _TWO_FACTS)} SELECT currency, count(*) AS n, max(source_id) AS last_source FROM fact2 WHERE user_id = 2 AND source_id < 50 GROUP BY 1",
    "fact_items": f"{_with(_EVENT, _FACT)} SELECT fact_id, about_id AS event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS event_time, amount, currency, source_id, supersedes_id::VARCHAR AS supersedes_id, fact_id IN (SELECT fact_id FROM current_fact) AS is_current FROM fact JOIN event ON about_id = event_id",
    "relations_for_entity": f"""{_with(_RELATION)}, r AS (SELECT * FROM relation WHERE key IN ('resides_at', 'located_in')),
        ends AS (SELECT from_id AS entity_id, * FROM r WHERE from_id LIKE 'n:%' OR from_id LIKE 'r:%' UNION ALL SELECT to_id, * FROM r)
        SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(day, TIMESTAMP '1900-01-01'), relation_id)::INT AS position, relation_id, is_current FROM ends""",
    "entity_card": f"""{_with(_ENTITY, _RELATION, _ATTRIBUTE, _STATE)},
        items AS (SELECT from_id AS id, 'relations_out' AS list, key || ' ' || to_id AS item FROM relation WHERE is_current AND key != 'buys_from' UNION ALL SELECT to_id, 'relations_in', key || ' ' || from_id FROM relation WHERE is_current AND key != 'buys_from'
            UNION ALL SELECT entity_id, 'attributes', concat_ws(' ', dimension, coalesce(text_value, numeric_value::VARCHAR), unit) FROM attribute WHERE is_current UNION ALL SELECT entity_id, 'states', dimension || ' ' || value FROM state WHERE is_current)
        SELECT entity_id, name, list, item, count(*) AS n FROM entity JOIN items ON id = entity_id WHERE type_key IN ('entity.nation', 'entity.region') OR entity_id LIKE 'p:%' GROUP BY ALL""",
    "raw_input_sink": """WITH r AS (SELECT user_id, event_id % 700 AS raw_id FROM events),
        g AS (SELECT user_id, raw_id, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT user_id, 'inserted' AS outcome, count(*) AS n, count(*) AS n_ids FROM g WHERE raw_id % 10 != 3 GROUP BY 1
        UNION ALL SELECT user_id, 'rejected', sum(CASE WHEN raw_id % 10 = 3 THEN n ELSE n - 1 END)::BIGINT, count(*) FILTER (raw_id % 10 = 3 OR n > 1) FROM g WHERE raw_id % 10 = 3 OR n > 1 GROUP BY 1""",
    "concept_kind_guard": """SELECT 'entity.supplier' AS key, 'event' AS expected, 'kind_mismatch' AS error, count(*) AS n FROM supplier
        UNION ALL SELECT 'entity.part.' || lower(p_brand), 'entity', 'unknown', count(*) FROM part GROUP BY 1""",
    "spec_relation_boolean": """WITH c AS (SELECT * FROM customer WHERE c_custkey % 2 = 0) SELECT 'c:' || c_custkey AS subject, CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'yes' END AS answer, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS n FROM c""",
    "spec_relation_historical": "SELECT DISTINCT 's:' || l_suppkey AS subject, 'yes' AS answer FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0",
    "spec_relation_termination": _BASE["relation_termination"],
    "spec_relation_held_during": _BASE["relation_held_during"],
    "spec_relation_object_type": "SELECT 'n:' || n_nationkey AS subject, 'r:' || n_regionkey AS object, 'partial' AS completeness FROM nation",
    "spec_attribute_existence": _BASE["attr_existence"],
    "spec_attribute_proposition": f"SELECT entity_id, answer FROM ({_BASE['attr_proposition']}) WHERE split_part(entity_id, ':', 2)::BIGINT % 2 = 0",
    "spec_attribute_history": f"{_with(_ATTRIBUTE)} SELECT entity_id, attribute_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rank DESC, w_start DESC, attribute_id DESC) AS r FROM attribute WHERE NOT is_current AND dimension = 'brand') WHERE r = 1",
    "spec_measurement_proposition": f"SELECT user_id, answer, hits, n_incomparable FROM ({_BASE['meas_proposition']}) WHERE dimension = 'click'",
    "spec_measurement_latest": "SELECT user_id, status, \"at\", n_values, value, n_unknown FROM (" + _latest_measure("true") + ") WHERE dimension = 'click'",
    "spec_event_count": f"""{_with(_EVENT, _USERS, _TWO_EVENTS)}, m AS (SELECT user_id, {_membership(*_YEAR)} AS m FROM event2 WHERE status = 'completed')
        SELECT user_id, count(*) FILTER (m = 'match') AS n, count(*) FILTER (m = 'unknown') AS n_unknown, CASE WHEN count(*) FILTER (m = 'unknown') > 0 THEN 'partial' ELSE 'complete' END AS completeness FROM m WHERE m != 'no_match' GROUP BY 1""",
    "spec_event_list": f"{_with(_EVENT)} SELECT event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS event_time FROM event WHERE event_id % 2 = 0 AND actor_id IN ('c:2', 'c:4') ORDER BY event_time DESC, event_id DESC LIMIT 200",
    "spec_effective_sum": _sums("user_id", _EFFECTIVE),
    "spec_state": "SELECT entity_id, state_id::VARCHAR AS state_id, completeness FROM (" + _with(_STATE, _current_state("entity_id", "dimension = 'openness'")) + " SELECT * FROM current)",
    "spec_event_lists": f"""{_with(_EVENT, _USERS, _TWO_EVENTS)}, m AS (SELECT user_id, event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS t FROM event2 WHERE status = 'completed' AND {_membership(*_YEAR)} != 'no_match')
        SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC)::INT AS position, event_id, count(*) OVER (PARTITION BY user_id) AS matched_count FROM m) WHERE position <= 5""",
    "spec_event_objects": _event_lists("event_id IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (2, 3, 4))", 50),
    "spec_event_neighbours": _event_lists("split_part(actor_id, ':', 2)::BIGINT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (2, 4) AND (user_id = 1 OR c_custkey % 2 = 0))", 7),
    "spec_relation_asked": """SELECT 1::BIGINT AS user_id, 'boolean' AS mode, 'c:7' AS subject, 'no' AS answer UNION ALL SELECT u, 'boolean', 'c:14', 'no' FROM (VALUES (1), (2)) t(u)
        UNION ALL SELECT u, 'boolean', 'p:2', 'no' FROM (VALUES (1), (2)) t(u) UNION ALL SELECT 1, 'boolean', 'p:3', 'no' UNION ALL SELECT u, 'historical', 'n:4', 'no' FROM (VALUES (1), (2)) t(u) UNION ALL SELECT u, 'termination', 'r:2', 'no' FROM (VALUES (1), (2)) t(u)""",
    "spec_relation_of_objects": """WITH live AS (SELECT u AS user_id, c_custkey % 4 = 0 AS undated FROM customer, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE c_nationkey = 2 AND c_custkey % 7 != 0 AND (u = 1 OR c_custkey % 2 = 0)),
        g AS (SELECT user_id, (count(*) FILTER (undated) + least(count(*) FILTER (NOT undated), 1))::BIGINT AS n FROM live GROUP BY 1)
        SELECT u AS user_id, 'n:2' AS object, CASE coalesce(n, 0) WHEN 0 THEN 'no' WHEN 1 THEN 'yes' ELSE 'unknown' END AS answer, coalesce(n, 0) AS n FROM (VALUES (1::BIGINT), (2::BIGINT)) t(u) LEFT JOIN g ON user_id = u""",
    "spec_relation_pair_of_type": """SELECT u AS user_id, 'r:' || r AS object, kind, CASE WHEN kind = 'entity.region' AND r = (SELECT n_regionkey FROM nation WHERE n_nationkey = 2) AND (u = 1 OR r % 2 = 0) THEN 'yes' ELSE 'no' END AS answer
        FROM (VALUES (1::BIGINT), (2::BIGINT)) t(u), range(5) x(r), (VALUES ('entity.region'), ('entity.nation')) k(kind)""",
    "isolated_possessive": """WITH m AS (SELECT u AS user_id, c_custkey % 50 AS mention_id, CASE WHEN c_custkey % 7 != 0 AND (u = 1 OR c_nationkey % 2 = 0) THEN 'n:' || c_nationkey END AS place FROM customer, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE (u = 1 OR c_custkey % 2 = 0) AND c_custkey % 50 < 20)
        SELECT user_id, mention_id, CASE WHEN place IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, count(*) AS n, max(place) AS last FROM m GROUP BY ALL""",
    "isolated_contextual": """WITH r AS (SELECT u AS user_id, event_id % 40 AS conv_id, event_id, event_type FROM events, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE u = 1 OR event_id % 2 = 0),
        best AS (SELECT user_id, conv_id, max(event_id) FILTER (conv_id % 2 != 0 OR event_type = 'click') AS e FROM r GROUP BY 1, 2)
        SELECT user_id, conv_id AS mention_id, CASE WHEN e IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, 'e:' || e AS entity_id FROM best""",
    "isolated_referents": """WITH r AS (SELECT u AS user_id, event_id % 40 AS conv_id, event_type AS entity_id, max(event_id) AS last FROM events, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE u = 1 OR event_id % 2 = 0 GROUP BY ALL)
        SELECT user_id, conv_id, entity_id, row_number() OVER (PARTITION BY user_id, conv_id ORDER BY last DESC, entity_id)::INT AS recency FROM r""",
    "isolated_ownership": """SELECT u AS user_id, count(*) AS n, max('c:' || c_custkey) AS last FROM customer, (VALUES (1::BIGINT), (2::BIGINT)) t(u) WHERE c_custkey % 7 = 0 OR (u = 2 AND c_custkey % 2 != 0) GROUP BY 1""",
    "isolated_recovery": """WITH a AS (SELECT u AS user_id, o_orderkey % 3 AS k, u = 1 OR o_orderkey % 2 = 0 AS own FROM orders, (VALUES (1::BIGINT), (2::BIGINT)) t(u)),
        o AS (SELECT *, CASE WHEN NOT own THEN 'rejected' WHEN user_id = 2 THEN CASE WHEN k = 0 THEN 'replay' ELSE 'closed' END WHEN k = 2 THEN 'asked_again' ELSE 'recovered' END AS outcome FROM a)
        SELECT user_id, outcome, count(*) AS n, max(CASE WHEN outcome = 'recovered' THEN CASE k WHEN 0 THEN '7.00' ELSE '12.50' END END) AS last_filled FROM o GROUP BY 1, 2""",
}
