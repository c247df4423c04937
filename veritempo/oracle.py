"""The same queries in SQL over the same tables, for comparison."""

from __future__ import annotations

_ENTITY = """
entity AS (
    SELECT 'p:' || p_partkey AS entity_id, 'entity.part.' || lower(p_type) AS type_key, p_name AS name FROM part
    UNION ALL SELECT 'c:' || c_custkey, 'entity.customer', c_name FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'entity.supplier', s_name FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'entity.nation', n_name FROM nation
    UNION ALL SELECT 'r:' || r_regionkey, 'entity.region', r_name FROM region)"""
_CONCEPT = """
concept AS (
    SELECT * FROM (VALUES ('entity.party', NULL), ('entity.customer', 'entity.party'), ('entity.supplier', 'entity.party'),
        ('entity.place', NULL), ('entity.nation', 'entity.place'), ('entity.region', 'entity.place'), ('entity.product', NULL),
        ('event.any', NULL), ('event.order', 'event.any')) AS t(concept, parent)
    UNION ALL SELECT DISTINCT 'entity.part.' || lower(p_type), 'entity.product' FROM part
    UNION ALL SELECT DISTINCT 'event.order.' || lower(o_orderpriority), 'event.order' FROM orders
    UNION ALL SELECT DISTINCT 'event.' || event_type, 'event.any' FROM events),
closure AS (
    SELECT concept, concept AS ancestor, 0 AS depth FROM concept
    UNION ALL SELECT c.concept, p.parent, c.depth + 1 FROM closure c JOIN concept p ON p.concept = c.ancestor WHERE p.parent IS NOT NULL)"""
_EVENT = """
event AS (
    SELECT o_orderkey AS event_id, 'event.order.' || lower(o_orderpriority) AS type_key,
        CASE WHEN o_orderkey % 5 != 0 THEN 'action.' || lower(o_orderstatus) END AS action,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' ELSE 'pending' END AS status,
        ['domain.' || (o_orderkey % 3), 'domain.' || (o_orderkey % 4)] AS domains,
        'c:' || o_custkey AS actor_id, o_orderdate AS created_at,
        CASE o_orderkey % 10 WHEN 0 THEN date_trunc('month', o_orderdate) WHEN 1 THEN date_trunc('year', o_orderdate)
            WHEN 2 THEN NULL ELSE date_trunc('day', o_orderdate) END::TIMESTAMP AS w_start,
        CASE o_orderkey % 10 WHEN 0 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH WHEN 1 THEN date_trunc('year', o_orderdate) + INTERVAL 1 YEAR
            WHEN 2 THEN NULL ELSE date_trunc('day', o_orderdate) + INTERVAL 1 DAY END::TIMESTAMP AS w_end,
        CASE WHEN o_orderkey % 10 NOT IN (0, 1, 2) THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS instant
    FROM orders)"""
_PARTICIPANT = """
participant AS (
    SELECT o_orderkey AS event_id, 'c:' || o_custkey AS entity_id, 'role.actor' AS role FROM orders
    UNION ALL SELECT l_orderkey, 'p:' || l_partkey, 'role.object' FROM lineitem
    UNION ALL SELECT l_orderkey, 's:' || l_suppkey, 'role.context' FROM lineitem)"""
_FACT = """
fact AS (
    SELECT o_orderkey * 2 AS fact_id, o_orderkey AS about_id, o_totalprice::DECIMAL(18,2) AS amount,
        CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'BRL' END AS currency, NULL::BIGINT AS supersedes_id, o_orderkey % 100 AS source_id, o_orderdate AS created_at FROM orders
    UNION ALL SELECT o_orderkey * 2 + 1, o_orderkey, (o_totalprice::DECIMAL(18,2) * 1.1::DECIMAL(2,1))::DECIMAL(18,2),
        CASE WHEN o_orderkey % 7 = 0 THEN 'USD' ELSE 'BRL' END, o_orderkey * 2, o_orderkey % 100, date_trunc('day', o_orderdate) + INTERVAL 1 DAY FROM orders WHERE o_orderkey % 11 = 0),
current_fact AS (SELECT * FROM fact WHERE fact_id NOT IN (SELECT supersedes_id FROM fact WHERE supersedes_id IS NOT NULL))"""
_MEASUREMENT = """
measurement AS (
    SELECT event_id AS measurement_id, user_id, event_type AS dimension, value::DECIMAL(18,2) AS value,
        CASE event_id % 3 WHEN 1 THEN 'kg' WHEN 2 THEN 'g' END AS unit, CASE WHEN event_id % 13 != 0 THEN ts END AS observed_at FROM events)"""
_CORRECTION = """
correction AS (
    SELECT kind, target_id, CASE WHEN target_id % 17 = 0 THEN 'retract' ELSE 'replace' END AS action, CASE WHEN target_id % 17 != 0 THEN target_id + 1 END AS replacement_id
    FROM (SELECT 'fact' AS kind, fact_id AS target_id FROM fact UNION ALL SELECT 'measurement', measurement_id FROM measurement)
    WHERE target_id % 17 = 0 OR target_id % 19 = 0)"""
_EFFECTIVE = """
measured AS (SELECT * FROM measurement WHERE measurement_id NOT IN (SELECT target_id FROM correction WHERE kind = 'measurement'))"""
_ATTRIBUTE = """
part_day AS (SELECT *, DATE '2000-01-01' + (p_partkey % 700)::INT AS day FROM part),
attribute AS (
    SELECT p_partkey * 10 AS attribute_id, 'p:' || p_partkey AS entity_id, 'brand' AS dimension, p_brand AS text_value, NULL::DECIMAL(18,2) AS numeric_value, NULL AS unit,
        p_partkey % 5 != 0 AS is_current, day::TIMESTAMP AS w_start, day + INTERVAL 1 DAY AS w_end, 0 AS rank FROM part_day
    UNION ALL SELECT p_partkey * 10 + 1, 'p:' || p_partkey, 'type', p_type, NULL, NULL, true, date_trunc('year', day), date_trunc('year', day) + INTERVAL 1 YEAR, 1 FROM part_day
    UNION ALL SELECT p_partkey * 10 + 2, 'p:' || p_partkey, 'size', NULL, p_size::DECIMAL(18,2), 'cm', p_partkey % 6 != 0, CASE WHEN p_partkey % 4 != 0 THEN day END, CASE WHEN p_partkey % 4 != 0 THEN day + INTERVAL 1 DAY END, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END FROM part_day
    UNION ALL SELECT p_partkey * 10 + 3, 'p:' || p_partkey, 'price', NULL, p_retailprice::DECIMAL(18,2), NULL, true, day, day + INTERVAL 1 DAY, 0 FROM part_day
    UNION ALL SELECT p_partkey * 10 + 4, 'p:' || p_partkey, 'brand', p_brand || '-II', NULL, NULL, true, day + INTERVAL 30 DAY, day + INTERVAL 31 DAY, 0 FROM part_day WHERE p_partkey % 9 = 0
    UNION ALL SELECT p_partkey * 10 + 5, 'p:' || p_partkey, 'size', NULL, p_size::DECIMAL(18,2), 'cm', true, day + INTERVAL 60 DAY, day + INTERVAL 61 DAY, 0 FROM part_day WHERE p_partkey % 8 = 0)"""
_STATE = """
line AS (SELECT *, l_orderkey * 10 + l_linenumber AS k FROM lineitem),
state AS (
    SELECT k * 2 AS state_id, 'p:' || l_partkey AS entity_id, 'openness' AS dimension, l_linestatus AS value, k % 3 != 0 AS is_current, l_shipdate AS observed_at,
        CASE WHEN k % 17 = 0 THEN 2 WHEN k % 19 = 0 THEN 1 ELSE 0 END AS rank,
        CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN date_trunc('month', l_shipdate) ELSE date_trunc('day', l_shipdate) END::TIMESTAMP AS "at" FROM line
    UNION ALL SELECT k * 2 + 1, 'p:' || l_partkey, 'return', l_returnflag, k % 3 != 0, l_shipdate, CASE WHEN k % 17 = 0 THEN 2 WHEN k % 19 = 0 THEN 1 ELSE 0 END,
        CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN date_trunc('month', l_shipdate) ELSE date_trunc('day', l_shipdate) END::TIMESTAMP FROM line)"""
_RELATION = """
trade AS (
    SELECT 'c:' || o_custkey AS from_id, 's:' || l_suppkey AS to_id, min(o_orderdate) AS since, max(l_shipdate) AS until, count(*) AS n
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
peer AS (SELECT * FROM (SELECT *, lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS next FROM customer) WHERE next IS NOT NULL),
relation AS (
    SELECT concat_ws('|', key, from_id, to_id) AS relation_id, *, CASE WHEN NOT is_current THEN valid_to END AS terminated FROM (
        SELECT 'c:' || c_custkey AS from_id, 'n:' || c_nationkey AS to_id, 'resides_at' AS key, c_custkey % 7 != 0 AS is_current,
            CASE WHEN c_custkey % 4 != 0 THEN DATE '1994-01-01' + (c_custkey % 365)::INT END::TIMESTAMP AS day, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM customer
        UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'located_in', true, NULL, NULL, NULL FROM nation
        UNION ALL SELECT from_id, to_id, 'buys_from', n % 2 = 0, date_trunc('day', since), since, CASE WHEN n % 2 != 0 THEN until END FROM trade
        UNION ALL SELECT 'c:' || c_custkey, 'c:' || next, 'peer_of', c_custkey % 3 != 0, TIMESTAMP '1995-01-01', NULL, NULL FROM peer))"""


def _with(*frames: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",".join(frames)


def _membership(start: str, end: str) -> str:
    return (
        f"CASE WHEN w_start IS NULL THEN 'unknown' WHEN w_start >= TIMESTAMP '{start}' AND w_end <= TIMESTAMP '{end}' THEN 'match' "
        f"WHEN w_end <= TIMESTAMP '{start}' OR w_start >= TIMESTAMP '{end}' THEN 'no_match' ELSE 'unknown' END"
    )


_YEAR, _MONTH, _DAY = ("1996-01-01", "1997-01-01"), ("1996-03-01", "1996-04-01"), ("1996-03-10", "1996-03-11")
_IN_LOG_DAY = "CASE WHEN observed_at IS NULL THEN 'unknown' WHEN observed_at >= TIMESTAMP '2024-01-10' AND observed_at < TIMESTAMP '2024-01-11' THEN 'match' ELSE 'no_match' END"
_MEASURED = (_FACT, _MEASUREMENT, _CORRECTION, _EFFECTIVE)


def _counts(span: tuple[str, str]) -> str:
    return f"{_with(_EVENT)} SELECT type_key, {_membership(*span)} AS membership, count(*) AS n FROM event GROUP BY ALL"


def _sum(currency: str | None) -> str:
    pick = f"AND currency = '{currency}'" if currency else ""
    return f"""{_with(_EVENT, _FACT)},
        marked AS (SELECT *, {_membership(*_YEAR)} AS membership FROM event),
        sums AS (SELECT actor_id, sum(amount) AS s, count(*) AS n, count(DISTINCT currency) AS c, min(currency) AS cur
            FROM marked JOIN current_fact ON about_id = event_id WHERE membership = 'match' {pick} GROUP BY 1),
        doubts AS (SELECT actor_id, count(*) AS n_facts FROM marked JOIN fact ON about_id = event_id WHERE membership = 'unknown' GROUP BY 1),
        open AS (SELECT actor_id, count(*) AS n_events FROM marked WHERE membership = 'unknown' GROUP BY 1),
        every AS (SELECT coalesce(s.actor_id, d.actor_id, o.actor_id) AS actor_id, s, n, c, cur, n_facts, n_events
            FROM sums s FULL JOIN doubts d ON s.actor_id = d.actor_id FULL JOIN open o ON o.actor_id = coalesce(s.actor_id, d.actor_id))"""


def _lookup(keys: str, where: str, span: tuple[str, str] | None = None) -> str:
    member = _membership(*span) if span else "'match'"
    return f"""
        marked AS (SELECT *, {member} AS m, concat_ws('|', text_value IS NULL, text_value, numeric_value, unit) AS identity FROM attribute WHERE {where}),
        grouped AS (SELECT {keys}, count(*) FILTER (m = 'match') AS n_match, count(*) FILTER (m = 'unknown') AS n_unknown,
            count(*) FILTER (m = 'match' AND is_current) AS support, count(DISTINCT identity) FILTER (m = 'match' AND is_current) AS n_values,
            min(coalesce(text_value, numeric_value::VARCHAR)) FILTER (m = 'match' AND is_current) AS v FROM marked GROUP BY ALL),
        answered AS (SELECT {keys}, CASE WHEN n_match = 0 AND n_unknown > 0 THEN 'temporally_unknown' WHEN n_match = 0 THEN 'unknown'
            WHEN n_values = 1 THEN 'known_single' WHEN n_values > 1 THEN 'ambiguous' ELSE 'temporally_unknown' END AS status,
            n_values, support, CASE WHEN n_values = 1 THEN v END AS value FROM grouped)"""


def _latest_measure(where: str) -> str:
    return f"""{_with(*_MEASURED)},
        chosen AS (SELECT * FROM measured WHERE {where}),
        tops AS (SELECT user_id, dimension, max(observed_at) AS "at", count(*) FILTER (observed_at IS NULL) AS n_unknown FROM chosen GROUP BY 1, 2),
        vals AS (SELECT c.user_id, c.dimension, count(DISTINCT concat_ws('|', value, coalesce(unit, '-'))) AS n_values, min(value) AS value
            FROM chosen c JOIN tops t ON t.user_id = c.user_id AND t.dimension = c.dimension AND c.observed_at = t."at" GROUP BY 1, 2),
        out AS (SELECT t.*, coalesce(n_values, 0) AS n_values, value, CASE WHEN n_unknown > 0 AND "at" IS NOT NULL THEN 'ambiguous' WHEN "at" IS NULL THEN 'temporally_unknown'
            WHEN n_values = 1 THEN 'known_single' ELSE 'ambiguous' END AS status FROM tops t LEFT JOIN vals v ON v.user_id = t.user_id AND v.dimension = t.dimension)
        SELECT user_id, dimension, status, "at", n_values, CASE WHEN status = 'known_single' THEN value END AS value, n_unknown FROM out"""


def _current_state(keys: str, where: str = "true") -> str:
    on = " AND ".join(f"d.{k} = t.{k}" for k in keys.split(", "))
    return f"""
        live AS (SELECT * FROM state WHERE is_current AND {where}),
        dated AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rank DESC, "at" DESC, state_id DESC) AS r,
            count(*) OVER (PARTITION BY {keys}, rank, "at") AS n_same FROM live WHERE rank < 2),
        undated AS (SELECT {keys}, count(*) AS n_open, min(state_id) AS lone_id, arg_min(value, state_id) AS lone_value FROM live WHERE rank = 2 GROUP BY ALL),
        keyset AS (SELECT DISTINCT {keys} FROM live),
        current AS (SELECT {", ".join("t." + k for k in keys.split(", "))},
            CASE WHEN d.state_id IS NOT NULL THEN d.state_id WHEN n_open = 1 THEN lone_id END AS state_id,
            CASE WHEN d.state_id IS NOT NULL THEN d.value WHEN n_open = 1 THEN lone_value END AS value,
            CASE WHEN d.state_id IS NULL AND n_open = 1 THEN 'partial' WHEN d.state_id IS NULL THEN 'indeterminate' WHEN n_open > 0 THEN 'partial'
                WHEN n_same > 1 THEN 'indeterminate' ELSE 'complete' END AS completeness,
            CASE WHEN d.state_id IS NOT NULL AND n_open IS NULL THEN CASE WHEN n_same > 1 THEN 1 ELSE 0 END WHEN d.state_id IS NULL AND n_open = 1 THEN 0 ELSE n_open END::BIGINT AS n_open
            FROM keyset t LEFT JOIN dated d ON {on} AND d.r = 1 LEFT JOIN undated u ON {on.replace('d.', 'u.')})"""


def _ranked(key: str, swap: bool) -> str:
    ends = ("to_id", "from_id") if swap else ("from_id", "to_id")
    current = "" if key == "buys_from" or swap else ""
    return f"""{_with(_RELATION)},
        rows_ AS (SELECT {ends[0]} AS subject, {ends[1]} AS object, relation_id, day FROM relation WHERE key = '{key}' {current}),
        marked AS (SELECT *, row_number() OVER (PARTITION BY subject, day IS NOT NULL ORDER BY day DESC, relation_id DESC) AS r,
            count(*) FILTER (day IS NOT NULL) OVER (PARTITION BY subject) AS n_dated, count(*) FILTER (day IS NULL) OVER (PARTITION BY subject) AS n_undated,
            count(*) OVER (PARTITION BY subject, day) AS n_same FROM rows_)
        SELECT subject, object, CASE WHEN n_dated = 0 AND n_undated = 1 THEN 'partial' WHEN n_dated = 0 THEN 'indeterminate' WHEN day IS NULL THEN 'partial'
            WHEN n_undated = 0 AND n_same > 1 THEN 'indeterminate' ELSE 'complete' END AS completeness FROM marked WHERE day IS NULL OR r = 1"""


def _fold(text: str) -> str:
    return f"translate(lower(trim({text})), 'áàâãäåéèêëíìîïóòôõöúùûüçñý', 'aaaaaaeeeeiiiiooooouuuucny')"


def _normal(text: str) -> str:
    return f"trim(regexp_replace({_fold(text)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _slug(text: str) -> str:
    key = f"regexp_replace(regexp_replace({_fold(text)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(SELECT CASE WHEN regexp_matches(k, '^[a-z]') THEN k END FROM (SELECT regexp_replace(substr(CASE WHEN regexp_matches({key}, '^[0-9]') THEN 'r_' || {key} ELSE {key} END, 1, 48), '_+$', '') AS k))"


_WALK = """
    edges AS (SELECT DISTINCT a, b FROM (
        SELECT from_id AS a, to_id AS b FROM relation WHERE is_current AND key IN ('resides_at', 'located_in')
        UNION ALL SELECT to_id, from_id FROM relation WHERE is_current AND key IN ('resides_at', 'located_in'))),
    seeds AS (SELECT 'r:' || r_regionkey AS seed FROM region),
    one AS (SELECT DISTINCT seed, b AS entity_id FROM seeds JOIN edges ON a = seed WHERE b != seed),
    two AS (SELECT DISTINCT seed, b AS entity_id FROM one JOIN edges ON a = entity_id WHERE b != seed AND (seed, b) NOT IN (SELECT (seed, entity_id) FROM one)),
    walked AS (SELECT seed, seed AS entity_id, 0 AS depth FROM seeds UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two)"""

_PERIODS = {"today": ("2024-01-16 03:00", "2024-01-17 03:00"), "yesterday": ("2024-01-15 03:00", "2024-01-16 03:00"), "this_week": ("2024-01-15 03:00", "2024-01-22 03:00"), "last_week": ("2024-01-08 03:00", "2024-01-15 03:00"), "this_month": ("2024-01-01 03:00", "2024-02-01 03:00"), "last_month": ("2023-12-01 03:00", "2024-01-01 03:00")}

ORACLE_SQL: dict[str, str] = {
    "event_membership_month": _counts(_MONTH),
    "event_membership_year": _counts(_YEAR),
    "event_membership_day": _counts(_DAY),
    "event_membership_instants": "SELECT user_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' THEN 'match' ELSE 'no_match' END AS membership, count(*) AS n FROM events GROUP BY ALL",
    "event_validity_month": f"""{_with(_EVENT)} SELECT CASE WHEN w_start IS NULL THEN 'unknown' WHEN w_end <= TIMESTAMP '1996-03-01' OR w_start >= TIMESTAMP '1996-04-01' THEN 'no_match'
        WHEN w_start <= TIMESTAMP '1996-03-01' AND w_end >= TIMESTAMP '1996-04-01' THEN 'match' ELSE 'unknown' END AS membership, count(*) AS n FROM event GROUP BY ALL""",
    "event_status_domain_filter": f"{_with(_EVENT)} SELECT event_id, type_key, action, status FROM event WHERE action IN ('action.f', 'action.o') AND status IN ('completed', 'scheduled') AND list_has_any(domains, ['domain.1', 'domain.3'])",
    "event_hierarchy_exact": f"{_with(_EVENT)} SELECT event_id, type_key FROM event WHERE type_key = 'event.order.1-urgent'",
    "event_hierarchy_descendants": f"{_with(_EVENT, _CONCEPT, recursive=True)} SELECT type_key, count(*) AS n FROM event WHERE type_key IN (SELECT concept FROM closure WHERE ancestor = 'event.order') GROUP BY 1",
    "concept_closure": f"{_with(_CONCEPT, recursive=True)} SELECT concept, ancestor, depth::INT AS depth FROM closure",
    "event_list_subject": f"{_with(_EVENT)} SELECT event_id, status FROM event WHERE event_id IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey)",
    "event_list_actor": f"{_with(_EVENT)} SELECT event_id, actor_id FROM event WHERE split_part(actor_id, ':', 2)::BIGINT IN (SELECT c_custkey FROM customer)",
    "event_list_context_all": f"{_with(_EVENT)} SELECT event_id, actor_id FROM event WHERE event_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2)",
    "event_relation_endpoint": f"{_with(_EVENT)} SELECT event_id, actor_id FROM event WHERE actor_id IN (SELECT 'c:' || c_custkey FROM customer WHERE c_nationkey IN (3, 7))",
    "event_items_top": f"{_with(_EVENT)}, items AS (SELECT actor_id, event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS event_time FROM event) SELECT actor_id, position::INT AS position, event_id, event_time FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY event_time DESC, event_id DESC) AS position FROM items) WHERE position <= 3",
    "event_items_sorted": f"{_with(_EVENT, _PARTICIPANT)} SELECT event_id, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%S'), '') AS event_time, (SELECT count(DISTINCT entity_id) FROM participant p WHERE p.event_id = e.event_id)::INT AS n_entities FROM event e ORDER BY event_time DESC, event_id DESC LIMIT 200",
    "fact_current": f"{_with(_FACT)} SELECT fact_id, about_id, amount, currency FROM current_fact",
    "fact_history": f"{_with(_FACT)} SELECT about_id, fact_id, row_number() OVER (PARTITION BY about_id ORDER BY created_at, fact_id)::INT AS version, amount FROM fact",
    "effective_assertions": f"{_with(_FACT)} SELECT currency, count(*) AS n, sum(amount) AS total FROM fact WHERE fact_id % 17 != 0 AND fact_id % 19 != 0 GROUP BY 1",
    "effectiveness_status": f"{_with(_FACT)} SELECT CASE WHEN fact_id % 17 = 0 OR fact_id % 19 = 0 THEN 'ineffective' WHEN source_id % 23 = 0 THEN 'unknown' ELSE 'effective' END AS effectiveness, count(*) AS n FROM fact GROUP BY 1",
    "correction_lineage": f"{_with(_FACT, _MEASUREMENT, _CORRECTION)} SELECT fact_id, amount, action, replacement_id::VARCHAR AS replacement_id FROM fact JOIN correction ON kind = 'fact' AND target_id = fact_id",
    "correction_errors": f"{_with(_FACT, _MEASUREMENT, _CORRECTION)} SELECT kind, 'target_missing' AS reason, count(*) AS n FROM correction WHERE kind = 'fact' AND target_id % 34 = 0 GROUP BY 1",
    "sum_current_currency": _sum("BRL") + " SELECT actor_id, coalesce(s, 0)::DECIMAL(28,2) AS total, coalesce(cur, 'BRL') AS currency, coalesce(n, 0) AS n_facts, CASE WHEN coalesce(n_facts, 0) > 0 THEN 'partial' ELSE 'complete' END AS completeness, coalesce(n_events, 0) AS n_unknown_events FROM every",
    "sum_multi_currency_flag": _sum(None) + " SELECT actor_id, CASE WHEN coalesce(c, 0) <= 1 THEN coalesce(s, 0)::DECIMAL(28,2) END AS total, CASE WHEN coalesce(c, 0) <= 1 THEN cur END AS currency, CASE WHEN c > 1 THEN 'multi_currency' END AS error FROM every",
    "sum_unknown_contributors": f"{_with(_EVENT, _FACT)} SELECT event_id, fact_id, amount, currency FROM event JOIN fact ON about_id = event_id WHERE {_membership(*_MONTH)} = 'unknown'",
    "count_with_unknown": f"{_with(_EVENT)}, m AS (SELECT actor_id, {_membership(*_MONTH)} AS m FROM event) SELECT actor_id, count(*) FILTER (m = 'match') AS n, count(*) FILTER (m = 'unknown') AS n_unknown, CASE WHEN count(*) FILTER (m = 'unknown') > 0 THEN 'partial' ELSE 'complete' END AS completeness FROM m GROUP BY 1",
    "latest_event_value": f"""{_with(_EVENT, _FACT)}, m AS (SELECT *, {_membership(*_YEAR)} AS m FROM event),
        pool AS (SELECT * FROM m WHERE m != 'no_match'),
        chosen AS (SELECT actor_id, arg_max(event_id, (instant, event_id)) FILTER (instant IS NOT NULL) AS known, max(instant) AS "at", min(event_id) AS least,
            count(*) FILTER (instant IS NULL OR m = 'unknown') AS n_open, count(*) FILTER (m = 'unknown') AS n_unknown_events FROM pool GROUP BY 1),
        firsts AS (SELECT about_id, arg_min(amount, fact_id) AS amount, arg_min(currency, fact_id) AS currency FROM current_fact GROUP BY 1)
        SELECT actor_id, coalesce(known, least) AS event_id, "at", amount, currency, CASE WHEN n_open > 0 THEN 'partial' ELSE 'complete' END AS completeness, n_unknown_events
        FROM chosen LEFT JOIN firsts ON about_id = coalesce(known, least)""",
    "attr_value_lookup": _with(_ATTRIBUTE, _lookup("entity_id", "dimension = 'brand'")) + " SELECT * FROM answered",
    "attr_value_lookup_in_range": _with(_ATTRIBUTE, _lookup("entity_id", "dimension = 'size'", ("2000-06-01", "2001-06-01"))) + " SELECT * FROM answered",
    "attr_snapshot": _with(_ATTRIBUTE, _lookup("entity_id, dimension", "true")) + " SELECT * FROM answered WHERE status != 'unknown'",
    "spec_snapshot": _with(_ATTRIBUTE, _lookup("entity_id, dimension", "true")) + " SELECT * FROM answered WHERE status != 'unknown'",
    "attr_value_groups": f"{_with(_ATTRIBUTE)} SELECT entity_id, numeric_value, count(*) AS support FROM attribute WHERE dimension = 'size' AND is_current GROUP BY 1, 2",
    "attr_history_previous": f"{_with(_ATTRIBUTE)} SELECT entity_id, dimension, attribute_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, dimension ORDER BY rank DESC, w_start DESC, attribute_id DESC) AS r FROM attribute WHERE NOT is_current) WHERE r = 1",
    "attr_history_first": f"{_with(_ATTRIBUTE)} SELECT dimension, text_value, r::INT AS position, attribute_id FROM (SELECT *, row_number() OVER (PARTITION BY dimension, text_value ORDER BY rank, w_start, attribute_id) AS r FROM attribute WHERE NOT is_current AND text_value IS NOT NULL) WHERE r <= 2",
    "attr_existence": f"{_with(_ATTRIBUTE)}, m AS (SELECT *, {_membership('2000-06-01', '2001-06-01')} AS m FROM attribute WHERE dimension = 'size') SELECT entity_id, CASE WHEN count(*) FILTER (numeric_value = 10 AND m = 'match') > 0 THEN 'yes' WHEN count(*) FILTER (numeric_value = 10 AND m = 'unknown') > 0 THEN 'temporally_unknown' ELSE 'unknown' END AS answer FROM m GROUP BY 1",
    "attr_proposition": _with(_ATTRIBUTE, _lookup("entity_id", "dimension = 'brand'")) + ", hits AS (SELECT entity_id, count(*) FILTER (text_value = 'Brand#11' AND is_current) AS hits FROM attribute WHERE dimension = 'brand' GROUP BY 1) SELECT entity_id, status, CASE WHEN status = 'temporally_unknown' THEN 'temporally_unknown' WHEN status = 'ambiguous' AND hits > 0 THEN 'ambiguous' WHEN status = 'known_single' AND hits > 0 THEN 'yes' ELSE 'unknown' END AS answer FROM answered JOIN hits USING (entity_id)",
    "attr_composed_label": f"{_with(_ATTRIBUTE)} SELECT entity_id, concat_ws(' ', max(text_value) FILTER (dimension = 'brand'), max(text_value) FILTER (dimension = 'type')) AS label FROM attribute WHERE is_current GROUP BY 1",
    "intrinsic_name": f"{_with(_ENTITY)} SELECT type_key, name, count(*) AS support FROM entity WHERE trim(name) != '' GROUP BY 1, 2",
    "meas_latest": _latest_measure("true"),
    "meas_latest_known": _latest_measure("observed_at IS NOT NULL"),
    "meas_at_time": f"{_with(*_MEASURED)}, m AS (SELECT *, {_IN_LOG_DAY} AS m FROM measured), g AS (SELECT user_id, dimension, count(*) FILTER (m = 'match') AS n, count(*) FILTER (m = 'unknown') AS n_unknown, count(DISTINCT concat_ws('|', value, coalesce(unit, '-'))) FILTER (m = 'match') AS n_values FROM m GROUP BY 1, 2) SELECT user_id, dimension, CASE WHEN n = 0 AND n_unknown > 0 THEN 'temporally_unknown' WHEN n = 0 THEN 'unknown' WHEN n_values = 1 THEN 'known_single' ELSE 'ambiguous' END AS status, n, n_values, n_unknown FROM g",
    "meas_in_range": f"{_with(*_MEASURED)}, m AS (SELECT *, {_IN_LOG_DAY} AS m FROM measured), g AS (SELECT user_id, dimension, count(*) FILTER (m = 'match') AS n, count(*) FILTER (m = 'unknown') AS n_unknown, arg_min(measurement_id, (observed_at, measurement_id)) FILTER (m = 'match') AS first_id, arg_max(measurement_id, (observed_at, measurement_id)) FILTER (m = 'match') AS last_id FROM m GROUP BY 1, 2) SELECT user_id, dimension, CASE WHEN n = 0 AND n_unknown > 0 THEN 'temporally_unknown' WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'known_single' ELSE 'known_multiple' END AS status, n, n_unknown, first_id::VARCHAR AS first_id, last_id::VARCHAR AS last_id FROM g",
    "meas_proposition": f"{_with(*_MEASURED)}, m AS (SELECT *, {_IN_LOG_DAY} AS m, CASE WHEN unit IS DISTINCT FROM 'kg' THEN 'incomparable' WHEN value = 10 THEN 'match' ELSE 'mismatch' END AS c FROM measured), g AS (SELECT user_id, dimension, count(*) FILTER (c = 'match' AND m = 'match') AS hits, count(*) FILTER (c = 'match' AND m = 'unknown') AS maybe, count(*) FILTER (c = 'mismatch' AND m = 'match') AS others, count(*) FILTER (c = 'incomparable') AS n_incomparable FROM m GROUP BY 1, 2) SELECT user_id, dimension, CASE WHEN hits > 0 AND others > 0 THEN 'ambiguous' WHEN hits > 0 THEN 'yes' WHEN maybe > 0 THEN 'temporally_unknown' ELSE 'unknown' END AS answer, hits, n_incomparable FROM g",
    "meas_incomparable_units": f"{_with(*_MEASURED)} SELECT dimension, CASE WHEN unit IS DISTINCT FROM 'g' THEN 'incomparable' WHEN value = 10 THEN 'match' ELSE 'mismatch' END AS c, count(*) AS n FROM measured GROUP BY ALL",
    "meas_value_groups": f"{_with(*_MEASURED)} SELECT dimension, value, unit, count(*) AS support FROM measured GROUP BY ALL",
    "state_current": _with(_STATE, _current_state("entity_id", "dimension = 'openness'")) + " SELECT * REPLACE (state_id::VARCHAR AS state_id) FROM current",
    "state_current_by_dimension": _with(_STATE, _current_state("dimension")) + " SELECT * REPLACE (state_id::VARCHAR AS state_id) FROM current",
    "state_completeness": _with(_STATE, _current_state("entity_id, dimension")) + " SELECT entity_id, CASE max(CASE completeness WHEN 'complete' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'indeterminate' END AS completeness FROM current GROUP BY 1",
    "state_scd2": f"{_with(_STATE)} SELECT state_id, entity_id, value, true AS no_start, lead(observed_at) OVER w AS valid_to, lead(observed_at) OVER w IS NULL AS is_current, (lag(state_id) OVER w)::VARCHAR AS supersedes_id FROM state WHERE dimension = 'return' WINDOW w AS (PARTITION BY entity_id ORDER BY observed_at, state_id)",
    "attribute_scd2": f"{_with(_MEASUREMENT)}, n AS (SELECT *, CASE WHEN dimension IN ('click', 'view') THEN lead(observed_at) OVER (PARTITION BY user_id, dimension ORDER BY observed_at, measurement_id) END AS valid_to FROM measurement WHERE observed_at IS NOT NULL) SELECT measurement_id, observed_at AS valid_from, valid_to, valid_to IS NULL AS is_current FROM n",
    "relation_current_boolean": f"{_with(_RELATION)}, live AS (SELECT from_id AS subject, count(*) AS n FROM relation WHERE key = 'buys_from' AND is_current GROUP BY 1) SELECT 'c:' || c_custkey AS subject, CASE WHEN n IS NULL THEN 'no' ELSE 'yes' END AS answer, CASE WHEN n IS NULL THEN 0 ELSE 1 END::BIGINT AS n FROM customer LEFT JOIN live ON subject = 'c:' || c_custkey",
    "relation_list_ranked": _ranked("buys_from", False),
    "relation_undated_ranked": _ranked("resides_at", True),
    "relation_historical": f"{_with(_RELATION)} SELECT 's:' || s_suppkey AS subject, CASE WHEN 's:' || s_suppkey IN (SELECT to_id FROM relation WHERE key = 'buys_from' AND NOT is_current) THEN 'yes' ELSE 'no' END AS answer FROM supplier",
    "relation_termination": f"{_with(_RELATION)}, g AS (SELECT from_id AS subject, count(*) FILTER (NOT is_current) AS ended, arg_min(terminated, relation_id) FILTER (NOT is_current) AS terminated FROM relation WHERE key = 'buys_from' GROUP BY 1) SELECT subject, CASE WHEN ended = 0 THEN 'no' WHEN terminated IS NOT NULL THEN 'yes' ELSE 'unknown' END AS answer, terminated FROM g",
    "relation_held_during": f"{_with(_RELATION)} SELECT from_id AS subject, to_id AS object, CASE WHEN valid_to <= TIMESTAMP '1997-01-01' OR valid_from >= TIMESTAMP '1997-07-01' THEN 'no' WHEN valid_from <= TIMESTAMP '1997-01-01' AND (is_current OR valid_to >= TIMESTAMP '1997-07-01') THEN 'yes' ELSE 'unknown' END AS answer FROM relation WHERE key = 'buys_from'",
    "relation_symmetric": f"{_with(_RELATION)} SELECT from_id AS subject, to_id AS object, is_current FROM relation WHERE key = 'peer_of' UNION ALL SELECT to_id, from_id, is_current FROM relation WHERE key = 'peer_of'",
    "relation_canonical": f"{_with(_RELATION)} SELECT least(from_id, to_id) AS from_id, greatest(from_id, to_id) AS to_id FROM relation WHERE key = 'peer_of'",
    "relation_inverse": "SELECT 'r:' || n_regionkey AS subject, 'n:' || n_nationkey AS object FROM nation",
    "relation_object_type": "SELECT 'resides_at|c:' || c_custkey || '|n:' || c_nationkey AS relation_id, n_name AS object_name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'located_in|n:' || n_nationkey || '|r:' || n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey",
    "owned_entities": f"{_with(_RELATION)} SELECT from_id AS owner, to_id AS entity_id FROM relation WHERE key = 'buys_from' AND is_current AND to_id IN (SELECT 's:' || s_suppkey FROM supplier)",
    "graph_walk_2hop": _with(_RELATION, _WALK) + " SELECT seed, entity_id, depth::INT AS depth FROM walked",
    "graph_walk_bounded": _with(_RELATION, _WALK) + " SELECT seed, entity_id, depth::INT AS depth, n > 40 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, entity_id) AS r, count(*) OVER (PARTITION BY seed) AS n FROM walked) WHERE r <= 40",
    "entity_detail": f"""{_with(_ENTITY, _RELATION, _ATTRIBUTE, _STATE, _PARTICIPANT)}
        SELECT e.entity_id, type_key, name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(n_attributes, 0) AS n_attributes, coalesce(n_states, 0) AS n_states, coalesce(n_events, 0) AS n_events FROM entity e
        LEFT JOIN (SELECT from_id AS id, count(*) AS n_out FROM relation WHERE is_current GROUP BY 1) a ON a.id = e.entity_id
        LEFT JOIN (SELECT to_id AS id, count(*) AS n_in FROM relation WHERE is_current GROUP BY 1) b ON b.id = e.entity_id
        LEFT JOIN (SELECT entity_id AS id, count(*) AS n_attributes FROM attribute WHERE is_current GROUP BY 1) c ON c.id = e.entity_id
        LEFT JOIN (SELECT entity_id AS id, count(*) AS n_states FROM state WHERE is_current GROUP BY 1) d ON d.id = e.entity_id
        LEFT JOIN (SELECT entity_id AS id, count(DISTINCT event_id) AS n_events FROM participant GROUP BY 1) f ON f.id = e.entity_id""",
    "relation_lifecycle": """WITH commands AS (SELECT user_id % 100 AS subject, event_type AS object, ts AS "at", event_id, CASE WHEN event_id % 11 = 0 THEN 'terminate' WHEN event_id % 13 = 0 THEN 'deny' WHEN event_id % 17 = 0 THEN 'historical' ELSE 'assert' END AS mode FROM events),
        runs AS (SELECT *, coalesce(sum((mode IN ('terminate', 'deny'))::INT) OVER (PARTITION BY subject, object ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM commands),
        marked AS (SELECT *, coalesce(bool_or(mode = 'assert') OVER (PARTITION BY subject, object, run ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_open,
            CASE mode WHEN 'assert' THEN 'r' || run WHEN 'historical' THEN 'h' || event_id END AS made FROM runs),
        aimed AS (SELECT *, last_value(made IGNORE NULLS) OVER (PARTITION BY subject, object ORDER BY "at", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM marked),
        instances AS (SELECT *, CASE WHEN made IS NOT NULL THEN made WHEN is_open THEN 'r' || run WHEN mode = 'terminate' THEN newest END AS instance FROM aimed),
        g AS (SELECT subject, object, min("at") FILTER (made IS NOT NULL) AS valid_from, max("at") FILTER (made IS NOT NULL) AS observed_at, max("at") FILTER (mode = 'terminate') AS valid_to,
            bool_or(mode = 'deny') AS denied, bool_or(mode = 'historical') AS past FROM instances WHERE instance IS NOT NULL GROUP BY subject, object, instance),
        c AS (SELECT *, CASE WHEN valid_to IS NOT NULL THEN 'terminate' WHEN denied THEN 'deny' WHEN past THEN 'historical' END AS closed_by FROM g)
        SELECT subject, object, valid_from, observed_at, valid_to, closed_by IS NULL AS is_current, closed_by FROM c""",
    "entity_search": f"""{_with(_ENTITY)}, ranked AS (SELECT *, upper(replace(name, '#', '')) AS alias FROM entity),
        hits AS (SELECT entity_id, name, CASE WHEN lower(entity_id) = '00001' OR lower(name) = '00001' THEN 0 WHEN lower(alias) = '00001' THEN 1 WHEN starts_with(lower(name), '00001') THEN 2
            WHEN contains(lower(name), '00001') THEN 3 WHEN contains(lower(alias), '00001') THEN 4 WHEN contains(lower(entity_id), '00001') THEN 5 WHEN contains(lower(type_key), '00001') THEN 6 END AS rank FROM ranked),
        numbered AS (SELECT *, row_number() OVER (ORDER BY rank, lower(name), entity_id) AS position, count(*) OVER () > 50 AS truncated FROM hits WHERE rank IS NOT NULL)
        SELECT position::INT AS position, rank::INT AS rank, entity_id, name, truncated FROM numbered WHERE position <= 50""",
    "entity_search_ranks": f"""{_with(_ENTITY)}, ranked AS (SELECT *, upper(replace(name, '#', '')) AS alias FROM entity)
        SELECT CASE WHEN lower(entity_id) = 'ar' OR lower(name) = 'ar' THEN 0 WHEN lower(alias) = 'ar' THEN 1 WHEN starts_with(lower(name), 'ar') THEN 2 WHEN contains(lower(name), 'ar') THEN 3
            WHEN contains(lower(alias), 'ar') THEN 4 WHEN contains(lower(entity_id), 'ar') THEN 5 WHEN contains(lower(type_key), 'ar') THEN 6 END::VARCHAR AS rank, count(*) AS n FROM ranked GROUP BY 1""",
    "recent_referents": "SELECT user_id AS conv_id, event_type AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC, event_type)::INT AS recency FROM events GROUP BY 1, 2",
    "claim_tally": """WITH claims AS (SELECT l_orderkey AS request_id, CASE WHEN l_linenumber % 4 = 0 THEN 'deferred' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'committed' END AS status FROM lineitem),
        g AS (SELECT request_id, count(*) AS received, count(*) FILTER (status = 'committed') AS committed, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'deferred') AS deferred FROM claims GROUP BY 1)
        SELECT *, CASE WHEN committed = received THEN 'committed' WHEN committed > 0 THEN 'partial' WHEN deferred > 0 THEN 'deferred' ELSE 'unsupported' END AS outcome FROM g""",
    "idempotency_claims": "SELECT CASE WHEN event_id % 3 != 0 THEN 'proceed' WHEN event_id % 2 != 0 THEN 'conflict' WHEN event_id % 4 = 0 THEN 'replay' WHEN event_id % 5 = 0 THEN 'in_progress' ELSE 'recovery_required' END AS result, count(*) AS n FROM events GROUP BY 1",
    "last_message_preview": "SELECT conv_id, substr(trim(regexp_replace(arg_max(text, turn), '\\s+', ' ', 'g')), 1, 80) AS preview FROM conversations GROUP BY 1",
    "normalize_lexical": f"SELECT conv_id, turn, {_normal('text')} AS normal FROM conversations",
    "slug_key": f"SELECT p_partkey, {_slug('concat_ws(chr(32), p_size, p_name)')} AS slug, {_slug('p_type')} AS type_slug FROM part",
    "number_formats": "WITH o AS (SELECT *, o_totalprice::DECIMAL(18,2) AS a FROM orders) SELECT o_orderkey, replace(regexp_replace(a::VARCHAR, '\\.?0+$', ''), '.', ',') AS number, CASE WHEN o_orderkey % 7 = 0 THEN translate(format('{:,.2f}', a::DOUBLE), ',.', '.,') || ' USD' ELSE 'R$ ' || translate(format('{:,.2f}', a::DOUBLE), ',.', '.,') END AS money FROM o",
    "quantity_extraction": "SELECT event_id, CASE WHEN event_id % 3 != 2 AND value >= 0 THEN value::DECIMAL(18,2) WHEN event_id % 3 != 2 THEN -(value::DECIMAL(18,2)) END AS number, CASE event_id % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'km' END AS unit FROM events",
    "idempotency_fingerprint": "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS fingerprint FROM events",
    "value_codec": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'int' WHEN 2 THEN 'decimal' WHEN 3 THEN 'bool' WHEN 4 THEN 'money' ELSE 'string' END AS kind, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN value::DECIMAL(18,2)::VARCHAR WHEN 3 THEN 'false' WHEN 4 THEN event_id || ' BRL' ELSE event_type END AS value FROM events",
    "closed_vocabulary": "SELECT CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'high' WHEN '2-high' THEN 'high' WHEN '3-medium' THEN 'medium' WHEN '5-low' THEN 'low' ELSE 'other' END AS word, count(*) AS n FROM orders GROUP BY 1",
    "relative_periods": "SELECT user_id, " + ", ".join(f"count(*) FILTER (ts >= TIMESTAMP '{a}:00' AND ts < TIMESTAMP '{b}:00') AS {n}" for n, (a, b) in _PERIODS.items()) + " FROM events GROUP BY 1",
    "weekday_shift": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (isodow(o_orderdate) - 1) AS w FROM orders)
        SELECT o_orderkey, (d + ((2 - w + 7) % 7)::INT)::VARCHAR AS next, (d - ((w - 2 + 7) % 7)::INT)::VARCHAR AS previous,
            (d + (CASE WHEN w = 2 THEN 7 ELSE (2 - w + 7) % 7 END)::INT)::VARCHAR AS next_strict, (d - (CASE WHEN w = 2 THEN 7 ELSE (w - 2 + 7) % 7 END)::INT)::VARCHAR AS previous_strict FROM o""",
    "time_conflicts": "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'several_dates' WHEN o_orderkey % 3 = 0 AND isodow(o_orderdate) != 3 THEN 'weekday_mismatch' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    "integrity_violations": "SELECT 'missing_context' AS \"check\", count(*) AS n FROM lineitem WHERE l_suppkey IN (1, 3)",
    "completeness_clarification": f"""{_with(_EVENT)},
        s AS (SELECT event_id, instant IS NULL AS t, event_id % 9 = 0 AS a, action IS NULL AS c FROM event),
        m AS (SELECT array_to_string(list_filter([CASE WHEN c THEN 'action' END, CASE WHEN a THEN 'actor' END, CASE WHEN t THEN 'time' END], lambda x: x IS NOT NULL), ',') AS missing, a AS blocking,
            CASE WHEN a THEN 'actor' WHEN c THEN 'action' END AS question FROM s)
        SELECT missing, blocking, question, count(*) AS n FROM m GROUP BY ALL""",
    "id_validation": f"{_with(_ENTITY)} SELECT regexp_full_match(entity_id, '[A-Za-z0-9_.:-]{{1,128}}') AS id_ok, regexp_full_match(type_key, '[a-z][a-z0-9_]*(\\.[a-z0-9_]+)*') AS type_ok, count(*) AS n FROM entity GROUP BY 1, 2",
    "spec_sum": f"""{_with(_EVENT, _FACT)}, m AS (SELECT *, {_membership(*_YEAR)} AS m FROM event),
        usable AS (SELECT * FROM current_fact JOIN m ON about_id = event_id WHERE m = 'match' AND currency = 'BRL' AND fact_id % 17 != 0 AND fact_id % 19 != 0)
        SELECT 1::BIGINT AS user_id, (SELECT sum(amount) FROM usable)::DECIMAL(28,2) AS total, 'BRL' AS currency, (SELECT count(*) FROM usable) AS n_facts, 'partial' AS completeness,
            (SELECT count(*) FROM m WHERE m = 'unknown') AS n_unknown_events, NULL::VARCHAR AS error""",
    "entity_resolution_named": f"""WITH m AS (SELECT o_orderkey AS mention_id, 'c:' || o_custkey AS id, o_custkey AS k FROM orders)
        SELECT mention_id, CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN c_custkey IS NOT NULL THEN id END AS entity_id, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END::BIGINT AS n FROM m LEFT JOIN customer ON c_custkey = k""",
    "entity_resolution_possessive": "SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 7 = 0 THEN 'create_candidate' ELSE 'resolved' END AS status, CASE WHEN c_custkey % 7 != 0 THEN 'n:' || c_nationkey END AS entity_id, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS n FROM customer",
    "alias_match": f"""WITH a(alias, concept, priority) AS (VALUES ('the', 'concept.the', 1), ('and the', 'concept.and_the', 1), ('of', 'concept.of', 2), ('der', 'concept.der', 3), ('le', 'concept.le', 3)),
        t AS (SELECT conv_id || '-' || turn AS text_id, ' ' || {_normal("text")} || ' ' AS low FROM conversations)
        SELECT text_id, alias, concept FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY priority DESC, len(alias) DESC, alias, concept) AS r FROM t JOIN a ON contains(low, ' ' || alias || ' ')) WHERE r = 1""",
    "entity_resolution_names_shared": f"""{_with(_ENTITY)},
        names AS (SELECT DISTINCT entity_id, type_key, unnest([{_normal("name")}, {_normal("upper(replace(name, '#', ''))")}]) AS needle FROM entity),
        found AS (SELECT DISTINCT p_partkey AS mention_id, entity_id, starts_with(type_key, 'entity.part.') AS fits FROM part JOIN names ON needle = {_normal("p_name")} WHERE needle != ''),
        g AS (SELECT mention_id, count(*) AS n, count(*) FILTER (fits) AS n_fit, min(entity_id) AS one, min(entity_id) FILTER (fits) AS fit FROM found GROUP BY 1)
        SELECT p_partkey AS mention_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 OR n_fit = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
            CASE WHEN n = 1 THEN one WHEN n_fit = 1 THEN fit END AS entity_id, coalesce(n, 0) AS n FROM part LEFT JOIN g ON mention_id = p_partkey""",
    "newest_binding": "SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "relation_instance_newest": """WITH r AS (SELECT o_custkey, l_suppkey, o_orderdate AS observed_at, l_orderkey * 10 + l_linenumber AS instance FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
        SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY observed_at DESC, instance DESC) AS n FROM r) WHERE n = 1""",
    "participant_backfill": """SELECT o_orderkey, 'c:' || o_custkey AS entity_id, 'role.participant' AS role FROM orders WHERE o_orderkey % 3 != 0
        UNION ALL SELECT o_orderkey, 'p:1', 'role.affected' FROM orders WHERE o_orderkey % 4 = 0""",
    "catalogue_counts": f"{_with(_CONCEPT, recursive=True)} SELECT ancestor AS root, count(*) AS n, max(depth)::INT AS deepest FROM closure WHERE ancestor IN (SELECT concept FROM concept WHERE parent IS NULL) GROUP BY 1",
    "concepts_to_learn": "SELECT DISTINCT 'entity.part.' || lower(p_brand) AS concept FROM part",
    "correction_target": f"""{_with(_FACT, _MEASUREMENT, _CORRECTION)},
        hits AS (SELECT s_suppkey AS description_id, c_custkey AS id FROM supplier JOIN customer ON c_nationkey = s_nationkey AND contains(c_name, '0000' || (s_suppkey % 10))
            WHERE c_custkey NOT IN (SELECT target_id FROM correction WHERE kind = 'fact')),
        g AS (SELECT description_id, count(*) AS n, min(id) AS one FROM hits GROUP BY 1)
        SELECT s_suppkey AS description_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END::VARCHAR AS target_id, coalesce(n, 0) AS n
        FROM supplier LEFT JOIN g ON description_id = s_suppkey""",
    "inferred_ownership": f"""{_with(_RELATION)} SELECT DISTINCT 'c:' || o_custkey AS owner, 's:' || (o_orderkey % 10 + 1) AS entity_id FROM orders
        WHERE ('c:' || o_custkey, 's:' || (o_orderkey % 10 + 1)) NOT IN (SELECT (from_id, to_id) FROM relation WHERE key = 'buys_from' AND is_current)""",
    "referent_salience": """WITH l AS (SELECT conv_id, role || (turn % 3) AS entity_id, max(turn) AS last FROM conversations GROUP BY 1, 2), n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY 1)
        SELECT * FROM (SELECT conv_id, entity_id, round(CASE WHEN n = last THEN 1.0 ELSE 0.6::DOUBLE * pow(0.85::DOUBLE, n - last - 1) END, 6) AS salience FROM l JOIN n USING (conv_id)) WHERE salience >= 0.2""",
    "proposal_readiness": """WITH p AS (SELECT l_orderkey AS proposal_id, (l_orderkey + l_linenumber) AS k, l_partkey % 3 != 0 AS s, l_suppkey % 2 = 0 AS o, l_linenumber % 3 != 0 AS v FROM lineitem),
        m AS (SELECT proposal_id, CASE k % 6 WHEN 5 THEN NULL WHEN 0 THEN list_filter([CASE WHEN k % 7 = 0 THEN 'time' END, CASE WHEN k % 5 = 0 THEN 'type' END], lambda x: x IS NOT NULL)
            WHEN 1 THEN list_filter([CASE WHEN NOT o THEN 'object' END, CASE WHEN NOT s THEN 'subject' END], lambda x: x IS NOT NULL)
            ELSE list_filter([CASE WHEN k % 4 = 0 THEN 'dimension' END, CASE WHEN NOT s THEN 'subject' END, CASE WHEN NOT v THEN 'value' END], lambda x: x IS NOT NULL) END AS missing FROM p),
        g AS (SELECT proposal_id, count(*) AS n, count(*) FILTER (len(missing) = 0) AS ready, count(*) FILTER (missing IS NULL) AS unsupported, min(missing[1]) FILTER (len(missing) = 1) AS ask FROM m GROUP BY 1),
        d AS (SELECT *, CASE WHEN ready = n THEN 'auto' WHEN ready > 0 THEN 'partial' WHEN ask IS NOT NULL THEN 'clarify' WHEN unsupported = n THEN 'unsupported' ELSE 'safe_abstain' END AS decision FROM g)
        SELECT proposal_id, n, ready, decision, CASE WHEN decision = 'clarify' THEN ask END AS ask FROM d""",
    "answer_projection": _with(_ATTRIBUTE, _lookup("entity_id, dimension", "true")) + " SELECT status, CASE WHEN status IN ('unknown', 'temporally_unknown') THEN 'unknown' WHEN n_values > 1 THEN 'list' WHEN value IS NOT NULL THEN 'value' ELSE 'empty' END AS kind, count(*) AS n FROM answered GROUP BY ALL",
    "event_roles": """WITH m AS (SELECT l_orderkey AS proposal_id, l_orderkey * 10 + l_linenumber AS mention_id, l_partkey % 3 AS k, l_linenumber AS n, l_partkey % 7 = 0 AS h_actor, l_partkey % 7 != 0 AND l_partkey % 5 = 0 AS h_object,
            l_orderkey % 2 = 0 AS change, l_linenumber = 1 AND l_orderkey % 3 = 0 AND l_partkey % 3 != 0 AS affected FROM lineitem),
        r AS (SELECT *, CASE WHEN affected THEN 'role.patient' WHEN NOT bool_or(affected) OVER (PARTITION BY proposal_id) AND k = 0 AND (h_actor OR (n = 1 AND change)) THEN 'role.actor'
            WHEN n = 2 OR h_object THEN 'role.object' WHEN k = 1 THEN 'role.context' END AS role FROM m)
        SELECT proposal_id, mention_id, role FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id, role, k ORDER BY mention_id) AS i FROM r WHERE role IS NOT NULL) WHERE role != 'role.context' OR i = 1""",
    "propagated_hints": """WITH m AS (SELECT l_orderkey AS p, l_orderkey * 10 + l_linenumber AS mention_id, CASE WHEN l_partkey % 4 = 0 THEN 'class' || (l_partkey % 8) END AS h FROM lineitem)
        SELECT mention_id, coalesce(h, CASE WHEN n = 1 THEN o END) AS class_hint FROM m JOIN (SELECT p, count(DISTINCT h) AS n, min(h) AS o FROM m GROUP BY 1) USING (p)""",
    "type_evidence": f"{_with(_ENTITY)} SELECT entity_id AS mention_id, entity_id, CASE left(entity_id, 2) WHEN 'c:' THEN 'type_descendant_match' WHEN 'n:' THEN 'type_match' WHEN 'r:' THEN 'type_descendant_match' END AS evidence FROM entity",
    "entity_resolution_contextual": """SELECT user_id AS mention_id, CASE WHEN count(*) FILTER (user_id % 2 != 0 OR event_type = 'click') > 0 THEN 'resolved' ELSE 'unresolved' END AS status,
        'e:' || max(event_id) FILTER (user_id % 2 != 0 OR event_type = 'click') AS entity_id FROM events GROUP BY 1""",
}
