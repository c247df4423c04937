"""SQL of the write path."""

from __future__ import annotations

from veritempo.oracle import _ENTITY, _FACT, _fold, _with
from veritempo.oracle_rules import GUARDED, _list, _pick, _said
from veritempo.oracle_users import _TWO_ENTITIES, _TWO_FACTS, _USERS
from veritempo.queries_rules import GUARD_PARTS
from veritempo.queries_writes import POLICIES, REFERENCES, ROLES, STATUSES

_CANDIDATES = f"""
c AS (SELECT o_orderkey AS k, (o_orderkey % 2 + 1)::BIGINT AS user_id, {_pick(["event", "event", "state", "relation", "obligation"]).replace("k //", "o_orderkey //")} AS prim, o_orderkey % 5 != 4 AND (o_orderkey % 7 = 0 OR o_orderkey % 10 != 2) AS persistable FROM orders),
m AS (SELECT l_orderkey AS k, (l_orderkey % 2 + 1)::BIGINT AS user_id, l_linenumber AS n, l_partkey AS part, {_list(STATUSES)}[l_partkey % 7 + 1] AS status, {_list(REFERENCES)}[l_suppkey % 5 + 1] AS ref, {_list(ROLES)}[(l_linenumber + l_partkey) % 5 + 1] AS role FROM lineitem WHERE l_linenumber >= 3),
checked AS (SELECT *, status = 'create_candidate' AS creates, ref IN ('contextual', 'possessive') AS bound_, n % 4 != 0 AND (ref = 'possessive' OR n % 2 = 0) AS may FROM m),
refused AS (SELECT *, creates AND CASE WHEN bound_ THEN NOT may ELSE k % 10 = 0 END AS bad FROM checked),
r AS (SELECT l_orderkey AS k, l_suppkey % 6 AS wanted, (CASE WHEN l_partkey % 6 != 0 THEN l_suppkey % 6 ELSE l_partkey END) % 7 AS got FROM lineitem WHERE l_linenumber <= 2),
issues AS (
    SELECT k, 'error' AS s, CASE WHEN got = 6 THEN 'ontology.unknown' WHEN got != wanted THEN 'ontology.kind_mismatch' END AS code FROM r
    UNION ALL SELECT k, 'error', CASE WHEN status = 'ambiguous' THEN 'entity.ambiguous' WHEN bad THEN 'entity.create_not_allowed' WHEN status = 'unresolved' AND bound_ THEN 'entity.contextual_unresolved' END FROM refused
    UNION ALL SELECT k, 'warning', CASE WHEN creates AND NOT bad THEN 'entity.create_pending' END FROM refused
    UNION ALL SELECT k, 'error', CASE WHEN status = 'resolved' AND ((user_id = 2 AND part % 2 != 0) OR part NOT IN (SELECT p_partkey FROM part)) THEN 'entity.foreign' END FROM m
    UNION ALL SELECT k, 'error', CASE WHEN prim IN ('event', 'state', 'relation') AND NOT persistable THEN 'time.missing' WHEN prim = 'event' AND k % 14 = 0 AND k % 28 != 0 THEN 'time.precision_promoted' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN prim = 'obligation' AND ((k % 3 = 0 AND k % 8 >= 6) OR (k % 8 < 6 AND k % 25 = 4)) THEN 'time.recurrence_incompatible' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN k % 10 = 0 AND k % 20 != 0 THEN 'correction.target_unresolved' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN k % 3 = 0 AND k % 40 = 0 THEN 'epistemic.exact_vs_uncertain' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN k % 3 = 1 AND k % 41 = 0 THEN 'epistemic.confidence_inflated' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN k % 40 = 1 AND k % 3 != 0 THEN 'epistemic.inference_source' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN k % 31 = 0 THEN 'value.money_invalid' WHEN k % 43 = 0 THEN 'value.money_currency_missing' END FROM c
    UNION ALL SELECT k, 'error', CASE WHEN k % 31 != 0 AND k % 37 = 1 THEN 'value.amount_negative' END FROM c),
judged AS (SELECT c.k, c.user_id, c.prim, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (s = 'error'), '') AS errors, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (s = 'warning'), '') AS warnings
    FROM c LEFT JOIN issues i ON i.k = c.k AND code IS NOT NULL GROUP BY ALL),
ok AS (SELECT * FROM judged WHERE errors = '' AND k % 12 != 0),
bound AS (SELECT m.*, CASE WHEN status = 'resolved' THEN 'p:' || part ELSE 'new' || n END AS entity, CASE role WHEN 'role.provider' THEN 'role.actor' WHEN 'role.instrument' THEN NULL ELSE role END AS plays FROM m JOIN ok USING (k) WHERE status = 'resolved' OR (status = 'create_candidate' AND n % 4 != 0)),
parts AS (SELECT k, entity, plays, min(n) AS place FROM bound WHERE plays IS NOT NULL GROUP BY ALL),
slots AS (SELECT k, arg_min(entity, (place, entity)) FILTER (plays = 'role.actor') AS actor, arg_min(entity, (place, entity)) FILTER (plays IN ('role.object', 'role.patient')) AS subject, count(*) AS n_participants FROM parts GROUP BY 1),
made AS (SELECT ok.*, actor, subject, coalesce(n_participants, 0) AS n_participants FROM ok LEFT JOIN slots USING (k) WHERE prim IN ('event', 'obligation'))"""

_ISSUED = f"WITH{_CANDIDATES}"


def _slot(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '' WHEN starts_with({column}, 'p:') THEN {column} ELSE 'new' END"


SQL: dict[str, str] = {
    "stated_times": f"""WITH s AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 9 != 0 THEN o_orderdate::DATE - 1 END AS today, CASE WHEN o_orderkey % 5 = 0 THEN ['today', 'yesterday', 'tomorrow'][o_orderkey % 3 + 1] END AS rel,
            CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 8 END AS wd, {_list(POLICIES)}[o_orderkey % 5 + 1] AS pol, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' WHEN o_orderkey % 6 = 1 THEN 'scheduled' END AS status, o_orderkey % 4 = 0 AS clock, o_orderkey % 11 = 0 AS recurs,
            o_orderkey % 13 = 0 AS p0, o_orderkey % 26 = 0 AS p1, o_orderkey % 17 = 0 AS mon, o_orderkey % 19 = 0 AS yr, CASE WHEN o_orderkey % 23 = 0 THEN 'after' WHEN o_orderkey % 29 = 0 THEN 'before' END AS said FROM orders),
        a AS (SELECT *, coalesce(pol, CASE WHEN status IS NOT NULL THEN 'from_status' END) AS asked, CASE rel WHEN 'today' THEN today WHEN 'yesterday' THEN today - 1 WHEN 'tomorrow' THEN today + 1 END AS by_rel, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 30 = 0 THEN d ELSE d + 1 END END AS absolute FROM s),
        p AS (SELECT *, CASE WHEN asked != 'from_status' THEN asked WHEN status = 'scheduled' THEN 'next' WHEN status = 'completed' THEN 'previous' END AS policy, isodow(today) - 1 AS w FROM a),
        b AS (SELECT *, CASE WHEN wd IS NOT NULL THEN CASE policy WHEN 'next' THEN today + ((wd - w + 7) % 7)::INT WHEN 'previous' THEN today - ((w - wd + 7) % 7)::INT WHEN 'next_strict' THEN today + (CASE WHEN (wd - w + 7) % 7 = 0 THEN 7 ELSE (wd - w + 7) % 7 END)::INT END END AS by_wd FROM p),
        e AS (SELECT *, coalesce(by_rel, by_wd, absolute) AS day FROM b),
        g AS (SELECT *, day IS NOT NULL OR recurs OR (p0 AND p1) AS calendar, coalesce(CASE WHEN yr THEN 1999 END, year(today)) AS y, CASE WHEN (rel IS NOT NULL OR wd IS NOT NULL) AND today IS NULL THEN 'reference_missing' WHEN wd > 6 THEN 'weekday_impossible' WHEN wd IS NOT NULL AND policy IS NULL THEN 'policy_missing'
            WHEN clock AND day IS NULL AND NOT recurs THEN 'day_missing' WHEN p0 != p1 THEN 'period_open' WHEN p1 AND k % 3 = 0 THEN 'period_reversed' WHEN len(list_distinct(list_filter([by_rel, by_wd, absolute], lambda x: x IS NOT NULL))) > 1 THEN 'several_dates' WHEN wd IS NOT NULL AND day IS NOT NULL AND isodow(day) - 1 != wd THEN 'weekday_mismatch' END AS err FROM e),
        h AS (SELECT *, coalesce(err, CASE WHEN NOT calendar AND said IS NULL AND NOT yr AND NOT mon AND coalesce(status, '') != 'completed' THEN 'insufficient' END) AS error FROM g)
        SELECT k, coalesce(error, '') AS error, CASE WHEN error IS NOT NULL THEN '' WHEN NOT calendar THEN CASE WHEN said IS NOT NULL THEN 'partial.relation' WHEN mon THEN 'partial.month' WHEN yr THEN 'partial.year' ELSE 'partial.status' END WHEN rel IS NOT NULL THEN 'relative.' || rel WHEN wd IS NOT NULL THEN 'weekday.' || asked
                WHEN recurs AND absolute IS NULL THEN 'recurrence.monthly_by_monthday' WHEN p0 THEN 'period.explicit' WHEN clock AND day IS NOT NULL THEN 'absolute.datetime' ELSE 'absolute.date' END AS rule,
            CASE WHEN error IS NULL AND calendar THEN coalesce(day::VARCHAR, '') ELSE '' END AS day, CASE WHEN error IS NULL AND calendar AND clock AND day IS NOT NULL THEN strftime(day + INTERVAL 750 MINUTE, '%Y-%m-%d %H:%M') ELSE '' END AS instant,
            CASE WHEN error IS NOT NULL THEN '' WHEN calendar THEN CASE WHEN recurs AND day IS NULL THEN 'recurring' WHEN p0 THEN 'period' WHEN clock AND day IS NOT NULL THEN 'minute' ELSE 'day' END WHEN said IS NOT NULL THEN said WHEN NOT mon AND yr THEN 'year' WHEN mon AND y IS NOT NULL THEN 'month' ELSE 'before' END AS precision FROM h""",
    "candidate_validation": f"{_ISSUED} SELECT errors, warnings, errors = '' AS valid, count(*) AS n FROM judged GROUP BY ALL",
    "assessed_candidates": f"{_ISSUED} SELECT user_id, prim AS primitive, CASE WHEN errors = '' AND k % 12 != 0 THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS n FROM judged GROUP BY ALL",
    "materialised_events": f"""{_ISSUED} SELECT user_id, k AS candidate_id, CASE WHEN k % 3 = 0 THEN 'event.recurring_bill' ELSE 'event.order' END AS type_key, CASE WHEN prim = 'event' AND k % 4 != 0 THEN 'action.buy' ELSE '' END AS action, CASE prim WHEN 'event' THEN 'completed' ELSE 'scheduled' END AS status,
        {_slot("actor")} AS actor_id, {_slot("subject")} AS subject_id, n_participants, CASE WHEN prim = 'obligation' THEN 'recurring' WHEN k % 7 = 0 THEN 'minute' ELSE 'day' END AS precision FROM made""",
    "ingest_pipeline": f"""{_ISSUED} SELECT user_id, 'accepted' AS kind, count(*) AS n FROM ok GROUP BY 1 UNION ALL SELECT user_id, 'bound', count(*) FROM bound GROUP BY 1 UNION ALL SELECT user_id, 'new_entities', count(DISTINCT (k, n)) FROM bound WHERE status = 'create_candidate' GROUP BY 1
        UNION ALL SELECT m.user_id, 'refused_mentions', count(*) FROM m JOIN ok USING (k) WHERE status = 'create_candidate' AND n % 4 = 0 GROUP BY 1 UNION ALL SELECT user_id, 'participants', count(*) FROM parts JOIN ok USING (k) GROUP BY 1
        UNION ALL SELECT user_id, 'events', count(*) FROM made GROUP BY 1 UNION ALL SELECT user_id, 'facts', count(*) FROM made GROUP BY 1""",
    "materialised_measurements": """WITH e AS (SELECT event_id AS k, (event_id % 2 + 1)::BIGINT AS user_id, event_id % 100 AS s, CASE WHEN event_id % 5 = 0 THEN event_id % 90 END AS x FROM events),
        r AS (SELECT *, s IN (SELECT c_custkey FROM customer) AND (user_id = 1 OR s % 2 = 0) AS known, x IS NULL OR (x IN (SELECT c_custkey FROM customer) AND (user_id = 1 OR x % 2 = 0)) AS known_x FROM e),
        w AS (SELECT *, CASE WHEN NOT known THEN 'subject_unresolved' WHEN NOT known_x AND k % 4 != 0 THEN 'context_unresolved' WHEN k % 11 = 0 THEN 'number_invalid' END AS error FROM r)
        SELECT user_id, CASE WHEN error IS NULL THEN 'made' WHEN k % 4 = 0 THEN 'skipped' ELSE 'rejected' END AS outcome, coalesce(error, CASE WHEN k % 3 = 0 THEN 'observed' ELSE '' END) AS why, count(*) AS n FROM w GROUP BY ALL""",
    "principals": "SELECT * FROM (VALUES (1::BIGINT, 'c:1', 'kept'), (2, 'c:2', 'kept'), (3, 'c:3', 'broken'), (4, 'new', 'created'), (5, 'new', 'created')) AS t(user_id, entity_id, outcome)",
    "self_mentions": """WITH m AS (SELECT ['Eu', 'meu carro', '  Para   mim', 'Maria', 'MIM'][o_orderkey % 5 + 1] AS text, o_orderkey % 3 != 0 AS ctx, o_orderkey % 2 = 0 AS first FROM orders)
        SELECT text, CASE WHEN ctx THEN 'contextual' ELSE 'named' END AS reference_kind, CASE WHEN ctx AND first AND regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') IN ('eu', 'para mim', 'mim') THEN 'c:1' END AS self_id, count(*) AS n FROM m GROUP BY ALL""",
    "fact_corrections": f"""{_with(_FACT, _USERS, _TWO_FACTS)}, asked AS (SELECT o_orderkey AS k, (o_orderkey % 2 + 1)::BIGINT AS u, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 END AS fid, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS eid FROM orders),
        j AS (SELECT k, u, fid, eid, f.about_id AS about, (SELECT max(fact_id) FROM fact2 c WHERE c.user_id = u AND c.about_id = eid AND NOT EXISTS (SELECT 1 FROM fact2 l WHERE l.user_id = u AND l.supersedes_id = c.fact_id)) AS cur FROM asked LEFT JOIN fact2 f ON f.user_id = u AND f.fact_id = fid)
        SELECT u AS user_id, k AS correction_id, CASE WHEN fid IS NULL AND eid IS NULL THEN '' ELSE coalesce(about, eid)::VARCHAR END AS about_id, coalesce(CASE WHEN about IS NOT NULL THEN fid END, cur)::VARCHAR AS supersedes_id, '' AS error FROM j WHERE FALSE
        UNION ALL SELECT u, k, CASE WHEN (fid IS NULL AND eid IS NULL) OR (fid IS NOT NULL AND about IS NULL) THEN '' ELSE coalesce(about, eid)::VARCHAR END, CASE WHEN (fid IS NULL AND eid IS NULL) OR (fid IS NOT NULL AND about IS NULL) THEN '' ELSE coalesce(coalesce(fid, cur)::VARCHAR, '') END,
            CASE WHEN fid IS NULL AND eid IS NULL THEN 'anchor_missing' WHEN fid IS NOT NULL AND about IS NULL THEN 'fact_missing' ELSE '' END FROM j""",
    "correction_requests": f"""{_with(_FACT, _USERS, _TWO_FACTS)}, asked AS (SELECT o_orderkey AS k, (o_orderkey % 2 + 1)::BIGINT AS u, o_orderkey % 5 != 0 AS repl, o_orderkey // 3 * 6 AS t, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey // 3 * 6 WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE (o_orderkey // 3 + 1) * 6 END AS r FROM orders),
        e AS (SELECT *, CASE WHEN (u, t) NOT IN (SELECT (user_id, fact_id) FROM fact2) THEN 'target_missing' WHEN repl AND (u, r) NOT IN (SELECT (user_id, fact_id) FROM fact2) THEN 'replacement_missing' WHEN repl AND r = t THEN 'self_replacement'
            WHEN (u, t) IN (SELECT (user_id, target_id) FROM correction2) THEN 'target_recorrected' END AS error FROM asked),
        n AS (SELECT *, coalesce(error, CASE WHEN row_number() OVER (PARTITION BY u, t ORDER BY error IS NOT NULL, k) > 1 THEN 'target_recorrected' END) AS why FROM e)
        SELECT u AS user_id, k AS request_id, coalesce(why, 'appended') AS outcome, CASE WHEN why IS NULL AND repl THEN r::VARCHAR ELSE '' END AS replacement_id FROM n""",
    "correction_utterances": f"""{_with(_FACT, _ENTITY, _USERS, _TWO_FACTS, _TWO_ENTITIES)}, t AS (SELECT k, (k % 2 + 1)::BIGINT AS u, o_custkey % 5 AS scope, lpad((o_custkey % 200)::VARCHAR, 4, '0') AS part, {_fold(_said(GUARD_PARTS))} AS t, o_custkey % 2 = 0 AS prior FROM (SELECT *, o_orderkey AS k FROM orders)),{GUARDED},
        live AS (SELECT user_id, split_part(entity_id, ':', 2)::BIGINT AS c, name FROM entity2 WHERE entity_id LIKE 'c:%' AND (user_id, split_part(entity_id, ':', 2)::BIGINT * 2) NOT IN (SELECT (user_id, target_id) FROM correction2)),
        aims AS (SELECT k, u, count(c) AS n, min(c) AS target FROM (SELECT * FROM guarded WHERE starts_with(x, 'accept')) LEFT JOIN live ON user_id = u AND c % 5 = scope AND contains(name, part) GROUP BY 1, 2),
        turns AS (SELECT *, CASE WHEN n = 1 THEN row_number() OVER (PARTITION BY u, n = 1, target ORDER BY k) END AS turn FROM aims),
        o AS (SELECT g.u AS user_id, CASE WHEN starts_with(x, 'clarify') THEN 'clarify' WHEN starts_with(x, 'reject') THEN 'rejected' WHEN n > 1 THEN 'target_ambiguous' WHEN n = 0 THEN 'target_unresolved' WHEN turn > 1 THEN 'rejected' ELSE 'committed' END AS outcome,
            CASE WHEN turn > 1 THEN 'target_recorrected' WHEN NOT starts_with(x, 'accept') THEN split_part(x, ' ', 2) END AS reason FROM guarded g LEFT JOIN turns USING (k))
        SELECT user_id, outcome, reason, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT user_id, 'entries', NULL, count(*) FROM o WHERE outcome = 'committed' GROUP BY 1""",
}
