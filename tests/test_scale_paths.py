"""Other ways beyond a size, limits that are none, and keys that keep users apart."""

import datetime as dt
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.functions import text as X
from veritempo.functions.text import fold
from veritempo.operators import automaton, claims, concepts, events, interpret, ledger, linkage, ranges, relations, repairs, scope, states, targets
from veritempo.queries import QUERIES


def test_frames_with_and_without_users_do_not_mix(spark):
    some, none = spark.createDataFrame([(1, 2)], "user_id long, id long"), spark.createDataFrame([(2,)], "id long")
    assert scope.by_user(some, some) == ["user_id"] and scope.by_user(none) == [] and scope.by_user(some, none, shared=True) == []
    with pytest.raises(scope.MixedUsersError):
        scope.by_user(some, none)


def test_closure_has_no_limit_of_rows(spark):
    """Six thousand chains of twenty concepts have 1.26 million pairs; a recursive query stops at a million rows."""
    chains, length = 6_000, 20
    rows = spark.range(chains * length).select(F.col("id").cast("string").alias("concept"), F.when(F.col("id") % length > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    found = events.closure(rows).agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum("depth").alias("all")).first()
    assert (found["n"], found["deepest"]) == (chains * length * (length + 1) // 2, length - 1) and found["n"] > 1_000_000
    assert found["all"] == chains * sum(d * (length - d) for d in range(length))


def test_closure_of_deep_chains_cycles_and_several_parents(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(41)]
    ring = [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), ("d", "b"), ("d", "c40"), ("b", None)]
    found = {(r.concept, r.ancestor): r.depth for r in events.closure(spark.createDataFrame(chain + ring, "concept string, parent string")).collect()}
    assert found["c40", "c8"] == 32 and ("c40", "c7") not in found and found["c5", "c0"] == 5
    assert [found["x", a] for a in "xyz"] == [0, 1, 2] and found["s", "s"] == 0 and found["d", "b"] == 1 and found["d", "c10"] == 31


def test_expressions_by_automaton_and_by_join(spark):
    rng = random.Random(2)
    expressions = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 7)))) for i in range(200)] + [(900, ""), (901, "ab"), (902, "ab")]
    texts = [(i % 2 + 1, i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(1, 80, None)]
    told, said = spark.createDataFrame(expressions, "expression_id int, expression string"), spark.createDataFrame(texts, "user_id long, id long, text string")
    brute = sorted((u, i, e) for u, i, t in texts for e, x in expressions if t and x and x in t)
    for most in (automaton.MOST_EXPRESSIONS, 10):
        found = automaton.expressions_in(said, told, ["user_id", "id"], most).collect()
        assert sorted(map(tuple, found)) == brute
    assert automaton.expressions_in(said, told.limit(0), ["user_id", "id"]).collect() == []


def test_ranges_meet_windows_once(spark):
    rng = random.Random(4)
    zero = dt.datetime(2020, 1, 1)
    spans = lambda n, longest: [(1, i, zero + dt.timedelta(minutes=rng.randrange(10**6)), rng.choice([1, 60, 1440, 10_000, longest])) for i in range(n)]
    asked = [(u, i, a, a + dt.timedelta(minutes=m)) for u, i, a, m in spans(60, 500_000)] + [(1, 99, zero, zero)]
    held = [(u, i, a, a + dt.timedelta(minutes=m)) for u, i, a, m in spans(200, 900_000)]
    found = ranges.overlapping(spark.createDataFrame(asked, "user_id long, request_id long, start timestamp, end timestamp"), spark.createDataFrame(held, "user_id long, event_id long, w_start timestamp, w_end timestamp"), ["user_id"])
    brute = sorted((r[1], h[1]) for r in asked for h in held if r[2] < h[3] and h[2] < r[3] and r[2] < r[3])
    assert sorted((r.request_id, r.event_id) for r in found.collect()) == brute


def test_membership_in_many_ranges_equals_one_by_one(spark):
    day = dt.date(2021, 5, 10)
    at = spark.range(40).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 5 == 0, T.in_month(F.lit(2021), F.lit(5))).when(F.col("id") % 5 == 1, T.at_instant(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(dt.datetime(2021, 5, 9))))).when(F.col("id") % 5 == 2, T.unknown_time(F.lit("once"))).otherwise(T.on_day(F.date_add(F.lit(day), F.col("id").cast("int") - 20))).alias("temporal"),
    )
    spans = [(0, dt.datetime(2021, 5, 1), dt.datetime(2021, 6, 1)), (1, dt.datetime(2021, 5, 10), dt.datetime(2021, 5, 11)), (2, dt.datetime(2021, 5, 10, 7), dt.datetime(2021, 5, 10, 8))]
    found = {r.request_id: (r.n, r.n_unknown) for r in ranges.counted(spark.createDataFrame(spans, "request_id long, start timestamp, end timestamp"), at).collect()}
    for number, start, end in spans:
        one = at.withColumn("m", T.occurrence_membership(F.col("temporal"), F.lit(start), F.lit(end))).agg(F.count_if(F.col("m") == "match"), F.count_if(F.col("m") == "unknown")).first()
        assert found[number] == tuple(one)


def test_last_replacements(spark):
    rows = [(1, "fact", 1, "replace", 2), (1, "fact", 2, "replace", 3), (2, "fact", 1, "replace", 9), (1, "fact", 5, "replace", 6), (1, "fact", 6, "retract", None), (1, "fact", 7, "replace", 8), (1, "fact", 8, "replace", 7), (1, "fact", 10, "replace", 11), (1, "fact", 11, "retract", None), (1, "fact", 11, "replace", 12), (1, "state", 2, "replace", 4)]
    found = {(r.user_id, r.kind, r.target_id): (r.last_id, r.steps, r.outcome) for r in ledger.last_replacements(spark.createDataFrame(rows, "user_id long, kind string, target_id long, action string, replacement_id long")).collect()}
    assert found == {
        (1, "fact", 1): (3, 2, "replaced"), (1, "fact", 2): (3, 1, "replaced"), (2, "fact", 1): (9, 1, "replaced"), (1, "fact", 5): (6, 2, "retracted"), (1, "fact", 6): (6, 1, "retracted"),
        (1, "fact", 7): (7, None, "cycle"), (1, "fact", 8): (7, None, "cycle"), (1, "fact", 10): (11, 1, "branched"), (1, "fact", 11): (11, 0, "branched"), (1, "state", 2): (4, 1, "replaced"),
    }


def test_fold_of_composed_and_decomposed_letters(spark):
    texts = [("Não", "nao"), ("Não", "nao"), ("Šárka", "sarka"), ("ỆẠ ﬁm Ｆull ½", "ea fim full 1⁄2"), ("Ёлка", "елка"), ("İstanbul", "istanbul"), ("日本 m²", "日本 m2"), ("", ""), (None, None)]
    df = spark.createDataFrame(texts, "text string, folded string")
    assert [r[0] for r in df.select(fold(F.col("text"))).collect()] == [b for _, b in texts]


def test_fold_costs_little_where_no_character_is_spelled_out(spark):
    """A class of hundreds of ligatures took most of the time of every rule over folded texts."""
    assert [chr(i) for i in range(0x80, 0x10000) if re.match(X._LIGATURE, chr(i))] == sorted(X._LIGATURES)
    rows = spark.range(0, 150_000, 1, 4).select(F.concat(F.lit("Não, na verdade isto foi em 2025 e de novo "), F.col("id").cast("string")).alias("text"))

    def seconds(frame):
        began = time.monotonic()
        frame.write.format("noop").mode("overwrite").save()
        return time.monotonic() - began

    seconds(rows.select(fold(F.col("text"))).limit(1))
    folded = min(seconds(rows.select(fold(F.col("text")))) for _ in range(2))
    assert folded < seconds(rows.select(F.col("text").rlike("[" + "".join(X._LIGATURES) + "]"))) / 2


def test_lists_are_limited_before_they_are_shuffled(spark):
    items = spark.range(5000).select((F.col("id") % 3).alias("user_id"), F.col("id").alias("event_id"), F.col("id").cast("string").alias("event_time"))
    rows = events.listed(items, ["user_id"], 4)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    found = rows.collect()
    assert len(found) == 12 and {r.matched_count for r in found} == {1667, 1666}


#: Rows on each side that say the same: as pairs they would be 900 million.
ALIKE = 30_000
SOON = 60


def test_equal_descriptions_and_equal_candidates_make_no_pairs(spark):
    asked = spark.range(ALIKE).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("description_id"), F.lit("0001").alias("part"))
    held = spark.range(ALIKE).select(F.lit(1).cast("long").alias("user_id"), F.col("id"), F.array(F.concat(F.lit("Customer#0001"), (F.col("id") % 2).cast("string"))).alias("names"))
    began = time.monotonic()
    found = targets.matches(asked, held, ["user_id"]).groupBy("n", "one").count().collect()
    assert [tuple(r) for r in found] == [(ALIKE, 0, ALIKE)] and time.monotonic() - began < SOON


def test_equal_ranges_and_equal_windows_make_no_pairs(spark):
    day = dt.date(2021, 5, 10)
    asked = spark.range(ALIKE).select(F.col("id").alias("request_id"), F.lit(dt.datetime(2021, 5, 1)).alias("start"), F.lit(dt.datetime(2021, 6, 1)).alias("end"))
    held = spark.range(ALIKE).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, T.in_year(F.lit(2021))).when(F.col("id") % 3 == 1, T.unknown_time(F.lit("once"))).otherwise(T.on_day(F.lit(day))).alias("temporal"))
    began = time.monotonic()
    found = ranges.counted(asked, held).groupBy("n", "n_unknown").count().collect()
    assert [tuple(r) for r in found] == [(ALIKE // 3, ALIKE // 3 * 2, ALIKE)] and time.monotonic() - began < SOON


def test_a_common_name_makes_no_pairs(spark):
    asked = spark.range(ALIKE).select(F.col("id").alias("mention_id"), F.lit(" hot  Bolt").alias("text"), F.when(F.col("id") % 2 == 0, "b").alias("hint"))
    held = spark.range(ALIKE).select(F.col("id").cast("string").alias("entity_id"), F.when(F.col("id") == 7, "b").otherwise("a").alias("type_key"), F.lit("Hot bolt").alias("name"), F.lit("HOT BOLT").alias("alias"))
    began = time.monotonic()
    found = linkage.resolve_named(asked, held, spark.createDataFrame([("a", None), ("b", None)], "concept string, parent string")).groupBy("status", "entity_id", "n").count().collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, [("resolved", "7", ALIKE, ALIKE // 2), ("ambiguous", None, ALIKE, ALIKE // 2)])) and time.monotonic() - began < SOON


def test_aliases_meet_runs_of_words_and_no_text(spark):
    texts = spark.createDataFrame([("a", "Of the, and THE end"), ("b", "theof"), ("c", None), ("d", ""), ("e", "the")], "text_id string, text string")
    aliases = spark.createDataFrame([("the", "one", 1), ("and the", "two", 1), ("of", "three", 0), ("", "none", 9), ("the and the end of", "long", 9)], "alias string, concept string, priority int")
    rows = interpret.alias_matches(texts, aliases)
    assert sorted(map(tuple, rows.collect())) == [("a", "and the", "two"), ("e", "the", "one")]
    assert interpret.alias_matches(texts, aliases.limit(0)).collect() == []
    assert "contains(low" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_answers_without_names_are_spread(spark):
    """The most common answer was one key of the join with names, so a single task's rows; and the outcomes stay the same."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        k = F.col("id")
        pending = spark.range(4_000).select(F.lit(1).cast("long").alias("user_id"), k.alias("pending_id"), F.lit("open").alias("state"), F.when(k < 4, "entity_reference").otherwise("value").alias("expects"), F.when(k < 4, "subject").when(k < 8, "subject").otherwise("value").alias("slot"), F.lit(0).alias("rounds"), F.lit("").alias("answered"))
        answers = spark.range(4_010).select(F.when(k < 4_000, 1).when(k < 4_005, 3).otherwise(1).cast("long").alias("user_id"), F.when(k >= 4_000, F.when(k < 4_005, k - 4_000).otherwise(k)).otherwise(k).alias("pending_id"), F.when(k == 0, "Ana").when(k == 1, "Rui").otherwise("7").alias("text"))
        entities = spark.createDataFrame([(1, "e:1", "ana"), (1, "e:2", "rui"), (1, "e:3", "Rui"), (1, "e:4", "7"), (2, "e:5", "ana")], "user_id long, entity_id string, name string")
        rows = claims.recovered(pending, answers, entities).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    found = sorted((r.pending_id, r.user_id, r.outcome, r.filled) for r in rows)
    assert len(found) == 4_005 and [x for x in found if x[1] == 3] == [(i, 3, "rejected", None) for i in range(5)]
    assert [x[2:] for x in found if x[1] == 1][:9] == [("recovered", "e:1"), ("asked_again", None), ("recovered", "e:4"), ("recovered", "e:4")] + [("unsupported_slot", None)] * 4 + [("recovered", "7.00")]
    sizes = Counter(r.task for r in rows)
    assert max(sizes.values()) < len(rows) / 2


def test_rounds_of_replacements_follow_their_length(spark, monkeypatch):
    """Circles end after a few rounds, not after log2 of all corrections; ways of every kind equal those followed one by one."""
    rng = random.Random(7)
    rows = {i: rng.randrange(i - 3, i + 3) for i in range(1, 1_500) if rng.random() < 0.9} | {i: i + 1 if i % 2 else i - 1 for i in range(3_001, 6_001)} | {i: i + 1 for i in range(9_000, 9_040)}
    retracted = {i for i in rows if i % 41 == 0}
    frame = spark.createDataFrame([("fact", i, "retract" if i in retracted else "replace", None if i in retracted else j) for i, j in rows.items()], "kind string, target_id long, action string, replacement_id long")
    made, cut = [], ledger.checkpoint
    monkeypatch.setattr(ledger, "checkpoint", lambda df: made.append(1) or cut(df))
    found = {r.target_id: (r.last_id, r.steps, r.outcome) for r in ledger.last_replacements(frame).collect()}

    def followed(i):
        way = []
        while i in rows and i not in way:
            way.append(i)
            if i in retracted:
                return i, len(way), "retracted"
            i = rows[i]
        return (min(way), None, "cycle") if i in way else (i, len(way), "replaced")

    assert found == {i: followed(i) for i in rows}
    assert len(made) <= 8


def test_equal_proposals_are_resolved_once(spark):
    """Rules over words read each different proposal once; its number and its last id stay."""
    rows = [(1, i, "troquei", None if i % 2 else "person") for i in range(100)] + [(2, i, "troquei", None) for i in range(7)]
    found = concepts.different_proposals(spark.createDataFrame(rows, "user_id long, proposal_id long, raw_input string, subject_kind string")).collect()
    assert {(r.user_id, r.subject_kind): (r.n, r.proposal_id) for r in found} == {(1, None): (50, 99), (1, "person"): (50, 98), (2, None): (7, 6)}


def test_equal_proposals_are_repaired_once(spark, monkeypatch):
    """The rules see each different proposal once; proposals with nulls find their repair and keep other columns."""
    flags = ["change", "condition", "link", "stable", "classification", "measures", "correction", "has_claims"]
    texts = ["primitive_hint", "subject_text", "subject_kind", "subject_reference", "object_text", "object_kind", "object_reference", "attribute_expression", "relation_expression", "action_expression", "event_expression", "measure_dimension", "lifecycle", "aspect"]
    k = F.col("id")
    rows = spark.range(60).select(k, F.lit("query").alias("utterance_kind"), F.when(k % 3 == 0, "Qual é o meu nome?").when(k % 3 == 1, "nada").alias("raw_input"), *[F.lit(None).cast("string").alias(c) for c in texts], *[F.lit(False).alias(c) for c in flags])
    seen, apply = [], repairs._repaired
    monkeypatch.setattr(repairs, "_repaired", lambda df, chosen: seen.append(df.count()) or apply(df, chosen))
    names = [r for r in repairs.rules() if r.name == "name_query"]
    found = {r.id: (r.attribute_expression, r.raw_input, list(r.repairs)) for r in repairs.repaired(rows, names).collect()}
    assert found == {i: [("nome", "Qual é o meu nome?", ["name_query"]), (None, "nada", []), (None, None, [])][i % 3] for i in range(60)} and seen == [3]


def test_rules_over_parts_are_dealt_to_all_cores(spark):
    """Parts lie in one small file, which was one task's; the rules over their texts come after they are dealt by key."""
    plan = QUERIES["attribute_values_stated"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[user_id#\d+L?, p_partkey#\d+L?\]", plan)


def test_words_of_sources_are_made_once_for_each_reply(spark):
    """Six thousand words against six thousand: a source folded again for every word takes minutes."""
    words = [f"palavra{chr(97 + i % 26)}{i}x" for i in range(6_000)]
    rows = spark.createDataFrame([(" ".join(words) + " 12345 12345 Ação novidade casa", " ".join(words[:-2]) + " 12345 ACAO", "casa"), (None, None, None), ("abc 1234 de", "1234", None)], "reply string, question string, more string")
    began = time.time()
    found = [r.w for r in rows.select(interpret.unattested(F.col("reply"), [F.col("question"), F.col("more")]).alias("w")).collect()]
    assert found == [sorted(["12345", "novidade", *words[-2:]]), [], ["1234"]] and time.time() - began < 15


@pytest.mark.parametrize("name", ["primitive_routing", "assertion_collection", "evidence_flags"])
def test_evidence_of_lines_is_judged_once_for_each_different_one(spark, name):
    """Lines are counted by their evidence before any text of theirs is folded."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    try:
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
        spark.conf.unset("spark.sql.maxPlanStringLength")
    below = plan[plan.rindex("Aggregate [") :].partition("\n")[2]
    assert "translate(" in plan and "Relation" in below and "translate(" not in below


def test_candidates_are_validated_once_for_all_that_is_made_of_them(spark):
    plan = QUERIES["ingest_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("orders") + plan.count("o_orderkey") > 0 and "entity.foreign" not in plan and "LeftAnti" not in plan


def test_current_states_are_folded_at_the_top_time_only(spark):
    """A sort of all states before they are folded, or a group for each different time, held a whole split in one task."""
    rng = random.Random(11)
    day = dt.date(2020, 1, 1)
    rows = [(rng.choice(["a", "b", "c", None, *map(str, range(60))]), i // 2, rng.choice("xyz"), rng.randrange(5) > 0, rng.choice([None, *range(6)]), rng.choice([None, None, None, 1, 2])) for i in range(600)]
    told = spark.createDataFrame(rows, "entity_id string, state_id long, value string, is_current boolean, d int, m int")
    time_ = F.when(F.col("m").isNotNull(), T.in_month(F.lit(2019), F.col("m"))).when(F.col("d").isNull(), T.unknown_time(F.lit("once"))).otherwise(T.on_day(F.date_add(F.lit(day), F.col("d"))))
    asked = told.withColumn("temporal", time_)

    def answer(held):
        live = [((1, m) if m is not None else (0, d), i, v) for e, i, v, c, d, m in rows if e == held and c and not (m is None and d is None)]
        lone = [(i, v) for e, i, v, c, d, m in rows if e == held and c and m is None and d is None]
        if live:
            same = sum(x[0] == max(live)[0] for x in live)
            return (*max(live)[1:], "partial" if lone else "indeterminate" if same > 1 else "complete", len(lone) or int(same > 1))
        return (*lone[0], "partial", 0) if len(lone) == 1 else (None, None, "indeterminate", len(lone))

    for few in (False, True):
        out = states.current(asked, ["entity_id"], few)
        found = out.collect()
        assert {r.entity_id: (r.state_id, r.value, r.completeness, r.n_open) for r in found} == {e: answer(e) for e in {r[0] for r in rows if r[3]}} and len(found) == len({r.entity_id for r in found})
        plan = out._jdf.queryExecution().sparkPlan().toString()
        below = plan[plan.index("Join") :]
        assert "SortAggregate" not in below and below.count("HashAggregate(keys=[entity_id") == below.count("HashAggregate") > 0


def test_items_of_a_card_are_counted_before_they_meet_names(spark):
    """A joined row for each state, with its name, was held by the task that counts; names of all parts were broadcast."""
    no = lambda kinds: spark.createDataFrame([], kinds)
    entities = spark.createDataFrame([(1, "p:1", "bolt"), (1, "p:1", "bolt"), (1, "p:2", None), (2, "p:1", "nut"), (1, "p:3", "nail")], "user_id long, entity_id string, name string")
    told = spark.createDataFrame([(1, "p:1", "open", "O", True)] * 3 + [(1, "p:1", "open", "F", False), (1, "p:2", "open", "F", True), (2, "p:1", "open", "O", True), (1, "p:3", "open", "O", True), (1, None, "open", "O", True)], "user_id long, entity_id string, dimension string, value string, is_current boolean")
    ends = spark.createDataFrame([(1, "p:1", "p:2", "near", True)], "user_id long, from_id string, to_id string, key string, is_current boolean")
    wanted = spark.createDataFrame([("p:1",), ("p:2",)], "entity_id string")
    rows = relations.entity_card(entities, ends, no("user_id long, entity_id string, dimension string, text_value string, numeric_value decimal(18,2), unit string, is_current boolean"), told, wanted)
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, [
        (1, "p:1", "bolt", "states", "open O", 6), (1, "p:1", "bolt", "relations_out", "near p:2", 2), (1, "p:2", None, "relations_in", "near p:1", 1),
        (1, "p:2", None, "states", "open F", 1), (2, "p:1", "nut", "states", "open O", 1),
    ]))
    plan = QUERIES["entity_card"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate [") and "item#" in plan.partition("Aggregate [")[2].partition("\n")[0]


def test_the_first_relation_is_found_among_answers(spark):
    """Whole relations, with their times in every form, were sorted where the answer of each is enough."""
    at = lambda day: dt.datetime(2020, 1, day)
    told = [("a", 2, at(1), None, True), ("a", 1, at(9), None, True), ("b", 1, at(1), at(30), False), ("b", 2, at(9), None, True), ("c", 1, None, None, True), ("d", 1, at(1), at(5), False), ("e", 1, None, at(5), False), ("f", 1, at(1), None, None), (None, 1, at(1), None, True)]
    rows = spark.createDataFrame(told, "subject string, relation_id long, valid_from timestamp, valid_to timestamp, is_current boolean").withColumns({"temporal": F.when(F.col("subject") == "c", T.at_instant(F.lit(at(2)))).otherwise(T.unknown_time(F.lit("once"))), "terminated": F.lit(None).cast("timestamp")})
    out = relations.held_during(rows, ["subject"], F.lit(at(10)), F.lit(at(20)))
    assert {r.subject: r.answer for r in out.collect()} == {"a": "yes", "b": "yes", "c": "yes", "d": "no", "e": "no", "f": "unknown", None: "yes"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "temporal" not in plan.partition("Aggregate [")[2].partition("\n")[0]


def test_ranges_are_counted_over_all_orders(spark, tmp_path):
    """Only every third order was read; none of these is one of them."""
    day = dt.datetime(1993, 5, 5)
    spark.createDataFrame([(3,), (8,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    fields = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame([(k, 3, "O", 1.0, day, "1-URGENT") for k in (4, 5, 7, 8)], fields).write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["counts_in_many_ranges"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(1, 3, 4, 0, "complete"), (1, 8, 4, 0, "complete"), (2, 8, 2, 0, "complete")]
