"""Descriptions against candidates by brute force, files of one user, and questions with odd fields."""

import datetime as dt
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veritempo.operators import questions, targets
from veritempo.plans.spec import QuerySpec, execute
from veritempo.queries import QUERIES
from veritempo.sources.frames import KnowledgeFrames
from veritempo.sources.layout import FRAMES, read_by_user, store_by_user, write_by_user

CANDIDATES = "user_id long, scope int, id string, names array<string>, object_names array<string>, dimension string, key string, year int, action string, text string, number decimal(18,2)"
DESCRIPTIONS = "user_id long, scope int, description_id long, part string, object_part string, dimension string, key string, year int, action string, text string, number decimal(18,2)"


def _fits(d, c):
    said = lambda a, b: a is None or a == b
    loose = lambda a, b: a is None or b is None or a == b
    part, object_part = d[3] or None, d[4] or None
    return (
        d[0] == c[0] and d[1] == c[1] and (part is None or any(part in n for n in c[3] or [])) and (object_part is None or any(object_part in n for n in c[4] or []))
        and said(d[5], c[5]) and said(d[6], c[6]) and said(d[7], c[7]) and loose(d[8], c[8]) and loose(d[9], c[9]) and loose(d[10], c[10])
    )


def test_descriptions_by_the_rarest_term_and_by_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab-é") for _ in range(n))
    maybe = lambda *xs: rng.choice([None, *xs])
    held = [
        (rng.choice([1, 2]), rng.choice([1, 2]), str(i % 250), [word(rng.randrange(0, 7)) for _ in range(rng.randrange(0, 3))], maybe([word(4)], []), maybe("x", "y"), maybe("k"), maybe(1, 2), maybe("go"), maybe("t", "u"), maybe(Decimal(1), Decimal(2)))
        for i in range(300)
    ]
    held += [(1, 1, "many", ["ab" * 2000], None, None, None, None, None, None, None), (None, 1, "nobody", ["ab"], None, None, None, None, None, None, None)]
    asked = [
        (rng.choice([1, 2]), rng.choice([1, 2, 3]), i, maybe("", word(1), word(2), word(3), word(4)), maybe(word(2), word(3)), maybe("x", "z"), maybe("k"), maybe(1), maybe("go", "no"), maybe("t"), maybe(Decimal(1), Decimal(9)))
        for i in range(120)
    ]
    asked += [(1, 1, 900, None, None, None, None, None, None, None, None), (1, 1, 901, "ab" * 1500, None, None, None, None, None, None, None)]
    rows = targets.matches(spark.createDataFrame(asked, DESCRIPTIONS), spark.createDataFrame(held, CANDIDATES), ["user_id", "scope"]).collect()
    brute = {}
    for d in asked:
        ids = [c[2] for c in held if _fits(d, c)]
        if ids:
            brute[d[2]] = (len(ids), min(ids))
    assert {r.description_id: (r.n, r.one) for r in rows} == brute and len(rows) == len(brute) and brute[901] == (1, "many") and brute[900][0] > 1


def test_a_frequent_part_meets_by_its_rare_one(spark):
    """Of four thousand names with the same end, one with a rare middle: one candidate is compared, not four thousand."""
    held = spark.range(4000).select(F.lit(1).cast("long").alias("user_id"), F.lit(1).alias("scope"), F.col("id").cast("string").alias("id"), F.array(F.concat(F.when(F.col("id") == 77, "qz").otherwise("ab"), F.lit("-common"))).alias("names"))
    asked = spark.createDataFrame([(1, 1, 5, "qz-common")], "user_id long, scope int, description_id long, part string")
    whole = targets.matches(asked, held, ["user_id", "scope"])
    assert [(r.n, r.one) for r in whole.collect()] == [(1, "77")]
    empty = targets.matches(asked.limit(0), held, ["user_id", "scope"])
    assert empty.collect() == [] and targets.matches(asked, held.limit(0), ["user_id", "scope"]).collect() == []


def test_targets_stay_with_their_user_and_their_kind(spark):
    held = spark.createDataFrame([(1, "event", "5", ["ana"], "go"), (2, "event", "5", ["ana"], None), (1, "state", "5", ["ana"], None), (1, "event", "6", ["ana"], "stop")], "user_id long, kind string, id string, names array<string>, action string")
    more = {"object_names": "array<string>", "dimension": "string", "key": "string", "year": "int", "text": "string", "number": "decimal(18,2)"}
    held = held.select("*", *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
    fields = "user_id long, description_id long, kind string, entity_text string, object_text string, dimension string, key string, year int, text string, number decimal(18,2), explicit_id string"
    said = [(1, 1, "event", " ANA ", None, None, "go", None, None, None, None), (2, 2, "event", "ana", None, None, "go", None, None, None, None), (1, 3, "event", None, None, None, None, None, None, None, "6"), (2, 4, "event", None, None, None, None, None, None, None, "6"), (1, 5, None, "ana", None, None, None, None, None, None, None), (1, 6, "event", "  ", None, None, None, None, None, None, None)]
    ended = spark.createDataFrame([(1, "event", "6"), (1, "event", "6")], "user_id long, kind string, target_id string")
    found = {r.description_id: (r.reason, r.target_id, r.n) for r in targets.described_targets(spark.createDataFrame(said, fields), held, ended).collect()}
    assert found == {1: ("unique_effective_match", "5", 1), 2: ("unique_effective_match", "5", 1), 3: ("target_not_effective", None, 0), 4: ("explicit_reference_invalid", None, 0), 5: ("target_kind_missing", None, 0), 6: ("unique_effective_match", "5", 1)}


def files_read(frame):
    """How many files the scans of a plan without shuffles have opened."""
    frame.collect()
    plan, n = frame._jdf.queryExecution().executedPlan(), 0
    for leaf in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())):
        n += leaf.metrics().apply("numFiles").value() if leaf.metrics().contains("numFiles") else 0
    return n


def test_one_user_reads_that_users_files(spark, tmp_path):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).cast("long").alias("user_id"), F.col("id").alias("v"), F.when(F.col("id") >= 0, F.struct(F.lit(None).cast("string").alias("x"))).alias("s"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, None), (None, 1, None)], rows.schema))
    path = str(tmp_path / "t")
    write_by_user(rows, path, buckets=8)
    assert sorted(map(str, read_by_user(spark, path).collect())) == sorted(map(str, rows.collect()))
    write_by_user(rows.where("user_id = 7"), path, buckets=32, mode="append")
    one = read_by_user(spark, path, 7)
    assert sorted(r.v for r in one.collect()) == sorted([r.v for r in rows.where("user_id = 7").collect()] * 2)
    assert files_read(one) < files_read(read_by_user(spark, path))
    assert read_by_user(spark, path, 99).collect() == [] and one.columns == rows.columns
    with pytest.raises(ValueError):
        write_by_user(rows.withColumn("user_bucket", F.lit(1)), str(tmp_path / "u"))


def test_a_hot_user_lies_in_several_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("long").alias("user_id"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few
    try:
        write_by_user(rows, str(tmp_path / "t"), buckets=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = read_by_user(spark, str(tmp_path / "t"), 1).where("user_id = 1").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_stored_frames_answer_alike(spark, tmp_path):
    frames = KnowledgeFrames(spark, "/root/testdata/sf0.001", users=2)
    stored = store_by_user(frames, str(tmp_path / "g"), buckets=16)
    for name in FRAMES:
        assert getattr(stored, name).count() == getattr(frames, name).count()
        assert {f.name for f in getattr(stored, name).schema} == {f.name for f in getattr(frames, name).schema}
    span = {"start": dt.datetime(1996, 1, 1), "end": dt.datetime(1997, 1, 1)}
    specs = [
        QuerySpec(primitive="attribute", mode="value_lookup", dimension="brand", user_id=2),
        QuerySpec(primitive="event", event_types=["event.any"], include_descendants=True, aggregate="count", user_id=2, **span),
        QuerySpec(primitive="relation", mode="boolean", relation_key="buys_from", entity_ids=["c:2"], user_id=2),
        QuerySpec(primitive="fact", fact_concepts=["attribute.price"], aggregate="sum", user_id=1),
    ]
    for spec in specs:
        plain, laid = execute(spec, frames), execute(spec, stored)
        assert sorted(map(str, laid.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert files_read(stored.of_user(2).attribute) < files_read(stored.attribute)
    shown = execute(specs[0], stored)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("FileScan parquet") == shown.count("PartitionFilters: [isnotnull(user_bucket")


def test_questions_with_odd_fields(spark):
    base = dict.fromkeys(["concept_status", "sense", "action", "event_type", "relation", "state_dimension", "state_value", "object_text", "object_type", "attribute_dimension", "measure_dimension", "measure_number", "measure_unit", "measure_currency", "raw_input", "action_expression", "event_expression", "attribute_expression", "measure_expression", "time_text", "relative_day", "selection", "relation_to_reference"])
    fields = [*[f"{c} string" for c in base], "primitive string", "request_id long", "user_id long", "mentions array<struct<text:string,role:string>>", "has_subject boolean", "object_class boolean", "change boolean", "partial_year int", "partial_month int", "attribute_value struct<kind:string,text:string,number:decimal(38,6),unit:string,year:int>", "now timestamp", "zone string"]
    rest = {"mentions": None, "has_subject": None, "object_class": None, "change": None, "partial_year": None, "partial_month": None, "attribute_value": None, "now": dt.datetime(2024, 3, 31, 2, 0), "zone": "America/Sao_Paulo", "user_id": 1}
    several = [("peça", "role.object"), ("peça", "role.object")]
    cases = [
        ({"primitive": None}, ("insufficient", "unsupported_query_primitive", None)),
        ({"primitive": "event"}, ("insufficient", "event_query_missing_constraints", None)),
        ({"primitive": "event", "change": True, "partial_month": 13, "partial_year": 2024, "mentions": several}, ("resolved", None, "list")),
        ({"primitive": "event", "change": True, "relative_day": "yesterday"}, ("resolved", None, "aggregate")),
        ({"primitive": "measurement", "measure_dimension": "peso", "mentions": several, "measure_number": "muito", "raw_input": "já ficou muito?"}, ("insufficient", "measurement_proposition_value_unresolved", None)),
        ({"primitive": "attribute", "attribute_expression": " * ", "mentions": several}, ("resolved", None, "attribute")),
        ({"primitive": "measurement", "measure_dimension": "  ", "raw_input": "x" * 300_000}, ("insufficient", "measurement_dimension_unresolved", None)),
        ({"primitive": "event", "concept_status": "ambiguous", "sense": "other", "change": True}, ("resolved", None, "list")),
    ]
    rows = [base | rest | {"request_id": i} | given for i, (given, _) in enumerate(cases)]
    names = [f.split(" ")[0] for f in fields]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(fields))
    found = {r.request_id: r for r in questions.specified(frame).collect()}
    assert [(found[i].status, found[i].note, found[i].intent) for i in range(len(cases))] == [x for _, x in cases]
    assert found[2].association == "subject" and found[2].start is None
    assert (found[3].start, found[3].end) == (dt.datetime(2024, 3, 29, 3, 0), dt.datetime(2024, 3, 30, 3, 0))
    assert questions.specified(frame.limit(0)).collect() == []


def shuffled_bytes(spark):
    """What all stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_assertions_do_not_carry_names_that_nobody_asks_for(spark):
    """All assertions with all their names were shuffled several times over, which filled the disk on large tables."""
    before = shuffled_bytes(spark)
    rows = QUERIES["described_targets"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 13 * spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert shuffled_bytes(spark) - before < MOST_FOR_A_LINE * lines


#: Bytes of shuffle for a line of an order, whose two states, relation and part in an event can all be meant.
MOST_FOR_A_LINE = 300


def test_assertions_by_their_entities_equal_candidates_with_names(spark):
    rng = random.Random(11)
    some = lambda *xs: rng.choice(xs)
    label = [(u, f"e{i}", some("ana", "bo ana", "carl", "d-carlo", "eve", "x")) for u in (1, 2) for i in range(12)] + [(1, "e99", None)]
    name = {(u, e): n for u, e, n in label}
    state = [(some(1, 2), i, some(False, False, True), some("e0", "e1", "e2", "e99", "gone", None), some("open", "back", None), some("O", "F", None)) for i in range(40)]
    relation = [(some(1, 2), f"r{i}", some(False, False, True), some("e3", "e4", "e5", "gone"), some("e3", "e6", "e7", None), some("owns", "likes")) for i in range(40)]
    event = [(some(1, 2), i, some(False, True), some("go", "stop", None), some(1999, 2000, None)) for i in range(30)]
    members = [(some(1, 2), rng.randrange(32), f"e{rng.randrange(12)}") for _ in range(60)]
    of = lambda rows, fields: spark.createDataFrame(rows, "user_id long, " + fields)
    held = {
        "state": targets.Assertions(of(state, "id long, over boolean, entity_id string, dimension string, key string")),
        "relation": targets.Assertions(of(relation, "id string, over boolean, from_id string, to_id string, key string")),
        "event": targets.Assertions(of(event, "id long, over boolean, action string, year int"), of(members, "id long, entity_id string")),
    }
    names = lambda u, *ends: [name[u, e] for e in ends if (u, e) in name]
    candidates = [(r[0], "state", str(r[1]), names(r[0], r[3]), [], r[4], r[5], None, None) for r in state]
    candidates += [(r[0], "relation", r[1], names(r[0], r[3], r[4]), names(r[0], r[4]), None, r[5], None, None) for r in relation]
    candidates += [(r[0], "event", str(r[1]), names(r[0], *[e for u, i, e in members if (u, i) == (r[0], r[1])]), [], None, None, r[4], r[3]) for r in event]
    ended = [(r[0], kind, str(r[1])) for kind, rows in (("state", state), ("relation", relation), ("event", event)) for r in rows if r[2]]
    said = [(some(1, 2), i, some("state", "relation", "event", "event", "mood", None), some(None, "ana", "carl", "X", "eve", "zz", " "), some(*[None] * 6, "carlo", "x"), some(*[None] * 6, "open"), some(*[None] * 5, "O", "owns", "go"), some(*[None] * 5, 1999), None, None, some(*[None] * 6, "3", f"r{rng.randrange(40)}", str(rng.randrange(40)))) for i in range(250)]
    fields = "description_id long, kind string, entity_text string, object_text string, dimension string, key string, year int, text string, number decimal(18,2), explicit_id string"
    told = targets.described_assertions(of(said, fields), held, of(label, "entity_id string, name string"))
    whole = of(candidates, "kind string, id string, names array<string>, object_names array<string>, dimension string, key string, year int, action string")
    plain = targets.described_targets(of(said, fields), whole, of(ended, "kind string, target_id string"))
    found = sorted(map(str, told.collect()))
    assert found == sorted(map(str, plain.collect())) and len({r.rpartition("reason=")[2].partition(",")[0] for r in found}) == 8
