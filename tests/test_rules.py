from pyspark.sql import functions as F

from veritempo.functions import text as X
from veritempo.operators import events, ingest, interpret, ledger, linkage, relations


def guard(spark, text, prior=False):
    row = spark.createDataFrame([(text,)], "t string").select(interpret.correction_guard(F.col("t"), F.lit(prior)).alias("g")).first()
    return row.g.outcome, row.g.reason


def test_correction_guard(spark):
    assert guard(spark, "Corrigindo: foi em 2025") == ("accept", "supported")
    assert guard(spark, "Ele não mora mais aqui") == ("reject", "termination_cue")
    assert guard(spark, "li errado") == ("clarify", "context_required")
    assert guard(spark, "li errado", True) == ("accept", "supported")
    assert guard(spark, "Eu disse que sim?") == ("reject", "query_form")
    assert guard(spark, "Eu disse que sim? Não.") == ("reject", "query_form")
    assert guard(spark, "não foi em 2024", True) == ("reject", "signal_insufficient")
    assert guard(spark, "na verdade ela foi", True) == ("clarify", "target_ambiguous")


def test_text(spark):
    row = spark.createDataFrame([("  Olá, MUNDO—çÃo! ", "12 Fotos Do Céu", "10,50", "pesa 2,5 kg hoje", "25:00")], "a string, b string, c string, d string, e string").select(
        X.normalize(F.col("a")).alias("a"), X.normalize_exact(F.col("a")).alias("x"), X.slug(F.col("b")).alias("b"), X.decimal_of(F.col("c")).alias("c"), X.quantity_of(F.col("d")).alias("d"), X.time_of_day(F.col("e")).alias("e"), X.format_money(F.lit("1234.56").cast("decimal(18,2)"), F.lit("BRL")).alias("m"), X.json_object_of(F.lit('```json\n{"a": 1}\n```')).alias("j"),
    ).first()
    assert row.a == row.x == "ola mundo cao"
    assert row.b == "r_12_fotos_do_ceu"
    assert float(row.c) == 10.5 and float(row.d.number) == 2.5 and row.d.unit == "kg" and row.e is None
    assert row.m == "R$ 1.234,56" and row.j == '{"a": 1}'


def test_supersession_and_history(spark):
    facts = spark.createDataFrame([(1, "e", "c", None, "2024-01-01"), (2, "e", "c", 1, "2024-01-02"), (3, "e", "c", 1, "2024-01-03")], "fact_id long, about_id string, concept string, supersedes_id long, created_at string")
    assert {r.fact_id for r in ledger.current_facts(facts).collect()} == {2, 3}
    assert [r.supersedes_id for r in ledger.branched(facts).collect()] == [1]


def test_relation_life(spark):
    rows = [(1, "a", "assert"), (2, "a", "assert"), (3, "a", "terminate"), (4, "a", "assert"), (5, "a", "historical")]
    rows += [(1, "b", "historical"), (2, "b", "assert"), (3, "b", "deny"), (4, "b", "terminate"), (1, "c", "terminate"), (2, "c", "deny"), (1, "d", "assert"), (2, "d", "deny"), (3, "d", "historical"), (4, "d", "terminate"), (5, "d", "terminate")]
    df = spark.createDataFrame([(i, k, m, f"2024-01-0{i} 00:00:00") for i, k, m in rows], "command_id long, k string, mode string, at string").withColumn("at", F.col("at").cast("timestamp"))
    day = lambda x: x and x.day
    out = {(r.k, r.valid_from.day, r.observed_at.day, day(r.valid_to), r.is_current, r.closed_by) for r in ingest.relation_life(df, ["k"]).collect()}
    assert {x[1:] for x in out if x[0] == "a"} == {(1, 2, 3, False, "terminate"), (4, 4, None, True, None), (5, 5, None, False, "historical")}
    # a denied instance has no end of its own; with none open, the newest one is ended, and a triple without any has none
    assert {x[1:] for x in out if x[0] == "b"} == {(1, 1, None, False, "historical"), (2, 2, 4, False, "terminate")}
    assert {x[1:] for x in out if x[0] == "d"} == {(1, 1, None, False, "deny"), (3, 3, 5, False, "terminate")}
    assert not {x for x in out if x[0] == "c"}


def test_corrections_are_by_user(spark):
    rows = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "user_id long, fact_id long")
    ledger_rows = spark.createDataFrame([(1, "fact", 7, "retract", None), (1, "fact", 8, "retract", None)], "user_id long, kind string, target_id long, action string, replacement_id long")
    assert {tuple(r) for r in ledger.effective(rows, "fact_id", "fact", ledger_rows).select("user_id", "fact_id").collect()} == {(2, 7), (2, 8)}
    ids = spark.createDataFrame([(1, "fact", 7), (2, "fact", 8)], "user_id long, kind string, id long")
    assert {(r.target_id, r.reason) for r in ledger.correction_errors(ledger_rows, ids).collect()} == {(8, "target_missing")}


def test_closure_of_cycles_and_chains(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("a", "b"), ("b", "a"), ("r", None)]
    got = {(r.concept, r.ancestor): r.depth for r in events.closure(spark.createDataFrame(chain, "concept string, parent string")).collect()}
    assert got["a", "b"] == 1 and got["a", "a"] == 0 and got["r", "r"] == 0
    assert got["c0", f"c{events.DEEPEST}"] == events.DEEPEST and ("c0", f"c{events.DEEPEST + 1}") not in got


def test_objects_in_replies(spark):
    texts = ['{"a": {"b": 1}}', '{"a": "}{"} {"b": 2}', "none", "", '{"a": "\\"{"}', '{"a": 1']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", X.objects_in(F.col("t")).alias("n"), X.json_object_of(F.col("t")).alias("j")).collect()
    assert {r.i: r.n for r in rows} == {0: 1, 1: 2, 2: 0, 3: 0, 4: 1, 5: 1}
    assert {r.i for r in rows if r.j is not None} == {0, 4}


def test_social_openings(spark):
    cases = {"Oi": ("greeting", ""), "Bom dia, assistente! Qual a cor?": ("greeting", "qual a cor"), "ok, obrigada": ("thanks", ""), "o rato": ("none", "o rato"), "Ele me deu bom dia": ("none", "ele me deu bom dia"), "tudo certo a casa caiu ontem": ("none", "tudo certo a casa caiu ontem"), "": ("none", "")}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", interpret.social(F.col("t")).alias("s")).collect()
    assert {r.t: (r.s.intent, r.s.task) for r in rows} == cases


def test_walk_and_inverse(spark):
    edges = spark.createDataFrame([("a", "b", True, "located_in"), ("b", "c", True, "located_in"), ("c", "d", False, "located_in")], "from_id string, to_id string, is_current boolean, key string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    assert {(r.entity_id, r.depth) for r in relations.walk(seeds, edges, 3).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert relations.stored_key("contains") == ("located_in", True)
    assert {(r.subject, r.object) for r in relations.by_key(edges, "contains").collect()} == {("b", "a"), ("c", "b"), ("d", "c")}


def test_resolution(spark):
    entities = spark.createDataFrame([("e1", "t.a", "Corolla", "corola"), ("e2", "t.b", "Ana", "aninha"), ("e3", "t.a", "ana", "x")], "entity_id string, type_key string, name string, alias string")
    concepts = spark.createDataFrame([("t.a", "t"), ("t.b", "t"), ("t", None)], "concept string, parent string")
    mentions = spark.createDataFrame([(1, "corolla!", "t"), (2, "Ana", "t.b"), (3, "Ana", "t"), (4, "Zed", "t")], "mention_id long, text string, hint string")
    got = {r.mention_id: (r.status, r.entity_id) for r in linkage.resolve_named(mentions, entities, concepts).collect()}
    assert got == {1: ("resolved", "e1"), 2: ("resolved", "e2"), 3: ("ambiguous", None), 4: ("unresolved", None)}
