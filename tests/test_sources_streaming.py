import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veritempo.plans.spec import IsolationError, QueryError, QuerySpec, execute, explain
from veritempo.sources import migrations
from veritempo.sources.frames import KnowledgeFrames
from veritempo.streaming import ingest as streaming


def test_migrations(spark):
    frames = {"event": spark.createDataFrame([(1, "a", None), (2, None, None)], "event_id long, actor_id string, subject_id string")}
    out, passed = migrations.upgrade(frames, 6, [(6, 7, migrations.add_participants)], 7)
    assert passed == [7] and [[p.role for p in r.participants] for r in out["event"].orderBy("event_id").collect()] == [["role.participant"], []]
    for version, steps, target in ((9, [], 7), (6, [], 7), (6, [(6, 6, dict)], 7)):
        with pytest.raises(migrations.MigrationError):
            migrations.upgrade(frames, version, steps, target)
    assert migrations.schema_faults(frames["event"].withColumn("status", F.lit(1)), "event") == ["user_id", "type_key", "status: int", "temporal", "created_at"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_frames_have_their_schemas(spark):
    frames = KnowledgeFrames(spark, "/root/testdata/sf0.001", users=2)
    for name in migrations.REQUIRED:
        assert migrations.schema_faults(getattr(frames, name), name) == []
        assert migrations.schema_faults(migrations.empty_frame(spark, name), name) == []


def test_request_log_appends(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "read", "2024-01-01 10:00:00", "x"), ("r1", "answer", "2024-01-02 10:00:00", "y")], "request_id string, stage string, at string, body string").withColumn("at", F.col("at").cast("timestamp"))
    for _ in range(2):
        migrations.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).groupBy("day").count().orderBy("day").collect()[0]["count"] == 2


def test_trained_catalog(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"concepts": [{"key": "event.move", "kind": "event", "parent": "event.any", "lemmas": ["mover", "mudar"]}, {"key": "Bad Key", "kind": "event", "lemmas": ["x"]}]}))
    concepts, aliases = migrations.trained_catalog(spark, str(path))
    assert [r.key for r in concepts.collect()] == ["event.move"] and {r.alias for r in aliases.collect()} == {"mover", "mudar"}


def test_spec_errors(spark):
    frames = KnowledgeFrames(spark, "/nowhere")
    with pytest.raises(QueryError):
        execute(QuerySpec(primitive="attribute"), frames)
    for spec in (QuerySpec(primitive="dream"), QuerySpec(primitive="relation", relation_key="owns", mode="held_during"), QuerySpec(primitive="attribute", dimension="size", mode="proposition"), QuerySpec(entity_ids=["c:1"]), QuerySpec(primitive="measurement", dimension="x", mode="at_time")):
        with pytest.raises(QueryError):
            execute(spec, frames)
    assert explain(QuerySpec(statuses=["completed"])) == {"primitive": "event", "mode": "list", "statuses": ["completed"], "current_facts": True, "effective_only": True}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_nobody_asks_for_what_another_user_has(spark):
    frames = KnowledgeFrames(spark, "/root/testdata/sf0.001", users=2)
    for spec in (QuerySpec(entity_ids=["c:3"], association="actor", user_id=2), QuerySpec(event_ids=[1], user_id=2)):
        with pytest.raises(IsolationError):
            execute(spec, frames)
    assert execute(QuerySpec(entity_ids=["c:2"], association="actor", user_id=2), frames).where("event_id % 2 != 0").count() == 0


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("u", "r1", "2024-01-01 10:00:00", "click", 1.0), ("u", "r1", "2024-01-01 10:01:00", "click", 1.0), ("u", "r2", "2024-01-01 12:30:00", "view", 2.5)], "user_id string, request_id string, at string, event_type string, value double")
    rows.select("user_id", "request_id", F.col("at").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("user_id string, request_id string, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", streaming.once_only(source()), "append"), ("active", streaming.activity(source()), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r.request_id for r in spark.table("once").collect()} == {"r1", "r2"} and spark.table("once").count() == 2
    assert {(r.event_type, r.n, float(r.total)) for r in spark.table("active").collect()} == {("click", 2, 2.0), ("view", 1, 2.5)}
    q = source().writeStream.foreachBatch(streaming.upsert_current(str(tmp_path / "out"), ["user_id"], "ts")).option("checkpointLocation", str(tmp_path / "up")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.request_id for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()] == ["r2"]


def test_upserts_keep_their_state(spark, tmp_path):
    write = streaming.upsert_current(str(tmp_path / "up"), ["k"], "at")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, at long, v string")
    write(batch((1, 5, "a"), (2, 5, "b")), 0)
    write(batch((1, 4, "late"), (2, 9, "c"), (3, 1, "d"), (3, 1, "e")), 1)
    rows = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "up/v=1")).collect()}
    assert rows.pop(3) in "de" and rows == {1: "a", 2: "c"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        write(batch((1, 5, "a")), 7)


def test_conversation_focus(spark, tmp_path):
    turns = lambda *rows: spark.createDataFrame(list(rows), "conv_id long, turn long, role string")
    folder = str(tmp_path / "turns")
    turns((1, 0, "user"), (1, 1, "assistant"), (2, 0, "user")).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema("conv_id long, turn long, role string").parquet(folder)
    q = streaming.conversation_focus(source).writeStream.format("memory").queryName("focus").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).start()
    q.processAllAvailable()
    turns((1, 2, "user")).coalesce(1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert {(r.conv_id, r.turns, r.last_role) for r in spark.table("focus").collect()} == {(1, 2, "assistant"), (2, 1, "user"), (1, 3, "user")}


def test_a_batch_is_one_version(spark, tmp_path):
    from veritempo.sources.store import Store, VersionTaken

    store = Store(spark, str(tmp_path / "store"))
    events, facts = spark.createDataFrame([(1, "a")], "event_id long, kind string"), spark.createDataFrame([(10, 1)], "fact_id long, about_id long")
    assert store.commit("b1", {"event": events, "fact": facts}) == 1
    assert store.commit("b1", {"event": events, "fact": facts}) == 1  # written again: nothing changes
    assert store.read("event").count() == 1 and store.versions() == [1]
    assert store.commit("b2", {"event": events.withColumn("event_id", F.lit(2).cast("long"))}) == 2
    assert sorted(r.event_id for r in store.read("event").collect()) == [1, 2]
    assert store.read("event", version=1).count() == 1 and store.read("fact").count() == 1
    with pytest.raises(ValueError, match="schema"):
        store.commit("b3", {"event": events.withColumn("more", F.lit(1))})
    assert store.versions() == [1, 2]

    broken = events.withColumn("kind", F.raise_error(F.lit("lost half-way")).cast("string"))
    with pytest.raises(Exception, match="half-way"):
        store.commit("b4", {"fact": facts, "event": broken})
    assert store.versions() == [1, 2] and store.read("fact").count() == 1
    assert store.commit("b4", {"fact": facts, "event": events}) == 3 and store.read("fact").count() == 2

    other = Store(spark, store.path)
    late = other.manifest()
    store.commit("b5", {"fact": facts})
    with pytest.raises(VersionTaken):
        other._publish({**late, "version": late["version"] + 1})
    gone = store.vacuum()
    assert len(gone) == 1 and store.versions() == [4] and store.read("fact").count() == 3


def test_discourse_stream_equals_the_fold(spark, tmp_path):
    from veritempo.streaming import discourse

    schema = "user_id long, conv_id long, turn long, kind string, ok boolean, ids array<string>, primitive string, relation_type string, result_kind string, types map<string,string>, continues boolean, attribute boolean, dimension string, candidates array<string>"
    rng = random.Random(3)
    turns = []
    for n in range(120):
        ids = rng.sample([f"e{k}" for k in range(7)], rng.choice([0, 1, 1, 2]))
        turns.append((n % 2 + 1, n % 3, n, rng.choice(["query", "write", "write", "pending", "clarify"]), rng.random() < 0.8, ids, "attribute", None, "value", {e: f"t{e}" for e in ids}, rng.random() < 0.3, rng.random() < 0.3, "weight", rng.sample(["e1", "e2", "e9"], 2)))
    whole = spark.createDataFrame(turns, schema)
    expected = {(r.user_id, r.conv_id): r for r in discourse.folded(whole).collect()}
    state = dict(discourse.EMPTY)
    for t in [t for t in turns if t[:2] == (1, 0)]:
        state = discourse.advance(state, dict(zip([f.name for f in whole.schema], t, strict=True)))
    assert expected[1, 0].focus == state["focus"] and expected[1, 0].turns == state["turns"] and len(expected) == 6

    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(turns[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(source)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = {}

    def keep(batch, number):
        found.update({(r.user_id, r.conv_id): r for r in batch.collect()})

    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        discourse.streamed(rows).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    assert found == expected
