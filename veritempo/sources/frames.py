"""Assertion frames over the star-schema tables.

Each frame is one lazily read projection, so filters and column choice reach the Parquet scan. Entities have prefixed
ids (c:, s:, p:, n:, r:); orders are coarse events and their prices money facts; the event log gives instants and
measurements; parts have attributes, shipped lines states, and keys between tables relations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

from veritempo.functions import temporal as T

MONEY = "decimal(18,2)"


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


@dataclass
class KnowledgeFrames:
    """All assertions of all users as DataFrames, each with user_id.

    The star schema knows one owner of its rows, user 1. With `users` = 2 a second one has the rows with even keys too,
    under the same ids, without the facts that supersede others and with corrections of its own: two users whose ids
    collide, as tests of isolation need them. Measurements belong to the users of the event log.
    """

    spark: SparkSession
    path: str
    users: int = 1

    def table(self, name: str) -> DataFrame:
        """A table; stamps without a zone are read as moments in UTC, by the scan itself, so that filters reach it."""
        path = f"{self.path}/{name}.parquet"
        rows = self.spark.read.parquet(path)
        fields = [StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType, f.nullable) for f in rows.schema]
        return rows if fields == rows.schema.fields else self.spark.read.schema(StructType(fields)).parquet(path)

    def of_user(self, user_id: int) -> KnowledgeFrames:
        """Frames to ask about one user; those that are laid out by user read that user's files only."""
        return self

    def owned(self, name: str, key: str) -> DataFrame:
        """A table with the users that have its rows."""
        one = F.lit(1).cast("long")
        if self.users == 1:
            return self.table(name).withColumn("user_id", one)
        both = F.array(one, F.lit(2).cast("long"))
        return self.table(name).withColumn("user_id", F.explode(F.when(F.col(key) % 2 == 0, both).otherwise(F.array(one))))

    @cached_property
    def entity(self) -> DataFrame:
        """user_id, entity_id, type_key, name, alias."""
        parts = [("customer", "c", "c_custkey", "c_name", "entity.customer"), ("supplier", "s", "s_suppkey", "s_name", "entity.supplier"), ("nation", "n", "n_nationkey", "n_name", "entity.nation"), ("region", "r", "r_regionkey", "r_name", "entity.region")]
        rows = [self.owned(t, k).select("user_id", _id(p, k).alias("entity_id"), F.lit(kind).alias("type_key"), F.col(n).alias("name")) for t, p, k, n, kind in parts]
        part = self.owned("part", "p_partkey").select("user_id", _id("p", "p_partkey").alias("entity_id"), F.concat(F.lit("entity.part."), F.lower("p_type")).alias("type_key"), F.col("p_name").alias("name"))
        out = part
        for r in rows:
            out = out.unionByName(r)
        return out.withColumn("alias", F.upper(F.replace("name", F.lit("#"), F.lit(""))))

    @cached_property
    def concept(self) -> DataFrame:
        """concept, parent: the type hierarchy; roots have a null parent. Metadata, cached as every level of a walk reads it."""
        fixed = [("entity.party", None), ("entity.customer", "entity.party"), ("entity.supplier", "entity.party"), ("entity.place", None), ("entity.nation", "entity.place"), ("entity.region", "entity.place"), ("entity.product", None), ("event.any", None), ("event.order", "event.any")]
        rows = self.spark.createDataFrame(fixed, "concept string, parent string")
        types = self.table("part").select(F.concat(F.lit("entity.part."), F.lower("p_type")).alias("concept"), F.lit("entity.product").alias("parent")).distinct()
        priorities = self.table("orders").select(F.concat(F.lit("event.order."), F.lower("o_orderpriority")).alias("concept"), F.lit("event.order").alias("parent")).distinct()
        kinds = self.table("events").select(F.concat(F.lit("event."), F.col("event_type")).alias("concept"), F.lit("event.any").alias("parent")).distinct()
        return rows.unionByName(types).unionByName(priorities).unionByName(kinds).coalesce(1).cache()

    @cached_property
    def event(self) -> DataFrame:
        """Orders as coarse events: event_id, type_key, action, status, domain, actor_id, temporal, created_at."""
        day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
        time = (
            F.when(key % 10 == 0, T.in_month(F.year(day), F.month(day)))
            .when(key % 10 == 1, T.in_year(F.year(day)))
            .when(key % 10 == 2, T.unknown_time(F.lit("some day")))
            .otherwise(T.on_day(day))
        )
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("pending")
        return self.owned("orders", "o_orderkey").select(
            "user_id",
            key.alias("event_id"),
            F.concat(F.lit("event.order."), F.lower("o_orderpriority")).alias("type_key"),
            F.when(key % 5 != 0, F.concat(F.lit("action."), F.lower("o_orderstatus"))).alias("action"),
            status.alias("status"),
            F.array(F.concat(F.lit("domain."), (key % 3).cast("string")), F.concat(F.lit("domain."), (key % 4).cast("string"))).alias("domains"),
            _id("c", "o_custkey").alias("actor_id"),
            time.alias("temporal"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def participant(self) -> DataFrame:
        """event_id, entity_id, role: the customer acts, parts are objects, suppliers are the context."""
        lines = self.owned("lineitem", "l_orderkey")
        actor = self.owned("orders", "o_orderkey").select("user_id", F.col("o_orderkey").alias("event_id"), _id("c", "o_custkey").alias("entity_id"), F.lit("role.actor").alias("role"))
        objects = lines.select("user_id", F.col("l_orderkey").alias("event_id"), _id("p", "l_partkey").alias("entity_id"), F.lit("role.object").alias("role"))
        context = lines.select("user_id", F.col("l_orderkey").alias("event_id"), _id("s", "l_suppkey").alias("entity_id"), F.lit("role.context").alias("role"))
        return actor.unionByName(objects).unionByName(context)

    @cached_property
    def fact(self) -> DataFrame:
        """fact_id, about_id, concept, amount, currency, supersedes_id, source_id, created_at: prices, some replaced."""
        key = F.col("o_orderkey")
        price = F.col("o_totalprice").cast(MONEY)
        currency = F.when(key % 7 == 0, "USD").otherwise("BRL").alias("currency")
        orders = self.owned("orders", "o_orderkey")
        first = orders.select("user_id", (key * 2).alias("fact_id"), key.alias("about_id"), F.lit("attribute.price").alias("concept"), price.alias("amount"), currency, F.lit(None).cast("long").alias("supersedes_id"), (key % 100).alias("source_id"), F.col("o_orderdate").alias("created_at"))
        later = orders.where(key % 11 == 0).where("user_id = 1").select("user_id", (key * 2 + 1).alias("fact_id"), key.alias("about_id"), F.lit("attribute.price").alias("concept"), (price * F.lit("1.1").cast("decimal(2,1)")).cast(MONEY).alias("amount"), currency, (key * 2).alias("supersedes_id"), (key % 100).alias("source_id"), F.date_add(F.to_date("o_orderdate"), 1).cast("timestamp").alias("created_at"))
        return first.unionByName(later)

    @cached_property
    def measurement(self) -> DataFrame:
        """measurement_id, user_id, dimension, value, unit, observed_at (null for every thirteenth)."""
        key = F.col("event_id")
        return self.table("events").select(
            key.alias("measurement_id"),
            "user_id",
            F.col("event_type").alias("dimension"),
            F.col("value").cast(MONEY).alias("value"),
            F.when(key % 3 == 1, "kg").when(key % 3 == 2, "g").alias("unit"),
            F.when(key % 13 != 0, F.col("ts")).alias("observed_at"),
        )

    @cached_property
    def attribute(self) -> DataFrame:
        """attribute_id, entity_id, dimension, value_kind, text_value, numeric_value, unit, is_current, temporal."""
        part = self.owned("part", "p_partkey")
        key = F.col("p_partkey")
        day = F.date_add(F.lit("2000-01-01").cast("date"), (key % 700).cast("int"))

        def rows(n: int, dimension: str, text: Column | None, number: Column | None, unit: str | None, current: Column, time: Column, where: Column | None = None) -> DataFrame:
            frame = part if where is None else part.where(where)
            return frame.select(
                "user_id", (key * 10 + n).alias("attribute_id"), _id("p", "p_partkey").alias("entity_id"), F.lit(dimension).alias("dimension"), F.lit("text" if text is not None else "number").alias("value_kind"),
                (text if text is not None else F.lit(None).cast("string")).alias("text_value"), (number if number is not None else F.lit(None)).cast(MONEY).alias("numeric_value"), F.lit(unit).cast("string").alias("unit"), current.alias("is_current"), time.alias("temporal"),
            )

        undated = T.unknown_time(F.lit("once"))
        frames = [
            rows(0, "brand", F.col("p_brand"), None, None, key % 5 != 0, T.on_day(day)),
            rows(1, "type", F.col("p_type"), None, None, F.lit(True), T.in_year(F.year(day))),
            rows(2, "size", None, F.col("p_size"), "cm", key % 6 != 0, F.when(key % 4 == 0, undated).otherwise(T.on_day(day))),
            rows(3, "price", None, F.col("p_retailprice"), None, F.lit(True), T.on_day(day)),
            rows(4, "brand", F.concat(F.col("p_brand"), F.lit("-II")), None, None, F.lit(True), T.on_day(F.date_add(day, 30)), key % 9 == 0),
            rows(5, "size", None, F.col("p_size"), "cm", F.lit(True), T.on_day(F.date_add(day, 60)), key % 8 == 0),
        ]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    @cached_property
    def state(self) -> DataFrame:
        """state_id, entity_id, dimension, value, is_current, temporal, observed_at: how lines of a part stand."""
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        lines = self.owned("lineitem", "l_orderkey")
        day = F.to_date("l_shipdate")
        time = F.when(key % 17 == 0, T.unknown_time(F.lit("lately"))).when(key % 19 == 0, T.in_month(F.year(day), F.month(day))).otherwise(T.on_day(day))
        common = [F.col("user_id"), _id("p", "l_partkey").alias("entity_id"), (key % 3 != 0).alias("is_current"), time.alias("temporal"), F.col("l_shipdate").alias("observed_at")]
        openness = lines.select((key * 2).alias("state_id"), F.lit("openness").alias("dimension"), F.col("l_linestatus").alias("value"), *common)
        returned = lines.select((key * 2 + 1).alias("state_id"), F.lit("return").alias("dimension"), F.col("l_returnflag").alias("value"), *common)
        return openness.unionByName(returned)

    @cached_property
    def relation(self) -> DataFrame:
        """relation_id, from_id, to_id, key, is_current, temporal, valid_from, valid_to, termination_known, terminated.

        One row per customer and supplier that trade, per customer's nation, per nation's region, and per pair of
        neighbouring customers of one nation and segment (peer_of, which has no direction).
        """
        empty = {"valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")}

        def finish(df: DataFrame, key: str, current: Column, time: Column, more: dict[str, Column] = empty) -> DataFrame:
            ended = ~current
            return df.select("user_id", F.concat_ws("|", F.lit(key), "from_id", "to_id").alias("relation_id"), "from_id", "to_id", F.lit(key).alias("key"), current.alias("is_current"), time.alias("temporal"), more["valid_from"].alias("valid_from"), more["valid_to"].alias("valid_to"), ended.alias("termination_known"), F.when(ended, more["valid_to"]).alias("terminated"))

        customer, nation = self.owned("customer", "c_custkey"), self.owned("nation", "n_nationkey")
        lives = finish(customer.select("user_id", _id("c", "c_custkey").alias("from_id"), _id("n", "c_nationkey").alias("to_id"), "c_custkey"), "resides_at", F.col("c_custkey") % 7 != 0, F.when(F.col("c_custkey") % 4 == 0, T.unknown_time(F.lit("always"))).otherwise(T.on_day(F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")))))
        located = finish(nation.select("user_id", _id("n", "n_nationkey").alias("from_id"), _id("r", "n_regionkey").alias("to_id")), "located_in", F.lit(True), T.unknown_time(F.lit("always")))
        trade = self.owned("orders", "o_orderkey").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("user_id", _id("c", "o_custkey").alias("from_id"), _id("s", "l_suppkey").alias("to_id")).agg(F.min("o_orderdate").alias("since"), F.max("l_shipdate").alias("until"), F.count("*").alias("n"))
        buys = finish(trade, "buys_from", F.col("n") % 2 == 0, T.on_day(F.to_date("since")), {"valid_from": F.col("since"), "valid_to": F.when(F.col("n") % 2 != 0, F.col("until"))})
        near = Window.partitionBy("user_id", "c_nationkey", "c_mktsegment").orderBy("c_custkey")
        peers = customer.withColumn("next", F.lead("c_custkey").over(near)).where("next is not null")
        peer = finish(peers.select("user_id", _id("c", "c_custkey").alias("from_id"), _id("c", "next").alias("to_id"), "c_custkey"), "peer_of", F.col("c_custkey") % 3 != 0, T.on_day(F.lit("1995-01-01").cast("date")))
        return lives.unionByName(located).unionByName(buys).unionByName(peer)

    @cached_property
    def correction(self) -> DataFrame:
        """user_id, kind, target_id, action, replacement_id: every seventeenth assertion retracted, every nineteenth other replaced.

        The second user only retracts every thirteenth fact.
        """
        ids = self.fact.select("user_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("target_id")).unionByName(self.measurement.select("user_id", F.lit("measurement").alias("kind"), F.col("measurement_id").alias("target_id")))
        second = (F.col("kind") == "fact") & (F.col("user_id") == 2)
        action = F.when(second, F.when(F.col("target_id") % 13 == 0, "retract")).when(F.col("target_id") % 17 == 0, "retract").when(F.col("target_id") % 19 == 0, "replace")
        rows = ids.withColumn("action", action).where("action is not null")
        return rows.withColumn("replacement_id", F.when(F.col("action") == "replace", F.col("target_id") + 1))
