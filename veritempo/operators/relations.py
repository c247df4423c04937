"""Relations: direction, current answers, existence in the past, termination, validity, and graph walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.functions import vocabulary as V
from veritempo.operators.events import closure
from veritempo.operators.scope import by_user

#: Keys whose endpoints may be swapped, and keys that are stored under their inverse.
SYMMETRIC = ("peer_of",)
INVERSE = V.INVERSE_RELATIONS | {"home_of": "resides_at", "contains": "located_in", "sells_to": "buys_from"}


def stored_key(key: str) -> tuple[str, bool]:
    """The key under which a relation is stored, and whether its endpoints are swapped."""
    return (INVERSE[key], True) if key in INVERSE else (key, False)


def oriented(relations: DataFrame) -> DataFrame:
    """Every relation as subject and object; those without direction appear both ways."""
    rows = relations.withColumns({"subject": F.col("from_id"), "object": F.col("to_id")})
    back = relations.where(F.col("key").isin(*SYMMETRIC) & (F.col("from_id") != F.col("to_id"))).withColumns({"subject": F.col("to_id"), "object": F.col("from_id")})
    return rows.unionByName(back)


def by_key(relations: DataFrame, key: str) -> DataFrame:
    """subject, object and the rest for a key, which may be an inverse one."""
    stored, swapped = stored_key(key)
    rows = oriented(relations.where(F.col("key") == stored))
    return rows.withColumns({"subject": F.col("object"), "object": F.col("subject")}) if swapped else rows


def canonical_ends(relations: DataFrame) -> DataFrame:
    """Endpoints in a fixed order where direction doesn't matter."""
    free = F.col("key").isin(*SYMMETRIC)
    return relations.withColumns({"from_id": F.when(free, F.least("from_id", "to_id")).otherwise(F.col("from_id")), "to_id": F.when(free, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))})


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the top dated relation and all undated ones, with completeness.

    Other dated relations are left out, as the reference does.
    """
    key = T.sort_key(F.col("temporal"))
    rows = rows.withColumn("key_", key).withColumn("dated", F.col("key_.rank") < 2)
    order = Window.partitionBy(*keys, "dated").orderBy(F.desc("key_"), F.desc("relation_id"))
    counts = rows.groupBy(*keys).agg(F.count_if("dated").alias("n_dated"), F.count_if(~F.col("dated")).alias("n_undated"), F.max(F.when(F.col("dated"), F.col("key_"))).alias("top"))
    tied = rows.where("dated").groupBy(*keys, "key_").agg(F.count("*").alias("n_same"))
    out = rows.withColumn("position", F.row_number().over(order)).where("not dated or position = 1").join(counts, keys).join(tied, [*keys, "key_"], "left")
    completeness = (
        F.when((F.col("n_dated") == 0) & (F.col("n_undated") == 1), T.PARTIAL)
        .when(F.col("n_dated") == 0, T.INDETERMINATE)
        .when(~F.col("dated"), T.PARTIAL)
        .when((F.col("n_undated") == 0) & (F.col("n_same") > 1), T.INDETERMINATE)
        .otherwise(T.COMPLETE)
    )
    return out.withColumn("completeness", completeness)


def current_answer(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """yes, no or unknown for each asked key: no without a current relation, unknown with more than one surviving."""
    live = rows.where("is_current")
    undated = T.sort_key(F.col("temporal"))["rank"] >= 2
    found = live.groupBy(*keys).agg(F.least(F.count_if(~undated), F.lit(1)).alias("dated"), F.count_if(undated).alias("undated"))
    out = asked.join(found, keys, "left").withColumn("n", F.coalesce(F.col("dated") + F.col("undated"), F.lit(0)))
    return out.select(*keys, F.when(F.col("n") == 0, "no").when(F.col("n") == 1, "yes").otherwise("unknown").alias("answer"), "n")


def historical_existence(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """yes where any relation, current or ended, exists; else no."""
    some = rows.select(*keys).distinct().withColumn("some", F.lit(True))
    return asked.join(some, keys, "left").select(*keys, F.when(F.col("some"), "yes").otherwise("no").alias("answer"))


def termination(rows: DataFrame, keys: list[str], asked: DataFrame | None = None) -> DataFrame:
    """Per keys, those of the rows or the asked ones: of the first ended relation by id, the answer about its end and the end."""
    ended = rows.where(F.col("termination_known") | ~F.col("is_current"))
    found = ended.groupBy(*keys).agg(F.min(F.struct("relation_id", "terminated", "termination_known")).alias("e"))
    every = (rows if asked is None else asked).select(*keys).distinct().join(found, keys, "left")
    answer = F.when(F.col("e").isNull(), "no").when(F.col("e.terminated").isNotNull(), "yes").otherwise("unknown")
    return every.select(*keys, answer.alias("answer"), F.col("e.terminated").alias("terminated"))


def held_during(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Per keys: whether the first relation by id held through the range; a current one is open at its end.

    Each relation is answered first, so that finding the first of a key sorts ids and answers and no times.
    """
    since = F.coalesce(F.col("valid_from"), T.relation_endpoint(F.col("temporal")))
    until = F.when(~F.col("is_current"), F.coalesce("valid_to", "terminated"))
    m = T.validity_membership(F.col("since"), F.col("until"), start, end, F.col("is_current") & F.col("until").isNull())
    bounds = rows.select(*keys, "relation_id", "is_current", since.alias("since"), until.alias("until"))
    answers = bounds.select(*keys, "relation_id", F.when(m == T.MATCH, "yes").when(m == T.NO_MATCH, "no").otherwise("unknown").alias("answer"))
    return answers.groupBy(*keys).agg(F.min(F.struct("relation_id", "answer")).alias("first")).select(*keys, "first.answer")


def of_object_type(rows: DataFrame, entities: DataFrame, types: list[str]) -> DataFrame:
    """Relations whose object has exactly one of the types."""
    user = by_user(rows, entities)
    fit = entities.where(F.col("type_key").isin(types)).select(*user, F.col("entity_id").alias("to_id"))
    return rows.join(fit, [*user, "to_id"], "left_semi")


def labelled(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the name of their object."""
    user = by_user(rows, entities)
    return rows.join(entities.select(*user, F.col("entity_id").alias("to_id"), F.col("name").alias("object_name")), [*user, "to_id"], "left")


def owned(rows: DataFrame, entities: DataFrame, concepts: DataFrame, owner_key: str, root: str) -> DataFrame:
    """owner and entity_id: current objects of a relation whose type lies under a root."""
    below = closure(concepts).where(F.col("ancestor") == root).select(F.col("concept").alias("type_key"))
    user = by_user(rows, entities)
    things = entities.join(below, "type_key", "left_semi").select(*user, F.col("entity_id").alias("to_id"))
    live = rows.where("is_current").where(F.col("key") == owner_key)
    return live.join(things, [*user, "to_id"], "left_semi").select(*user, F.col("from_id").alias("owner"), F.col("to_id").alias("entity_id")).distinct()


def walk(seeds: DataFrame, relations: DataFrame, hops: int = 2, current_only: bool = True, most: int | None = 200) -> DataFrame:
    """seed, entity_id and depth of all entities at most `hops` relations away, in either direction.

    seeds: seed (an entity id). At most `most` per seed, nearest and least ids first, with `truncated` beside; None: all.
    """
    rows = relations.where("is_current") if current_only else relations
    user = by_user(seeds, relations)
    edges = rows.select(*user, F.col("from_id").alias("entity_id"), F.col("to_id").alias("b"))
    edges = edges.unionByName(edges.select(*user, F.col("b").alias("entity_id"), F.col("entity_id").alias("b"))).distinct()
    found = frontier = seeds.select(*user, "seed", F.col("seed").alias("entity_id"), F.lit(0).alias("depth"))
    for depth in range(1, hops + 1):
        near = frontier.join(edges, [*user, "entity_id"]).select(*user, "seed", F.col("b").alias("entity_id")).distinct()
        frontier = near.join(found.select(*user, "seed", "entity_id"), [*user, "seed", "entity_id"], "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(frontier)
    if most is None:
        return found
    order = Window.partitionBy(*user, "seed").orderBy("depth", "entity_id")
    sizes = found.groupBy(*user, "seed").agg((F.count("*") > most).alias("truncated"))
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).drop("position").join(sizes, [*user, "seed"])


def entity_detail(entities: DataFrame, relations: DataFrame, attributes: DataFrame, states: DataFrame, participants: DataFrame) -> DataFrame:
    """Per entity how many current relations go out and come in, current attributes and states, and events it has."""
    user = by_user(entities, relations, attributes, states, participants)
    out = relations.where("is_current").groupBy(*user, F.col("from_id").alias("entity_id")).agg(F.count("*").alias("n_out"))
    into = relations.where("is_current").groupBy(*user, F.col("to_id").alias("entity_id")).agg(F.count("*").alias("n_in"))
    parts = [out, into]
    parts += [df.where("is_current").groupBy(*user, "entity_id").agg(F.count("*").alias(n)) for df, n in ((attributes, "n_attributes"), (states, "n_states"))]
    parts.append(participants.groupBy(*user, "entity_id").agg(F.count_distinct("event_id").alias("n_events")))
    rows = entities.select(*user, "entity_id", "type_key", "name")
    for p in parts:
        rows = rows.join(p, [*user, "entity_id"], "left")
    return rows.na.fill(0)


def entity_card(entities: DataFrame, relations: DataFrame, attributes: DataFrame, states: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted entities (column entity_id) what `entity_detail` counts: entity_id, name, list, item and n, a row for each different item.

    The lists are current relations out and in, attributes and states. They stay rows: a place may have very many. Equal
    items are counted before they meet names. Names grow with the tables however well they compress: no broadcast.
    """
    user = by_user(entities, relations, attributes, states)
    key = [*user, "entity_id"]
    live = [df.where("is_current") for df in (relations, relations, attributes, states)]
    out = live[0].select(*user, F.col("from_id").alias("entity_id"), F.lit("relations_out").alias("list"), F.concat_ws(" ", "key", "to_id").alias("item"))
    into = live[1].select(*user, F.col("to_id").alias("entity_id"), F.lit("relations_in").alias("list"), F.concat_ws(" ", "key", "from_id").alias("item"))
    held = live[2].select(*key, F.lit("attributes").alias("list"), F.concat_ws(" ", "dimension", F.coalesce("text_value", F.col("numeric_value").cast("string")), "unit").alias("item"))
    stands = live[3].select(*key, F.lit("states").alias("list"), F.concat_ws(" ", "dimension", "value").alias("item"))
    counted = out.unionByName(into).unionByName(held).unionByName(stands).groupBy(*key, "list", "item").agg(F.count("*").alias("n_items"))
    named = entities.join(wanted, [*by_user(entities, wanted, shared=True), "entity_id"], "left_semi").groupBy(*key, "name").agg(F.count("*").alias("n_rows"))
    return counted.join(named.hint("merge"), key).select(*key, "name", "list", "item", (F.col("n_items") * F.col("n_rows")).alias("n"))


def of_entity(relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """entity_id and the relations, current or not, that it has at either end, numbered by observation."""
    user, asked = by_user(relations), by_user(relations, wanted, shared=True)
    ends = [relations.withColumn("entity_id", F.col(end)) for end in ("from_id", "to_id")]
    rows = ends[0].unionByName(ends[1].where("from_id != to_id")).join(wanted, [*asked, "entity_id"], "left_semi")
    order = Window.partitionBy(*user, "entity_id").orderBy(F.coalesce(T.sort_instant(F.col("temporal")), F.lit("1900-01-01").cast("timestamp")), "relation_id")
    return rows.withColumn("position", F.row_number().over(order))
