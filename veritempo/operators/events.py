"""Event predicates, association with entities, facts of events, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.operators import ledger
from veritempo.operators.scope import by_user
from veritempo.storage import checkpoint


def matching(events: DataFrame, types: list[str] | None = None, actions: list[str] | None = None, statuses: list[str] | None = None, domains: list[str] | None = None, ids: list | None = None) -> DataFrame:
    """Events that fit all given conditions; without an action none fits."""
    if ids:
        events = events.where(F.col("event_id").isin(ids))
    if types:
        events = events.where(F.col("type_key").isin(types))
    if actions:
        events = events.where(F.col("action").isin(actions))
    if statuses:
        events = events.where(F.col("status").isin(statuses))
    if domains:
        events = events.where(F.arrays_overlap("domains", F.array(*map(F.lit, domains))))
    return events


def of_type(events: DataFrame, concepts: DataFrame, root: str, descendants: bool = True) -> DataFrame:
    """Events of a type or, unless exact, of the types below it."""
    if not descendants:
        return events.where(F.col("type_key") == root)
    below = closure(concepts).where(F.col("ancestor") == root).select(F.col("concept").alias("type_key"))
    return events.join(below, "type_key", "left_semi")


#: Levels that a walk upwards takes, as in the reference; a concept that is deeper has no ancestor beyond them.
DEEPEST = 32


def closure(concepts: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """concept, ancestor and least depth, itself at depth 0, by doubling.

    Each round joins the ancestors that are as far away as the table reaches with the table itself, so a hierarchy of 32
    levels takes five rounds and a flat one two. Rounds are cut by checkpoints and have no limit of rows; a round that
    finds nothing new is the last. A cycle ends with the shortest way round it. A parent that is no concept is an ancestor.
    """
    step = concepts.select("concept", "parent").where("concept is not null").distinct()
    own = step.select("concept", F.col("concept").alias("ancestor"), F.lit(0).alias("depth")).distinct()
    up = step.where("parent is not null and parent != concept").select("concept", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    table, reach = checkpoint(own.unionByName(up)), 1
    while reach < deepest:
        far = table.where(F.col("depth") == reach).select("concept", F.col("ancestor").alias("via"), F.col("depth").alias("below"))
        more = table.where("depth > 0").select(F.col("concept").alias("via"), "ancestor", F.col("depth").alias("above"))
        found = far.join(more, "via").select("concept", "ancestor", (F.col("below") + F.col("above")).alias("depth")).where(F.col("depth") <= deepest)
        fresh = checkpoint(found.groupBy("concept", "ancestor").agg(F.min("depth").alias("depth")).join(table, ["concept", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        table, reach = checkpoint(table.unionByName(fresh)), 2 * reach
    return table


def by_subject(events: DataFrame, participants: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events with a wanted entity (column entity_id) as object, patient or subject."""
    hit = participants.where(F.col("role").isin("role.object", "role.patient", "role.subject")).join(wanted, [*by_user(participants, wanted, shared=True), "entity_id"], "left_semi")
    return _having(events, hit)


def by_object(events: DataFrame, participants: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events with a wanted entity as object."""
    hit = participants.where("role = 'role.object'").join(wanted, [*by_user(participants, wanted, shared=True), "entity_id"], "left_semi")
    return _having(events, hit)


def by_actor(events: DataFrame, participants: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events with a wanted actor; the event's own actor counts where it has no participant in that role."""
    acting = participants.where("role = 'role.actor'")
    user = by_user(events, participants)
    hit = acting.join(wanted, [*by_user(acting, wanted, shared=True), "entity_id"], "left_semi").select(*user, "event_id")
    own = wanted.withColumnRenamed("entity_id", "actor_id")
    bare = events.join(acting.select(*user, "event_id"), [*user, "event_id"], "left_anti").join(own, [*by_user(events, own, shared=True), "actor_id"], "left_semi")
    return _having(events, hit.unionByName(bare.select(*user, "event_id")))


def in_context_of_all(events: DataFrame, participants: DataFrame, wanted: list[str]) -> DataFrame:
    """Events in which every wanted entity takes part."""
    hit = participants.where(F.col("entity_id").isin(wanted)).groupBy(*by_user(events, participants), "event_id").agg(F.count_distinct("entity_id").alias("n")).where(F.col("n") == len(set(wanted)))
    return _having(events, hit)


def by_neighbour(events: DataFrame, participants: DataFrame, relations: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events with a wanted entity or one that any relation, current or corrected or not, ties to it."""
    user, asked = by_user(participants, relations), by_user(relations, wanted, shared=True)
    ends = [("from_id", "to_id"), ("to_id", "from_id")]
    out, back = (relations.join(wanted.withColumnRenamed("entity_id", one), [*asked, one], "left_semi").select(*user, F.col(other).alias("entity_id")) for one, other in ends)
    own = participants.join(wanted, [*asked, "entity_id"], "left_semi")
    near = participants.join(out.unionByName(back), [*user, "entity_id"], "left_semi")
    return _having(events, own.unionByName(near))


def _having(events: DataFrame, hit: DataFrame) -> DataFrame:
    """Events that some row of hit names, by user where both have one."""
    user = by_user(events, hit)
    return events.join(hit.select(*user, "event_id"), [*user, "event_id"], "left_semi")


def with_membership(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events with membership in the range; those outside stay, as no_match."""
    return events.withColumn("membership", T.occurrence_membership(F.col("temporal"), start, end))


def with_facts(events: DataFrame, facts: DataFrame, concepts: list[str]) -> DataFrame:
    """Events joined with their facts of the given concepts."""
    about = facts.where(F.col("concept").isin(concepts)).withColumnRenamed("about_id", "event_id").drop("created_at")
    return events.join(about, [*by_user(events, facts), "event_id"])


def money_sum(events: DataFrame, facts: DataFrame, concepts: list[str], keys: list[str], currency: str | None = None) -> DataFrame:
    """Per keys: total, currency, n_facts, completeness, n_unknown_events and an error for mixed currencies.

    events: with membership. facts: all versions, marked with is_current or not yet; current ones are summed for events inside the range, and any version
    makes an event that may be inside count against completeness. A currency picks facts before mixtures are looked for;
    no fact gives the sum 0. Facts are added up for each event, events for each key, and each table is read once.
    """
    current = F.col("is_current") if currency is None else F.col("is_current") & (F.col("currency") == currency)
    user = by_user(events, facts)
    marked = facts if "is_current" in facts.columns else ledger.with_currency(facts)
    per_event = marked.where(F.col("concept").isin(concepts)).groupBy(*user, F.col("about_id").alias("event_id")).agg(
        F.sum(F.when(current, F.col("amount"))).alias("amount"),
        F.count_if(current).alias("n"),
        F.min(F.when(current, F.col("currency"))).alias("low"),
        F.max(F.when(current, F.col("currency"))).alias("high"),
    )
    rows = events.where(F.col("membership") != T.NO_MATCH).join(per_event, [*user, "event_id"], "left")
    inside, open_ = F.col("membership") == T.MATCH, F.col("membership") == T.UNKNOWN
    found = rows.groupBy(*keys).agg(
        F.sum(F.when(inside, F.col("amount"))).alias("total"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("n_facts"),
        F.min(F.when(inside, F.col("low"))).alias("low"),
        F.max(F.when(inside, F.col("high"))).alias("high"),
        F.count_if(open_ & F.col("n").isNotNull()).alias("n_doubtful"),
        F.count_if(open_).alias("n_unknown_events"),
    )
    mixed = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    return found.where("n_facts > 0 or n_unknown_events > 0").select(
        *keys,
        F.when(~mixed, F.coalesce(F.col("total"), F.lit(0)).cast("decimal(28,2)")).alias("total"),
        F.when(~mixed, F.coalesce(F.col("low"), F.lit(currency))).alias("currency"),
        "n_facts",
        F.when(F.col("n_doubtful") > 0, T.PARTIAL).otherwise(T.COMPLETE).alias("completeness"),
        "n_unknown_events",
        F.when(mixed, "multi_currency").alias("error"),
    )


def counts(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: events inside the range, events that may be, and completeness. Needs membership."""
    rows = events.groupBy(*keys).agg(F.count_if(F.col("membership") == T.MATCH).alias("n"), F.count_if(F.col("membership") == T.UNKNOWN).alias("n_unknown"))
    return rows.withColumn("completeness", F.when(F.col("n_unknown") > 0, T.PARTIAL).otherwise(T.COMPLETE))


def latest(events: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the latest event with a known instant (else the least event_id) and its first fact.

    events: those inside the range or possibly inside, with membership. The reference takes scan order where nothing
    orders rows; here the least id does.
    """
    key = F.struct(T.sort_instant(F.col("temporal")).alias("at"), F.col("event_id"))
    chosen = events.groupBy(*keys).agg(
        F.max(F.when(key["at"].isNotNull(), key)).alias("known"),
        F.min("event_id").alias("least"),
        F.count_if(key["at"].isNull() | (F.col("membership") == T.UNKNOWN)).alias("n_open"),
        F.count_if(F.col("membership") == T.UNKNOWN).alias("n_unknown_events"),
    )
    chosen = chosen.withColumn("event_id", F.coalesce(F.col("known.event_id"), F.col("least")))
    user = by_user(chosen, facts)
    first = facts.groupBy(*user, F.col("about_id").alias("event_id")).agg(F.min(F.struct("fact_id", "amount", "currency")).alias("f"))
    rows = chosen.join(first, [*user, "event_id"], "left")
    return rows.select(*keys, "event_id", F.col("known.at").alias("at"), F.col("f.amount").alias("amount"), F.col("f.currency").alias("currency"), F.when(F.col("n_open") > 0, T.PARTIAL).otherwise(T.COMPLETE).alias("completeness"), "n_unknown_events")


def event_items(events: DataFrame, participants: DataFrame) -> DataFrame:
    """event_id, event_time (ISO, null if unknown), entity_ids in order, created_at."""
    user = by_user(events, participants)
    ids = participants.groupBy(*user, "event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    time = F.date_format(T.sort_instant(F.col("temporal")), "yyyy-MM-dd'T'HH:mm:ss")
    return events.join(ids, [*user, "event_id"], "left").select(*user, "event_id", time.alias("event_time"), "entity_ids", "created_at")


#: Items that one list shows at most, as in the reference; matched_count tells how many there are.
MOST_ITEMS = 200


def sorted_items(items: DataFrame, by: str = "event_time", descending: bool = False, limit: int | None = None, id_column: str = "event_id") -> DataFrame:
    """Items in order, at most 200; a missing time counts as the earliest; ids break ties in the same direction."""
    stamp, key = F.coalesce(F.col(by).cast("string"), F.lit("")), F.col(id_column)
    order = [stamp.desc(), key.desc()] if descending else [stamp.asc(), key.asc()]
    return items.orderBy(*order).limit(max(0, min(MOST_ITEMS, MOST_ITEMS if limit is None else limit)))


def top_items(items: DataFrame, keys: list[str], n: int, by: str = "event_time", id_column: str = "event_id", descending: bool = True) -> DataFrame:
    """The n latest (or earliest) items per keys, numbered.

    Spark limits each task's groups to n rows before it shuffles and again after (WindowGroupLimit), so a key's rows
    never meet in one task.
    """
    stamp, key = F.coalesce(F.col(by).cast("string"), F.lit("")), F.col(id_column)
    order = [stamp.desc(), key.desc()] if descending else [stamp.asc(), key.asc()]
    return items.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= n)


def listed(items: DataFrame, keys: list[str], n: int | None = None, by: str = "event_time", descending: bool = False, id_column: str = "event_id") -> DataFrame:
    """Per keys at most n items (200 where none is given), with position and matched_count, how many there are in all."""
    counts = items.groupBy(*keys).agg(F.count("*").alias("matched_count"))
    top = top_items(items, keys, max(0, min(MOST_ITEMS, MOST_ITEMS if n is None else n)), by, id_column, descending)
    return top.join(counts, keys)
