"""Entity search and resolution of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions.text import normalize
from veritempo.operators.events import closure
from veritempo.operators.scope import by_user

RESOLVED, AMBIGUOUS, UNRESOLVED = "resolved", "ambiguous", "unresolved"


def search_rank(needle: Column) -> Column:
    """0 exact id or name, 1 alias, 2 prefix, 3 inside the name, 4 inside an alias, 5 inside the id, 6 in the type."""
    name, alias, key, kind = (F.lower(c) for c in ("name", "alias", "entity_id", "type_key"))
    return (
        F.when((key == needle) | (name == needle), 0)
        .when(alias == needle, 1)
        .when(name.startswith(needle), 2)
        .when(name.contains(needle), 3)
        .when(alias.contains(needle), 4)
        .when(key.contains(needle), 5)
        .when(kind.contains(needle), 6)
    )


def search(entities: DataFrame, text: str, type_key: str | None = None, limit: int = 50) -> DataFrame:
    """The best hits of a search by (rank, name, id), and whether there are more."""
    rows = entities if type_key is None else entities.where(F.col("type_key") == type_key)
    needle = text.strip().lower()
    hits = rows.withColumn("rank", search_rank(F.lit(needle)) if needle else F.lit(0)).where("rank is not null")
    limit = max(0, min(limit, 50))
    top = hits.orderBy("rank", F.lower("name"), "entity_id").limit(limit + 1)
    order = Window.orderBy("rank", F.lower("name"), "entity_id")  # over limit + 1 rows at most
    numbered = top.withColumn("position", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("position") <= limit).select("position", "rank", "entity_id", "name", "truncated")


def resolve_named(mentions: DataFrame, entities: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """mention_id, status, entity_id and n: entities whose name or alias is the text, both normalised.

    A type hint (column hint) only decides between several candidates. Equal texts with equal hints meet as one, and
    entities of one name and type as one row with their number, so a common name makes no pairs.
    """
    user = by_user(mentions, entities)
    hinted = "hint" in mentions.columns and concepts is not None
    hint = F.col("hint") if hinted else F.lit(None).cast("string")
    asked = mentions.select(*user, "mention_id", normalize(F.col("text")).alias("needle"), hint.alias("hint"))
    named = entities.select(*user, "entity_id", "type_key", F.explode(F.array(normalize(F.col("name")), normalize(F.col("alias")))).alias("needle")).where("needle != ''").distinct()
    known = named.groupBy(*user, "needle", "type_key").agg(F.count("*").alias("n"), F.min("entity_id").alias("any"))
    found = asked.select(*user, "needle", "hint").distinct().join(known, [*user, "needle"])
    if hinted:
        below = closure(concepts).select(F.col("concept").alias("type_key"), F.col("ancestor").alias("hint"), F.lit(True).alias("fits"))
        found = found.join(below, ["type_key", "hint"], "left")
    else:
        found = found.withColumn("fits", F.lit(None).cast("boolean"))
    key = [*user, "needle", "hint"]
    counts = found.groupBy(*[F.col(c).alias(f"for_{c}") for c in key]).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)).alias("n_fit"), F.min("any").alias("any"), F.min(F.when(F.col("fits"), F.col("any"))).alias("fit"))
    rows = asked.join(counts, [F.col(c).eqNullSafe(F.col(f"for_{c}")) if c == "hint" else F.col(c) == F.col(f"for_{c}") for c in key], "left")
    status = F.when(F.col("n").isNull(), UNRESOLVED).when((F.col("n") == 1) | (F.col("n_fit") == 1), RESOLVED).otherwise(AMBIGUOUS)
    one = F.when(F.col("n") == 1, F.col("any")).when(F.col("n_fit") == 1, F.col("fit"))
    return rows.select(*user, "mention_id", status.alias("status"), one.alias("entity_id"), F.coalesce("n", F.lit(0)).alias("n"))


def resolve_possessive(mentions: DataFrame, owned: DataFrame, create: bool = False) -> DataFrame:
    """mention_id, status, entity_id and n: what the speaker (column owner) owns: one resolves, none may be created."""
    user = by_user(mentions, owned)
    counts = owned.groupBy(*user, "owner").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"))
    rows = mentions.join(counts, [*user, "owner"], "left")
    none = "create_candidate" if create else UNRESOLVED
    status = F.when(F.col("n").isNull(), none).when(F.col("n") == 1, RESOLVED).otherwise(AMBIGUOUS)
    return rows.select(*user, "mention_id", status.alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("entity_id"), F.coalesce("n", F.lit(0)).alias("n"))


def most_recent(mentions: DataFrame, recent: DataFrame) -> DataFrame:
    """Per conversation the distinct entities mentioned, latest first: recent(conv_id, position, entity_id)."""
    key = [*by_user(mentions, recent), "conv_id"]
    last = recent.groupBy(*key, "entity_id").agg(F.max("position").alias("position"))
    order = Window.partitionBy(*key).orderBy(F.desc("position"), "entity_id")
    return mentions.join(last.withColumn("recency", F.row_number().over(order)), key)
