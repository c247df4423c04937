"""Answers with a status from competing attribute assertions, for all entities at once.

Statuses: known_single, known_multiple, ambiguous, temporally_unknown, unknown. Absence and a different value never mean
no. Groups are by value identity, nulls being equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.functions import temporal as T

#: Columns that make two values the same.
IDENTITY = ["value_kind", "text_value", "numeric_value", "unit"]


def _identity() -> Column:
    return F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"})


def value_matches(kind: str, text: str | None = None, number: Column | None = None, unit: str | None = None) -> Column:
    """Same kind and value; units differ only where both are given."""
    if kind == "text":
        return (F.col("value_kind") == "text") & (F.col("text_value") == text)
    same = (F.col("value_kind") == "number") & (F.col("numeric_value") == number)
    return same if unit is None else same & F.coalesce(F.col("unit") == unit, F.lit(True))


def _scoped(rows: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    inside = F.lit(T.MATCH) if start is None else T.occurrence_membership(F.col("temporal"), start, end)
    return rows.withColumn("membership", inside)


def value_lookup(attributes: DataFrame, keys: list[str], start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Per keys: status, n_values, support (current rows) and the value where it is single."""
    rows = _scoped(attributes, start, end)
    match, current = F.col("membership") == T.MATCH, F.col("is_current")
    found = rows.groupBy(*keys).agg(
        F.count_if(match).alias("n_match"),
        F.count_if(F.col("membership") == T.UNKNOWN).alias("n_unknown"),
        F.count_if(match & current).alias("support"),
        F.count_distinct(F.when(match & current, _identity())).alias("n_values"),
        F.min(F.when(match & current, F.coalesce("text_value", F.col("numeric_value").cast("string")))).alias("value"),
    )
    status = (
        F.when((F.col("n_match") == 0) & (F.col("n_unknown") > 0), "temporally_unknown")
        .when(F.col("n_match") == 0, "unknown")
        .when(F.col("n_values") == 1, "known_single")
        .when(F.col("n_values") > 1, "ambiguous")
        .otherwise("temporally_unknown")
    )
    return found.select(*keys, status.alias("status"), "n_values", "support", F.when(F.col("n_values") == 1, F.col("value")).alias("value"))


def value_groups(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and value: support and the ids of its assertions, in order."""
    return attributes.groupBy(*keys, *IDENTITY).agg(F.count("*").alias("support"), F.array_sort(F.collect_list("attribute_id")).alias("attribute_ids"))


def previous_values(attributes: DataFrame, keys: list[str], first: bool = False, limit: int = 1) -> DataFrame:
    """Per keys: the last closed assertions (or the first ones) by temporal key; descending puts undated ones first."""
    key = T.sort_key(F.col("temporal"))
    parts = [key["rank"], key["stamp"], F.col("attribute_id")]
    order = Window.partitionBy(*keys).orderBy(*[p.asc() if first else p.desc() for p in parts])
    rows = attributes.where(~F.col("is_current")).withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return rows


def historical_existence(attributes: DataFrame, keys: list[str], matches: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Per keys: yes, temporally_unknown or unknown; never no."""
    rows = _scoped(attributes, start, end)
    found = rows.groupBy(*keys).agg(F.count_if(matches & (F.col("membership") == T.MATCH)).alias("n_yes"), F.count_if(matches & (F.col("membership") == T.UNKNOWN)).alias("n_maybe"))
    return found.withColumn("answer", F.when(F.col("n_yes") > 0, "yes").when(F.col("n_maybe") > 0, "temporally_unknown").otherwise("unknown"))


def proposition(attributes: DataFrame, keys: list[str], matches: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Per keys: yes, ambiguous, temporally_unknown or unknown; another known value is still unknown."""
    hits = _scoped(attributes, start, end).groupBy(*keys).agg(F.count_if(matches & F.col("is_current") & (F.col("membership") == T.MATCH)).alias("hits"))
    rows = value_lookup(attributes, keys, start, end).join(hits, keys)
    answer = (
        F.when(F.col("status") == "temporally_unknown", "temporally_unknown")
        .when((F.col("status") == "ambiguous") & (F.col("hits") > 0), "ambiguous")
        .when((F.col("status") == "known_single") & (F.col("hits") > 0), "yes")
        .otherwise("unknown")
    )
    return rows.select(*keys, "status", answer.alias("answer"))


def intrinsic_names(entities: DataFrame) -> DataFrame:
    """Distinct names of entities of one type and how many bear them; blank names are none."""
    return entities.where(F.trim("name") != "").groupBy("type_key", "name").agg(F.count("*").alias("support"))


def composed_label(attributes: DataFrame, first: str, second: str) -> DataFrame:
    """One label per entity from the current values of two dimensions."""
    rows = attributes.where("is_current").groupBy("entity_id").agg(*[F.max(F.when(F.col("dimension") == d, F.coalesce("text_value", F.col("numeric_value").cast("string")))).alias(f"d{i}") for i, d in enumerate((first, second))])
    return rows.select("entity_id", F.concat_ws(" ", "d0", "d1").alias("label"))
