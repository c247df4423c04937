"""Answers with a status from observations. Record time is never chronology; units are never converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions import temporal as T


def _value() -> Column:
    return F.concat_ws("|", F.col("value").cast("string"), F.coalesce("unit", F.lit("-")))


def comparable(number: Column, unit: Column) -> Column:
    """match, mismatch or incomparable; only equal units, or none on both sides, compare."""
    same = F.col("unit").eqNullSafe(unit)
    return F.when(~same, "incomparable").when(F.col("value") == number, "match").otherwise("mismatch")


def membership(start: Column, end: Column) -> Column:
    """Of the observation's own moment; unknown without one."""
    at = F.col("observed_at")
    return F.when(at.isNull(), T.UNKNOWN).when((at >= start) & (at < end), T.MATCH).otherwise(T.NO_MATCH)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: status, the latest moment, how many values it has, and the value if single.

    An observation of unknown time beside dated ones leaves the latest ambiguous.
    """
    # partial aggregates, then a join on the keys: no window over all observations of a key
    tops = rows.groupBy(*keys).agg(F.max("observed_at").alias("at"), F.count_if(F.col("observed_at").isNull()).alias("n_unknown"))
    at_top = rows.join(tops.select(*keys, "at"), keys).where(F.col("observed_at") == F.col("at"))
    values = at_top.groupBy(*keys).agg(F.count_distinct(_value()).alias("n_values"), F.min("value").alias("value"))
    found = tops.join(values, keys, "left")
    status = (
        F.when((F.col("n_unknown") > 0) & F.col("at").isNotNull(), "ambiguous")
        .when(F.col("at").isNull(), "temporally_unknown")
        .when(F.col("n_values") == 1, "known_single")
        .otherwise("ambiguous")
    )
    return found.select(*keys, status.alias("status"), "at", F.coalesce("n_values", F.lit(0)).alias("n_values"), F.when(status == "known_single", F.col("value")).alias("value"), "n_unknown")


def at_time(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Per keys: what was observed inside the range; never falls back to the latest."""
    inside = membership(start, end)
    found = rows.withColumn("m", inside).groupBy(*keys).agg(F.count_if(F.col("m") == T.MATCH).alias("n"), F.count_if(F.col("m") == T.UNKNOWN).alias("n_unknown"), F.count_distinct(F.when(F.col("m") == T.MATCH, _value())).alias("n_values"))
    status = F.when((F.col("n") == 0) & (F.col("n_unknown") > 0), "temporally_unknown").when(F.col("n") == 0, "unknown").when(F.col("n_values") == 1, "known_single").otherwise("ambiguous")
    return found.select(*keys, status.alias("status"), "n", "n_values", "n_unknown")


def in_range(rows: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Per keys: number, first and last observation inside the range; single only if there is exactly one."""
    inside = rows.withColumn("m", membership(start, end))
    hit = F.when(F.col("m") == T.MATCH, F.struct(F.col("observed_at"), F.col("measurement_id"), F.col("value")))
    found = inside.groupBy(*keys).agg(F.count_if(F.col("m") == T.MATCH).alias("n"), F.count_if(F.col("m") == T.UNKNOWN).alias("n_unknown"), F.min(hit).alias("first"), F.max(hit).alias("last"))
    status = F.when((F.col("n") == 0) & (F.col("n_unknown") > 0), "temporally_unknown").when(F.col("n") == 0, "unknown").when(F.col("n") == 1, "known_single").otherwise("known_multiple")
    return found.select(*keys, status.alias("status"), "n", "n_unknown", F.col("first.measurement_id").alias("first_id"), F.col("last.measurement_id").alias("last_id"))


def value_proposition(rows: DataFrame, keys: list[str], number: Column, unit: Column, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Per keys: yes, ambiguous, temporally_unknown or unknown; other values are no denial."""
    m = F.lit(T.MATCH) if start is None else membership(start, end)
    marked = rows.withColumn("m", m).withColumn("c", comparable(number, unit))
    hit = F.col("c") == "match"
    found = marked.groupBy(*keys).agg(
        F.count_if(hit & (F.col("m") == T.MATCH)).alias("hits"),
        F.count_if(hit & (F.col("m") == T.UNKNOWN)).alias("maybe"),
        F.count_if((F.col("c") == "mismatch") & (F.col("m") == T.MATCH)).alias("others"),
        F.count_if(F.col("c") == "incomparable").alias("n_incomparable"),
    )
    conflict = F.col("others") > 0 if start is not None else F.lit(False)
    answer = F.when((F.col("hits") > 0) & conflict, "ambiguous").when(F.col("hits") > 0, "yes").when(F.col("maybe") > 0, "temporally_unknown").otherwise("unknown")
    return found.select(*keys, answer.alias("answer"), "hits", "n_incomparable")


def value_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "value", "unit").agg(F.count("*").alias("support"))
