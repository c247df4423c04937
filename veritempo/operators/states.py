"""The current state per dimension, with completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions import temporal as T

_ORDINAL = (T.COMPLETE, T.PARTIAL, T.INDETERMINATE)


def current(states: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Per keys: the current state's id and value, completeness and n_open. few: the keys have few values, like a vocabulary.

    Ranked by (temporal key, id) descending, so that an interval goes before a date. Undated states are set apart: they
    make the answer partial, or indeterminate where nothing else is known. Equal keys at the top are indeterminate.
    The top's time is found first, with partial sums of fixed width; only states at that time are then folded with their
    ids and values. No window and no aggregation holds all of a key's states, or all different times.
    """
    timed = states.where("is_current").select(*keys, F.col("state_id").alias("id"), "value", T.sort_instant(F.col("temporal")).alias("instant"), F.col("temporal")["interval_start"].alias("day"))
    rows = timed.withColumn("day", F.when(F.col("instant").isNull(), F.col("day")))
    dated = F.col("instant").isNotNull() | F.col("day").isNotNull()
    found = rows.groupBy(*keys).agg(F.max("day").alias("top_day"), F.max("instant").alias("top_instant"), F.count_if(~dated).alias("n_open")).withColumnsRenamed({k: f"top_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"top_{k}")) for k in keys]
    at_top = F.when(F.col("top_day").isNotNull(), F.col("day") == F.col("top_day")).when(F.col("top_instant").isNotNull(), F.col("instant") == F.col("top_instant")).otherwise(F.lit(True))
    tops = rows.join(F.broadcast(found) if few else found, same).where(at_top)
    some, n_open = F.col("some"), F.col("n_open")
    out = tops.groupBy(*keys, dated.alias("some"), "n_open").agg(F.max(F.struct("id", "value")).alias("top"), F.count("*").alias("n_same"))
    completeness = (
        F.when(~some & (n_open == 1), T.PARTIAL)
        .when(~some, T.INDETERMINATE)
        .when(n_open > 0, T.PARTIAL)
        .when(F.col("n_same") > 1, T.INDETERMINATE)
        .otherwise(T.COMPLETE)
    )
    known = some | (n_open == 1)
    return out.select(
        *keys,
        F.when(known, F.col("top.id")).alias("state_id"),
        F.when(known, F.col("top.value")).alias("value"),
        completeness.alias("completeness"),
        F.when(some & (n_open == 0), F.when(F.col("n_same") > 1, 1).otherwise(0)).when(~some & (n_open == 1), 0).otherwise(n_open).cast("long").alias("n_open"),
    )


def worst(column: str) -> Column:
    """The least complete of a group."""
    order = F.array_position(F.array(*map(F.lit, _ORDINAL)), F.col(column))
    return F.element_at(F.array(*map(F.lit, _ORDINAL)), F.max(order).cast("int"))
