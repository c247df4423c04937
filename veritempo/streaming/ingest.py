"""Structured Streaming forms of ingest: requests once only, windowed activity, and keyed conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_only(requests: DataFrame, at: str = "ts", keys: tuple[str, ...] = ("user_id", "request_id"), late: str = "10 minutes") -> DataFrame:
    """The first row of each request within the watermark; its state is dropped as the watermark passes."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and sum of events per type and window; late rows up to the watermark count."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def upsert_current(path: str, keys: list[str], at: str):
    """A foreachBatch function that keeps the latest row per keys in a Parquet folder, swapped whole for each batch.

    Batch 0 starts the folder; a later batch without its predecessor's folder fails, as the state would be lost. Only the
    last state and its predecessor, from which a repeated batch starts again, are kept. Rows of one moment are told apart
    by a hash of all columns.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/v={number}"
        rows = spark.read.parquet(f"{path}/v={number - 1}").unionByName(batch) if number else batch
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(at), F.xxhash64(*rows.columns))).alias("r")).select("r.*")
        latest.write.mode("overwrite").parquet(target)
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return write


def focus_changes(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState: per conversation, turns so far and the speaker of the last one."""
    turns, last = state.get if state.exists else (0, None)
    for part in rows:
        part = part.sort_values("turn")
        turns += len(part)
        last = str(part["role"].iloc[-1]) if len(part) else last
    state.update((turns, last))
    yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "last_role": [last]})


def conversation_focus(turns: DataFrame) -> DataFrame:
    """Per conversation the state after each batch in which it had turns."""
    return turns.groupBy("conv_id").applyInPandasWithState(focus_changes, "conv_id long, turns long, last_role string", "turns long, last_role string", "update", "NoTimeout")
