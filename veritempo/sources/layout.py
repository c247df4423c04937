"""Frames laid out by user: a user's rows lie in one folder of many, so that one user's question reads a part of the files.

Folders are named by a hash bucket of user_id, and by how many buckets there were when the rows were written, so that later
batches may have more. Rows are written in ranges of (bucket, user, row), which Spark takes from a sample: a user with a
third of all rows is spread over as many files as that asks for, small users share one, and each file's row groups hold
users next to each other. What all users share, the concepts, isn't split.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritempo.operators.scope import USER
from veritempo.sources.frames import KnowledgeFrames

#: Frames with users; `concept` has none.
FRAMES = ("entity", "event", "participant", "fact", "measurement", "attribute", "state", "relation", "correction")
LAYOUT = ["user_buckets", "user_bucket"]


def write_by_user(rows: DataFrame, path: str, buckets: int = 256, mode: str = "errorifexists") -> None:
    """Write rows with user_id by bucket of the user; `mode` append adds a batch. A null user_id has bucket -1."""
    if taken := set(LAYOUT) & set(rows.columns):
        raise ValueError(f"reserved columns: {sorted(taken)}")
    bucket = F.when(F.col(USER).isNull(), -1).otherwise(F.pmod(F.xxhash64(USER), F.lit(buckets))).cast("int")
    placed = rows.withColumns({"user_buckets": F.lit(buckets), "user_bucket": bucket})
    # the hash of the whole row comes last, so that ranges may cut one user's rows and a task written again cuts them alike
    ranged = placed.repartitionByRange(F.col("user_bucket"), F.col(USER), F.xxhash64(*rows.columns))
    ranged.sortWithinPartitions("user_bucket", USER).write.mode(mode).partitionBy(*LAYOUT).parquet(path)


def read_by_user(spark, path: str, user_id: int | None = None) -> DataFrame:
    """All rows, or one user's: then only that user's folder is read, and of its files the row groups that may have the user."""
    rows = spark.read.parquet(path)
    if user_id is not None:
        user = F.lit(user_id).cast(rows.schema[USER].dataType)
        rows = rows.where(F.col("user_bucket") == F.pmod(F.xxhash64(user), F.col("user_buckets"))).where(F.col(USER) == user)
    return rows.drop(*LAYOUT)


def store_by_user(frames: KnowledgeFrames, path: str, names: tuple[str, ...] = FRAMES, buckets: int = 256) -> StoredFrames:
    """Write frames and concepts under a folder, and return the frames that read them."""
    for name in names:
        write_by_user(getattr(frames, name), f"{path}/{name}", buckets)
    frames.concept.write.parquet(f"{path}/concept")
    return StoredFrames(frames.spark, path)


def _stored(name: str) -> property:
    return property(lambda self: read_by_user(self.spark, f"{self.path}/{name}", self.user_id), doc=f"The stored frame {name}.")


@dataclass
class StoredFrames(KnowledgeFrames):
    """The frames that `store_by_user` has written, of all users or, by `of_user`, of one."""

    user_id: int | None = None

    entity = _stored("entity")
    event = _stored("event")
    participant = _stored("participant")
    fact = _stored("fact")
    measurement = _stored("measurement")
    attribute = _stored("attribute")
    state = _stored("state")
    relation = _stored("relation")
    correction = _stored("correction")

    @cached_property
    def concept(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/concept")

    def of_user(self, user_id: int) -> StoredFrames:
        return replace(self, user_id=user_id)
