"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only (the path may be any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or, where none is set on one machine, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """A folder of its own below the shared one, for tables that cut the lineage: compressed files that can be deleted.

    What a result is read from lazily must be kept; the rest goes with `drop` when it is no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def _next(self) -> str:
        self.tables += 1
        return f"{self.folder}/{self.tables}"

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again."""
        path = self._next()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def keep_by(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """The same in buckets by a key: joins by it don't move these rows again."""
        path, name = self._next(), f"scratch_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
        kept = self.spark.table(name)
        kept._scratch, kept._table = path, name
        return kept

    def clear(self) -> None:
        """Delete all of them, once nothing is read from them any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            if name := getattr(df, "_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def groups_for(rows: int, per_group: int) -> int:
    """How many groups hold `rows` rows at about `per_group` each."""
    return max(1, math.ceil(rows / per_group))


def spread(column, groups: int):
    """A group number from 0 to groups - 1, evenly dealt by the column's hash."""
    return F.pmod(F.xxhash64(column), F.lit(groups)).cast("int")

