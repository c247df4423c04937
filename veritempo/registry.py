"""The register of queries, and small things that they share."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritempo.sources.frames import KnowledgeFrames

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The ranges that the queries ask about.
YEAR = ("1996-01-01", "1997-01-01")
MONTH = ("1996-03-01", "1996-04-01")
DAY = ("1996-03-10", "1996-03-11")
LOG_DAY = ("2024-01-10", "2024-01-11")


def query(function: Callable[[KnowledgeFrames], DataFrame]) -> Query:
    """Register a function of the frames under its name."""
    return _registered(function, 1)


def query_of_two_users(function: Callable[[KnowledgeFrames], DataFrame]) -> Query:
    """As `query`, over the frames of two users whose ids collide."""
    return _registered(function, 2)


def _registered(function: Callable[[KnowledgeFrames], DataFrame], users: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(KnowledgeFrames(spark, sf_dir, users))

    QUERIES[function.__name__] = run
    return run


def stamp(text: str) -> Column:
    return F.lit(dt.datetime.fromisoformat(text)).cast("timestamp")


def span(days: tuple[str, str]) -> tuple[Column, Column]:
    return stamp(days[0]), stamp(days[1])


def text_of(column: str) -> Column:
    """Whole numbers that may be null, as text, so that no reader turns them into floating point."""
    return F.col(column).cast("string").alias(column)
