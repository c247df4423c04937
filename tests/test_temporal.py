import datetime as dt

import pytest
from pyspark.sql import functions as F

from veritempo.functions import temporal as T


def d(text):
    return F.lit(text).cast("date")


def ts(text):
    return F.lit(text).cast("timestamp")


DAY = lambda: T.on_day(d("2025-03-10"))
YEAR = lambda: T.in_year(F.lit(2025))
MONTH = lambda: T.in_month(F.lit(2025), F.lit(3))
WEEK = lambda: T.temporal(kind=F.lit("interval"), granularity=F.lit("week"), interval_start=d("2025-03-10"), interval_end=d("2025-03-16"))
INSTANT = lambda: T.at_instant(ts("2025-03-10 12:00:00"))

CASES = [
    (YEAR, "2025-01-01", "2026-01-01", "match"),
    (YEAR, "2025-03-01", "2025-04-01", "unknown"),
    (YEAR, "2024-01-01", "2025-01-01", "no_match"),
    (MONTH, "2025-03-01", "2025-04-01", "match"),
    (MONTH, "2025-03-10", "2025-03-11", "unknown"),
    (MONTH, "2025-07-01", "2025-08-01", "no_match"),
    (MONTH, "2025-01-01", "2026-01-01", "match"),
    (DAY, "2025-03-10", "2025-03-11", "match"),
    (DAY, "2025-03-10 12:00:00", "2025-03-10 12:00:01", "unknown"),
    (DAY, "2025-03-11", "2025-03-12", "no_match"),
    (WEEK, "2025-03-10", "2025-03-17", "match"),
    (WEEK, "2025-03-11", "2025-03-12", "unknown"),
    (WEEK, "2025-03-17", "2025-03-24", "no_match"),
    (INSTANT, "2025-03-10", "2025-03-11", "match"),
    (INSTANT, "2025-03-11", "2025-03-12", "no_match"),
    (lambda: T.unknown_time(F.lit("once")), "2025-01-01", "2026-01-01", "unknown"),
    (lambda: T.partial_time("past", F.lit("before")), "2025-01-01", "2026-01-01", "unknown"),
    (lambda: T.temporal(kind=F.lit("habitual"), date=d("2025-03-10"), precision=F.lit("day")), "2025-01-01", "2026-01-01", "unknown"),
    (lambda: T.temporal(kind=F.lit("exact"), date=d("2025-03-10"), precision=F.lit("approx_day")), "2025-01-01", "2026-01-01", "unknown"),
    (lambda: T.temporal(kind=F.lit("exact"), recurring=F.lit(True), date=d("2025-03-10")), "2025-01-01", "2026-01-01", "unknown"),
]


def test_occurrence_truth_table(spark):
    columns = [T.occurrence_membership(t(), ts(a), ts(b)).alias(f"c{i}") for i, (t, a, b, _) in enumerate(CASES)]
    row = spark.range(1).select(*columns).first()
    assert list(row) == [x[3] for x in CASES]


def test_validity(spark):
    cases = [("2025-01-01", "2026-01-01", "match"), ("2025-03-15", "2026-01-01", "unknown"), ("2026-01-01", "2027-01-01", "no_match")]
    columns = [T.validity_membership(ts(a), ts(b), ts("2025-03-01"), ts("2025-04-01")).alias(f"c{i}") for i, (a, b, _) in enumerate(cases)]
    open_ = T.validity_membership(ts("2025-01-01"), F.lit(None).cast("timestamp"), ts("2025-03-01"), ts("2025-04-01"), True)
    closed = T.validity_membership(ts("2025-01-01"), F.lit(None).cast("timestamp"), ts("2025-03-01"), ts("2025-04-01"))
    row = spark.range(1).select(*columns, open_.alias("open"), closed.alias("closed")).first()
    assert list(row) == [x[2] for x in cases] + ["match", "unknown"]


def test_zone_moves_the_day(spark):
    local = T.on_day(d("2025-03-31"), F.lit("America/Fortaleza"))
    row = spark.range(1).select(T.occurrence_membership(local, ts("2025-03-01"), ts("2025-04-01")).alias("m")).first()
    assert row.m == "unknown"  # its last three hours are in April, in UTC


def test_roles():
    assert T.role_of("Relation", "valid_from") == "validity"
    with pytest.raises(ValueError):
        T.role_of("event", "nothing")


def test_relative_periods():
    now = dt.datetime(2024, 3, 1, 1, 0, tzinfo=dt.UTC)  # still February in Fortaleza
    assert T.relative_period("this_month", now, "America/Fortaleza") == (dt.datetime(2024, 2, 1, 3, tzinfo=dt.UTC), dt.datetime(2024, 3, 1, 3, tzinfo=dt.UTC))
    assert T.relative_period("last_month", dt.datetime(2024, 1, 5, tzinfo=dt.UTC))[0] == dt.datetime(2023, 12, 1, tzinfo=dt.UTC)
    start, end = T.relative_period("this_week", dt.datetime(2024, 1, 17, tzinfo=dt.UTC))
    assert (start.day, end.day) == (15, 22)
    with pytest.raises(ValueError):
        T.relative_period("next_year", now)


def test_sort_key_and_persistable(spark):
    row = spark.range(1).select(T.sort_key(DAY()).alias("a"), T.sort_key(YEAR()).alias("b"), T.sort_key(T.unknown_time(F.lit("x"))).alias("c"), T.persistable(DAY()).alias("d"), T.persistable(T.unknown_time(F.lit("x"))).alias("e")).first()
    assert (row.a.rank, row.b.rank, row.c.rank, row.d, row.e) == (0, 1, 2, True, False)
