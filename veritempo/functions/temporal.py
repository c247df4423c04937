"""Three-valued temporal predicates as column expressions.

A temporal value is a struct column (`TEMPORAL`) that keeps what was said about a time apart from what it resolves to. A
query range is half-open. Every predicate ends in an explicit `unknown`, so that SQL's null never stands for an answer.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, NO_MATCH, UNKNOWN = "match", "no_match", "unknown"
COMPLETE, PARTIAL, INDETERMINATE = "complete", "partial", "indeterminate"

TEMPORAL = (
    "struct<kind:string,original_text:string,granularity:string,precision:string,interval_start:date,interval_end:date,"
    "instant:timestamp,date:date,timezone:string,period_start:timestamp,period_end:timestamp,recurring:boolean>"
)
_FIELDS = [f.split(":") for f in TEMPORAL[7:-1].split(",")]

#: Which question a field of a primitive answers.
ROLES = {
    ("event", "temporal"): "occurrence",
    ("measurement", "temporal"): "observation",
    ("measurement", "observed_at"): "observation",
    ("attribute", "temporal"): "assertion",
    ("relation", "temporal"): "validity",
    ("relation", "valid_from"): "validity",
    ("relation", "valid_to"): "validity",
    ("relation", "termination_temporal"): "observation",
    ("state", "temporal"): "observation",
    ("state", "valid_from"): "validity",
    ("state", "valid_to"): "validity",
}

_WINDOWED = ("year", "month", "day", "week")


def role_of(primitive: str, field: str = "temporal") -> str:
    """The membership role of a field; an unknown pair is an error."""
    try:
        return ROLES[primitive.strip().lower(), field.strip().lower()]
    except KeyError:
        raise ValueError(f"no membership role for {primitive}.{field}") from None


def temporal(**given: Column) -> Column:
    """A temporal struct of the given fields; the others are null."""
    return F.struct(*[F.coalesce(given[name], F.lit(None)).cast(kind).alias(name) if name in given else F.lit(None).cast(kind).alias(name) for name, kind in _FIELDS])


def at_instant(instant: Column) -> Column:
    return temporal(kind=F.lit("exact"), granularity=F.lit("instant"), precision=F.lit("minute"), instant=instant)


def on_day(day: Column, timezone: Column | None = None) -> Column:
    return temporal(kind=F.lit("exact"), granularity=F.lit("day"), precision=F.lit("day"), date=day, timezone=timezone if timezone is not None else F.lit(None))


def in_year(year: Column) -> Column:
    return temporal(kind=F.lit("interval"), granularity=F.lit("year"), interval_start=F.make_date(year, F.lit(1), F.lit(1)), interval_end=F.make_date(year, F.lit(12), F.lit(31)))


def in_month(year: Column, month: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return temporal(kind=F.lit("interval"), granularity=F.lit("month"), interval_start=first, interval_end=F.last_day(first))


def unknown_time(text: Column) -> Column:
    return temporal(kind=F.lit("unknown"), original_text=text)


def partial_time(relation: str, text: Column) -> Column:
    """Only the relation to the moment of speaking is known: past, future or ongoing."""
    return temporal(kind=F.lit("partial"), granularity=F.lit(relation), original_text=text)


def _zone(t: Column) -> Column:
    return F.coalesce(t["timezone"], F.lit("UTC"))


def _midnight(day: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def granularity_of(t: Column) -> Column:
    """Said granularity where it is a calendar one, else that of the precision."""
    said = F.when(t["granularity"].isin(*_WINDOWED, "instant"), t["granularity"])
    return F.coalesce(said, F.when(t["precision"] == "minute", "instant").when(t["precision"] == "day", "day"))


def calendar_known(t: Column) -> Column:
    return t["instant"].isNotNull() | t["date"].isNotNull() | t["period_start"].isNotNull() | t["precision"].isNotNull() | F.coalesce(t["recurring"], F.lit(False))


def sort_instant(t: Column) -> Column:
    """Instant, else midnight of the date in its own zone, else the period's start; null if none is known."""
    return F.coalesce(t["instant"], _midnight(t["date"], _zone(t)), t["period_start"])


def sort_key(t: Column) -> Column:
    """struct(rank, stamp): 0 dated, 1 interval only, 2 text only. Descending order puts text before dates."""
    instant = sort_instant(t)
    rank = F.when(instant.isNotNull(), 0).when(t["interval_start"].isNotNull(), 1).otherwise(2)
    stamp = F.when(instant.isNotNull(), F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.coalesce(t["interval_start"].cast("string"), t["original_text"]))
    return F.struct(rank.alias("rank"), stamp.alias("stamp"))


def exact_instant(t: Column) -> Column:
    """An instant only by instant granularity or minute precision; a day's midnight never is one."""
    return F.when((granularity_of(t) == "instant") | (t["precision"] == "minute"), t["instant"])


def persistable(t: Column) -> Column:
    """Some calendar anchor, a relation to the moment of speaking, or a whole interval."""
    whole = t["interval_start"].isNotNull() & t["interval_end"].isNotNull()
    return F.coalesce(sort_instant(t).isNotNull() | F.coalesce(t["recurring"], F.lit(False)) | ((t["kind"] == "partial") & t["granularity"].isNotNull()) | whole, F.lit(False))


def possible_window(t: Column) -> Column:
    """struct(start, end) within which the time lies for certain; null if no window is known."""
    zone = _zone(t)

    def dates(start: Column, end: Column) -> Column:
        return F.struct(_midnight(start, zone).alias("start"), _midnight(F.date_add(end, 1), zone).alias("end"))

    bounded = t["interval_start"].isNotNull() & t["interval_end"].isNotNull()
    nothing = F.lit(None).cast("struct<start:timestamp,end:timestamp>")
    day = F.coalesce(t["date"], F.to_date(t["instant"]))
    return (
        F.when(bounded & granularity_of(t).isin(*_WINDOWED), dates(t["interval_start"], t["interval_end"]))
        .when(F.coalesce(t["recurring"], F.lit(False)) | t["precision"].isin("approx_day", "day_period", "recurring"), nothing)
        .when(t["period_start"].isNotNull() & t["period_end"].isNotNull(), F.when(t["period_start"] < t["period_end"], F.struct(t["period_start"].alias("start"), t["period_end"].alias("end"))))
        .when(((granularity_of(t) == "day") | (t["precision"] == "day")) & day.isNotNull(), dates(day, day))
        .when(calendar_known(t), nothing)
        .when((t["kind"] == "interval") & bounded, dates(t["interval_start"], t["interval_end"]))
        .otherwise(nothing)
    )


def window_membership(start: Column, end: Column, q_start: Column, q_end: Column) -> Column:
    """Inside the range: match; apart from it: no_match; else unknown."""
    return F.when((start >= q_start) & (end <= q_end), MATCH).when((end <= q_start) | (start >= q_end), NO_MATCH).otherwise(UNKNOWN)


def occurrence_membership(t: Column, q_start: Column, q_end: Column) -> Column:
    """Membership of events, observations and assertions."""
    instant, window = exact_instant(t), possible_window(t)
    return (
        F.when((t["kind"] == "habitual") | F.coalesce(t["recurring"], F.lit(False)), UNKNOWN)
        .when(instant.isNotNull(), F.when((instant >= q_start) & (instant < q_end), MATCH).otherwise(NO_MATCH))
        .when(granularity_of(t) == "instant", UNKNOWN)
        .when(window.isNull(), UNKNOWN)
        .otherwise(window_membership(window["start"], window["end"], q_start, q_end))
    )


def validity_membership(start: Column, end: Column, q_start: Column, q_end: Column, open_ended: Column | bool = False) -> Column:
    """Match only where validity covers the whole range."""
    return (
        F.when(end.isNotNull() & (q_start >= end), NO_MATCH)
        .when(start.isNotNull() & (q_end <= start), NO_MATCH)
        .when(start.isNotNull() & end.isNotNull() & (start <= q_start) & (end >= q_end), MATCH)
        .when(start.isNotNull() & end.isNull() & F.lit(open_ended) & (start <= q_start), MATCH)
        .otherwise(UNKNOWN)
    )


def validity_bounds(t: Column) -> Column:
    """struct(start, end) of the time read as a validity; null bounds if unknown."""
    zone = _zone(t)

    def pair(start: Column, end: Column) -> Column:
        return F.struct(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end"))

    return (
        F.when(t["interval_start"].isNotNull() & t["interval_end"].isNotNull(), pair(_midnight(t["interval_start"], zone), _midnight(F.date_add(t["interval_end"], 1), zone)))
        .when(t["period_start"].isNotNull() & t["period_end"].isNotNull(), pair(t["period_start"], t["period_end"]))
        .when(t["instant"].isNotNull() & (granularity_of(t) == "instant"), pair(t["instant"], t["instant"] + F.expr("INTERVAL 1 MICROSECOND")))
        .when(t["date"].isNotNull(), pair(_midnight(t["date"], zone), _midnight(F.date_add(t["date"], 1), zone)))
        .otherwise(pair(F.lit(None), F.lit(None)))
    )


def membership(t: Column, q_start: Column, q_end: Column, role: str = "occurrence") -> Column:
    if role == "validity":
        bounds = validity_bounds(t)
        return validity_membership(bounds["start"], bounds["end"], q_start, q_end)
    return occurrence_membership(t, q_start, q_end)


def relation_endpoint(t: Column, last: bool = False) -> Column:
    """A relation's calendar start (or end): instant, date at UTC midnight, or the interval's day, whose end is not moved on."""
    return F.coalesce(t["instant"], t["date"].cast("timestamp"), t["interval_end" if last else "interval_start"].cast("timestamp"))


def relative_period(name: str, now: dt.datetime, timezone: str = "UTC") -> tuple[dt.datetime, dt.datetime]:
    """The half-open UTC range of a period named relative to now, in the user's civil time; weeks begin on Monday."""
    zone = ZoneInfo(timezone)
    local = now.astimezone(zone)
    day = dt.datetime(local.year, local.month, local.day, tzinfo=zone)
    month = day.replace(day=1)
    week = day - dt.timedelta(days=day.weekday())

    def days(start: dt.datetime, n: int) -> dt.datetime:
        moved = start.date() + dt.timedelta(days=n)
        return dt.datetime(moved.year, moved.month, moved.day, tzinfo=zone)

    def months(start: dt.datetime, n: int) -> dt.datetime:
        k = start.year * 12 + start.month - 1 + n
        return dt.datetime(k // 12, k % 12 + 1, 1, tzinfo=zone)

    ranges = {
        "now": (now, now + dt.timedelta(microseconds=1)),
        "today": (day, days(day, 1)),
        "yesterday": (days(day, -1), day),
        "this_week": (days(day, -day.weekday()), days(week, 7)),
        "last_week": (days(week, -7), week),
        "this_month": (month, months(month, 1)),
        "last_month": (months(month, -1), month),
    }
    if name not in ranges:
        raise ValueError(f"unknown period {name}")
    start, end = ranges[name]
    return start.astimezone(dt.UTC), end.astimezone(dt.UTC)


def weekday_shift(base: Column, weekday: Column, policy: str) -> Column:
    """The date of a weekday (Monday 0) near base: next, previous (today counts) or their strict forms (it doesn't)."""
    ahead, behind = F.pmod(weekday - F.weekday(base), F.lit(7)), F.pmod(F.weekday(base) - weekday, F.lit(7))
    moves = {
        "next": ahead,
        "previous": -behind,
        "next_strict": F.when(ahead == 0, 7).otherwise(ahead),
        "previous_strict": -F.when(behind == 0, 7).otherwise(behind),
    }
    if policy not in moves:
        raise ValueError(f"unknown policy {policy}")
    return F.date_add(base, moves[policy].cast("int"))


def time_conflict(candidates: list[Column], instant: Column, resolved: Column, weekday: Column, timezone: Column) -> Column:
    """Why the parts of a stated time disagree, or null."""
    dates = F.array_distinct(F.array_compact(F.array(*candidates)))
    local = F.to_date(F.from_utc_timestamp(instant, timezone))
    return (
        F.when(F.size(dates) > 1, "several_dates")
        .when(instant.isNotNull() & resolved.isNotNull() & (local != resolved), "instant_outside_date")
        .when(weekday.isNotNull() & resolved.isNotNull() & (F.weekday(resolved) != weekday), "weekday_mismatch")
    )


#: Statuses that look back and those that look ahead.
PAST_STATUSES, FUTURE_STATUSES = ("completed", "cancelled"), ("scheduled", "pending")


def with_stated_time(rows: DataFrame, s: dict[str, Column], reference: Column, zone: Column, status: Column) -> DataFrame:
    """The rows with temporal, rule and error of a time as it was stated: what it resolves to, by which rule, or why not.

    s: relative_day, weekday, weekday_policy, date, instant, time_of_day (HH:mm), monthday (of a monthly recurrence),
    period_start, period_end, month, year, relation (before, after, ongoing), unknown_reason, text. Parts that disagree
    are an error, as is a relative part without a reference. Without any calendar part, a relation, an admitted gap, a
    year or month, or the status of the event still gives a partial time. Each step is a column of its own, used by the
    later ones, so that the plan stays small.
    """
    kept = rows.columns
    rows = rows.withColumns({f"__{k}": c for k, c in s.items()} | {"__ref": reference, "__zone": zone, "__status": status})
    c = {k: F.col(f"__{k}") for k in (*s, "ref", "zone", "status", "today", "asked", "policy", "from_day", "from_weekday", "absolute", "day", "at", "calendar", "said", "year_said")}
    rows = rows.withColumn("__today", F.to_date(F.from_utc_timestamp(c["ref"], c["zone"])))
    relative = F.when(c["relative_day"] == "today", c["today"]).when(c["relative_day"] == "yesterday", F.date_sub(c["today"], 1)).when(c["relative_day"] == "tomorrow", F.date_add(c["today"], 1))
    rows = rows.withColumns({"__from_day": relative, "__asked": F.coalesce(c["weekday_policy"], F.when(c["status"].isNotNull(), "from_status"))})
    rows = rows.withColumn("__policy", F.when(c["asked"] != "from_status", c["asked"]).when(c["status"].isin(*FUTURE_STATUSES), "next").when(c["status"].isin(*PAST_STATUSES), "previous"))
    shifted = F.coalesce(*[F.when(c["policy"] == p, weekday_shift(c["today"], c["weekday"], p)) for p in ("next", "previous", "next_strict", "previous_strict")])
    rows = rows.withColumns({"__from_weekday": F.when(c["weekday"].isNotNull(), shifted), "__absolute": F.coalesce(c["date"], F.when(c["from_day"].isNull(), F.to_date(F.from_utc_timestamp(c["instant"], c["zone"]))))})
    rows = rows.withColumn("__day", F.coalesce(c["from_day"], c["from_weekday"], c["absolute"]))
    rows = rows.withColumn("__at", F.coalesce(c["instant"], F.when(c["day"].isNotNull() & c["time_of_day"].isNotNull(), F.to_utc_timestamp(F.concat_ws(" ", c["day"].cast("string"), c["time_of_day"]).cast("timestamp"), c["zone"]))))
    recurs, spans = c["monthday"].isNotNull(), c["period_start"].isNotNull() & c["period_end"].isNotNull()
    rows = rows.withColumns({
        "__calendar": c["day"].isNotNull() | c["at"].isNotNull() | recurs | spans,
        "__said": F.coalesce(c["relation"], F.when(c["unknown_reason"].isNotNull(), "before")),
        "__year_said": F.coalesce(c["year"], F.year(c["today"])),
    })
    error = (
        F.when((c["relative_day"].isNotNull() | c["weekday"].isNotNull()) & c["ref"].isNull(), "reference_missing")
        .when((c["weekday"] < 0) | (c["weekday"] > 6), "weekday_impossible")
        .when(c["weekday"].isNotNull() & c["policy"].isNull(), "policy_missing")
        .when(c["time_of_day"].isNotNull() & c["day"].isNull() & ~recurs, "day_missing")
        .when(c["period_start"].isNotNull() != c["period_end"].isNotNull(), "period_open")
        .when(c["period_end"] < c["period_start"], "period_reversed")
        .otherwise(time_conflict([c["from_day"], c["from_weekday"], c["absolute"]], c["at"], c["day"], c["weekday"], c["zone"]))
    )
    minute = c["at"].isNotNull()
    precise = F.when(recurs & c["day"].isNull(), "recurring").when(spans, "period").when(minute, "minute").otherwise("day")
    resolved = temporal(
        kind=F.lit("exact"), original_text=c["text"], granularity=F.when(minute, "instant").when(c["day"].isNotNull(), "day"), precision=precise, instant=c["at"], date=F.coalesce(c["day"], F.to_date(F.from_utc_timestamp(c["at"], c["zone"]))),
        timezone=c["zone"], period_start=c["period_start"], period_end=c["period_end"], recurring=recurs,
    )
    partial = F.coalesce(
        F.when(c["said"].isNotNull(), partial_time_of(c["said"], c["text"])),
        F.when(c["month"].isNull() & c["year"].isNotNull(), in_year(c["year"])),
        F.when(c["month"].isNotNull() & c["year_said"].isNotNull(), in_month(c["year_said"], c["month"])),
        F.when(c["month"].isNotNull() | c["status"].isin(*PAST_STATUSES), partial_time_of(F.lit("before"), c["text"])),
    )
    rule = (
        F.when(~c["calendar"], F.when(c["said"].isNotNull(), "partial.relation").when(c["month"].isNotNull(), "partial.month").when(c["year"].isNotNull(), "partial.year").otherwise("partial.status"))
        .when(c["relative_day"].isNotNull(), F.concat(F.lit("relative."), c["relative_day"]))
        .when(c["weekday"].isNotNull(), F.concat(F.lit("weekday."), c["asked"]))
        .when(recurs & c["date"].isNull() & c["instant"].isNull(), "recurrence.monthly_by_monthday")
        .when(spans, "period.explicit")
        .when(minute, "absolute.datetime")
        .otherwise("absolute.date")
    )
    rows = rows.withColumn("temporal", F.when(c["calendar"], resolved).otherwise(partial))
    rows = rows.withColumn("error", F.coalesce(error, F.when(F.col("temporal").isNull(), "insufficient")))
    ok = F.col("error").isNull()
    return rows.select(*kept, F.when(ok, F.col("temporal")).alias("temporal"), F.when(ok, rule).alias("rule"), "error")


def partial_time_of(relation: Column, text: Column) -> Column:
    """As `partial_time`, with a relation that differs from row to row."""
    return temporal(kind=F.lit("partial"), granularity=relation, original_text=text)
