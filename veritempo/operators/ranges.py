"""Many requests' time ranges against many events at once: an interval join by bins of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritempo.functions import temporal as T
from veritempo.functions.text import let
from veritempo.operators.scope import by_user
from veritempo.storage import checkpoint

#: Seconds of a bin of level 0; each level's bins are twice as wide.
NARROWEST = 86_400


def _level(start: Column, end: Column) -> Column:
    """The least level whose bins are as wide as the interval, so that it lies in two of them at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2((F.greatest(end - start, F.lit(1)) / NARROWEST).cast("double")))).cast("int")


def _bins(start: Column, end: Column, level: Column) -> Column:
    """The bins of a level that [start, end) touches; seconds since the epoch."""
    width = F.shiftleft(F.lit(NARROWEST).cast("long"), level) if isinstance(level, int) else (F.lit(NARROWEST) * F.pow(F.lit(2.0), level)).cast("long")
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlapping(requests: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of requests and windows of the same keys that overlap, each once, with the columns of both.

    requests: start and end; windows: w_start and w_end, timestamps, half-open; names must not clash but for the keys. An
    interval's level is that of its length. Two intervals meet at the higher of their levels, in the bin where their
    overlap starts, so a pair meets once; the lower one is put in that level's bins, one or two. Windows are repeated for
    the levels that requests have only, so a few times, however many requests there are.
    """
    asked = requests.where("start < end").withColumns({"a": F.unix_micros("start"), "b": F.unix_micros("end")})
    held = windows.where("w_start < w_end").withColumns({"c": F.unix_micros("w_start"), "d": F.unix_micros("w_end")})
    second = 1_000_000
    for side, begin, stop in ((asked, "a", "b"), (held, "c", "d")):
        level = _level(F.floor(F.col(begin) / second), F.ceil(F.col(stop) / second))
        if side is asked:
            asked = side.withColumn("r_level", level)
        else:
            held = side.withColumn("w_level", level)
    request_levels = sorted(r[0] for r in asked.select("r_level").distinct().collect())  # by length: a few dozen at most
    window_levels = sorted(r[0] for r in held.select("w_level").distinct().collect())

    def at(side: DataFrame, own: str, begin: str, stop: str, levels: list[int]) -> DataFrame:
        """The rows in the bins of every given level that is not below their own."""
        rows = side.withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(own))))
        bins = _bins(F.floor(F.col(begin) / second), F.ceil(F.col(stop) / second), F.col("level"))
        return rows.withColumn("bin", F.explode(bins))

    if not request_levels or not window_levels:
        return asked.drop("a", "b", "r_level").join(held.drop("c", "d", "w_level"), keys).limit(0)
    levels = sorted({*request_levels, *window_levels})
    pairs = at(asked, "r_level", "a", "b", levels).join(at(held, "w_level", "c", "d", levels), [*keys, "level", "bin"])
    begin = F.greatest("a", "c")
    meets = (F.col("level") == F.greatest("r_level", "w_level")) & (begin < F.least("b", "d"))
    first = F.floor(F.floor(begin / second) / (F.lit(NARROWEST) * F.pow(F.lit(2.0), F.col("level"))).cast("long")) == F.col("bin")
    return pairs.where(meets & first).drop("a", "b", "c", "d", "level", "bin", "r_level", "w_level")


def memberships(requests: DataFrame, events: DataFrame) -> DataFrame:
    """request_id, event_id and membership (match or unknown) of every event that may lie in a request's range.

    requests: request_id, start, end; events: event_id, temporal; with user_id on both sides or on neither. Events whose
    time has no window may lie in any range: they make no pairs here, and `counted` counts them.
    """
    user = by_user(requests, events)
    held = placed(events).where("w_start is not null").select(*user, "event_id", "w_start", "w_end")
    pairs = overlapping(requests.select(*user, "request_id", "start", "end"), held, user)
    rows = pairs.withColumn("membership", T.window_membership(F.col("w_start"), F.col("w_end"), F.col("start"), F.col("end")))
    return rows.select(*user, "request_id", "event_id", "membership")


def placed(events: DataFrame) -> DataFrame:
    """Events with w_start and w_end: an exact instant and the microsecond after it, or the possible window; null where the
    membership in any range is unknown (`temporal.occurrence_membership`, for a time that is worked out once)."""
    t = F.col("temporal")
    open_ = F.coalesce(t["kind"] == "habitual", F.lit(False)) | F.coalesce(t["recurring"], F.lit(False)) | (F.coalesce(T.granularity_of(t) == "instant", F.lit(False)) & T.exact_instant(t).isNull())

    def span(x: Column) -> Column:
        last = F.timestamp_add("MICROSECOND", F.lit(1), x["instant"])
        return F.when(~x["open"], F.struct(F.coalesce(x["instant"], x["window"]["start"]).alias("start"), F.coalesce(last, x["window"]["end"]).alias("end")))

    read = F.struct(T.exact_instant(t).alias("instant"), T.possible_window(t).alias("window"), open_.alias("open"))
    rows = events.withColumn("w", let(read, span))
    return rows.withColumns({"w_start": F.col("w.start"), "w_end": F.col("w.end")}).drop("w")


def counted(requests: DataFrame, events: DataFrame) -> DataFrame:
    """Per request n, n_unknown and completeness, as of one count for each; events without any window are unknown to all.

    Equal ranges are counted once and equal windows are one window with its number, so pairs are of different ranges and
    different windows: calendar periods stay few, however many requests and events there are.
    """
    user = by_user(requests, events)
    held = placed(events.groupBy(*user, "temporal").agg(F.count("*").alias("held")))  # equal times are worked out once
    held = checkpoint(held.groupBy(*user, "w_start", "w_end").agg(F.sum("held").alias("held")))
    windows = held.where("w_start is not null")
    pairs = overlapping(requests.select(*user, "start", "end").distinct(), windows, user)
    membership = T.window_membership(F.col("w_start"), F.col("w_end"), F.col("start"), F.col("end"))
    found = pairs.withColumn("membership", membership).groupBy(*user, "start", "end").agg(*[F.sum(F.when(F.col("membership") == m, F.col("held")).otherwise(0)).alias(n) for n, m in (("n", T.MATCH), ("n_unknown", T.UNKNOWN))])
    bare = held.where("w_start is null")
    rows = requests.join(found, [*user, "start", "end"], "left")
    if user:
        rows = rows.join(bare.groupBy(*user).agg(F.sum("held").alias("n_bare")), user, "left")
    else:
        rows = rows.withColumn("n_bare", F.lit(bare.agg(F.coalesce(F.sum("held"), F.lit(0))).first()[0]))
    unknown = F.coalesce("n_unknown", F.lit(0)) + F.coalesce("n_bare", F.lit(0))
    return rows.select(*user, "request_id", F.coalesce("n", F.lit(0)).alias("n"), unknown.alias("n_unknown"), F.when(unknown > 0, T.PARTIAL).otherwise(T.COMPLETE).alias("completeness"))
