"""Repeated runs of lines, found by distributed prefix doubling over line-ID sequences and deleted from later copies.

A document is the sequence of its lines that hold more than white space, compared without white space at their ends. A
suffix is named, at depth h, by the first position of its bucket: all suffixes that share their first h lines. Depth 1
names lines; each round joins a suffix's name with that of the suffix h lines later and so doubles the depth, first to
`min_lines`, then on until no bucket holds two suffixes: buckets are the intervals of the suffix array whose longest
common prefix has h lines or more. Suffixes alone in their bucket leave at once, so rounds after the first carry repeated
text only. A suffix that is not the first of its bucket starts a run that has begun earlier (smaller doc_id, or earlier
line); its deepest such interval tells the run's depth and its source. The lines of all runs are deleted, overlapping or
touching runs forming one maximal run. Runs never cross documents. With `long_words`, a line of at least so many words
that has begun earlier is a run too, alone.

All steps are grouping, window and join operations: buckets are counted by partial aggregation, so a line that a third
of all documents share sends one row per task, and its join back to the suffixes is of the kind that adaptive execution
splits. Every round is checkpointed, so that plans don't grow.

Defined results: null and empty texts have no lines and stay as they are; white-space lines are never compared nor
deleted; texts of any length are taken whole; a document of fewer than `min_lines` lines loses nothing; rows equal in
doc_id and text count as one document and get the same result, rows with the same doc_id and other texts are documents
of their own, ordered by a hash of the text; an empty table gives an empty result; other columns stay untouched, but
those named like a column of the result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritempo.llm.common import checkpoint

#: Lines of the shortest run that is deleted.
MIN_LINES = 2
#: Words from which a line alone is a run, where a caller asks for it; short lines of clean texts are spared.
LONG_WORDS = 50

_ID, _HASH = "__doc", "__text_hash"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _suffixes(docs: DataFrame, id_column: str, text_column: str, least_words: int) -> DataFrame:
    """__doc, __text_hash, n (line, counted from 0 among lines with content) and its 128-bit hash (a, b)."""
    kept = F.filter(F.transform(_lines(F.col(text_column)), _bare), lambda x: x != "")
    rows = docs.select(F.col(id_column).alias(_ID), F.xxhash64(text_column).alias(_HASH), F.posexplode(kept).alias("n", "line"))
    if least_words:
        rows = rows.where(F.size(F.split("line", r"\s+")) >= least_words)
    return rows.select(_ID, _HASH, "n", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).distinct()


def _bucketed(suffixes: DataFrame) -> DataFrame:
    """__doc, __text_hash, n and first of the suffixes whose (a, b) others have too; first is the earliest of them."""
    shared = suffixes.groupBy("a", "b").agg(F.min(F.struct(_ID, _HASH, "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    # with a third key the groups get an exchange of their own, and adaptive execution may split a hot bucket's other side
    third = F.xxhash64("a", "b").alias("c")
    return suffixes.select("*", third).join(shared.select("a", "b", "first", third), ["a", "b", "c"]).select(_ID, _HASH, "n", "first")


def _doubled(found: DataFrame, step: int) -> DataFrame:
    """The buckets of a depth that is greater by `step` lines, from those of a depth of `step` lines at least."""
    later = Window.partitionBy(_ID, _HASH).orderBy("n").rangeBetween(step, step)
    pairs = found.select(_ID, _HASH, "n", F.col("first").alias("a"), F.min("first").over(later).alias("b"))
    return _bucketed(pairs.where(F.col("b").isNotNull()))


def repeated_suffixes(docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text_column: str = "text", least_words: int = 0, to_the_end: bool = True) -> DataFrame:
    """Columns __doc, __text_hash, n, depth, first: suffixes that share `min_lines` lines or more with an earlier one.

    depth is the greatest one reached by doubling at which the suffix has an earlier one in its interval, and first the
    earliest of these. With `least_words`, only lines of at least so many words count (for runs of one line).
    """
    found, depth = _bucketed(_suffixes(docs, id_column, text_column, least_words)), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        found, depth = _doubled(found, step), depth + step
    own, runs = F.struct(_ID, _HASH, "n"), None
    while True:
        found = checkpoint(found)
        later = found.where(F.col("first") < own).withColumn("depth", F.lit(depth))
        runs = later if runs is None else runs.unionByName(later)
        if not to_the_end or found.isEmpty():
            break
        found, depth = _doubled(found, depth), 2 * depth
    deepest = runs.groupBy(_ID, _HASH, "n").agg(F.max_by(F.struct("depth", "first"), "depth").alias("r"))
    return deepest.select(_ID, _HASH, "n", "r.depth", "r.first")


def delete_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_column: str = "doc_id", text_column: str = "text", long_words: int | None = None) -> DataFrame:
    """The documents with kept_text, n_lines, n_removed (lines) and n_runs (maximal deleted runs) added."""
    runs = repeated_suffixes(docs, min_lines, id_column, text_column)
    if long_words:
        runs = runs.unionByName(repeated_suffixes(docs, 1, id_column, text_column, long_words, to_the_end=False))
    starts = runs.select(_ID, _HASH, "n", (F.col("n") + F.col("depth")).alias("end"))
    before = F.max("end").over(Window.partitionBy(_ID, _HASH).orderBy("n", "end").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(_ID, _HASH, "n", "end", F.coalesce(F.col("n") > before, F.lit(True)).cast("int").alias("opens"), F.greatest(F.coalesce(before, F.col("n")), F.col("n")).alias("new"))
    # each run's lines without those of runs before it, so that every deleted line is named once
    gone = F.collect_list(F.when(F.col("new") < F.col("end"), F.struct("new", "end")))
    cut = starts.groupBy(_ID, _HASH).agg(gone.alias("__starts"), F.sum("opens").cast("int").alias("__runs"))
    added = ("kept_text", "n_lines", "n_removed", "n_runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added]).alias("__row"), F.col(id_column).alias("__own"), F.col(text_column).alias("__text"), F.xxhash64(text_column).alias("__own_hash"))
    rows = rows.join(cut, F.col("__own").eqNullSafe(F.col(_ID)) & (F.col("__own_hash") == F.col(_HASH)), "left")
    # `lines` and `content` are each used twice below, so that the optimiser keeps them as columns
    rows = rows.withColumn("__lines", _lines(F.col("__text")))
    content = F.transform(F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("at"), _bare(x).alias("line"))), lambda x: x["line"] != ""), lambda x: x["at"])
    numbers = F.flatten(F.transform("__starts", lambda s: F.sequence(s["new"], s["end"] - 1)))
    rows = rows.withColumn("__content", content).withColumn("__gone", numbers)
    gone = F.transform("__gone", lambda n: F.get(F.col("__content"), n))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    counts = [F.size("__content").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"), F.coalesce("__runs", F.lit(0)).alias("n_runs")]
    return rows.select("__row.*", text.alias("kept_text"), *counts)
