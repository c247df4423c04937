"""Many fixed expressions sought in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Expressions and their characters that are sent to every worker at most; larger lists meet the texts in a join.
MOST_EXPRESSIONS, MOST_CHARACTERS = 100_000, 2_000_000
#: Characters by which an expression and a text find each other in the join.
GRAM = 3


def _by_automaton(texts: DataFrame, expressions: list[tuple[int, str]], keys: list[str]) -> DataFrame:
    """One pass over each text, however many expressions there are."""
    places: dict[str, list[int]] = {}
    for number, expression in expressions:
        places.setdefault(expression, []).append(number)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for expression, numbers in places.items():
            automaton.add_word(expression, numbers)
        automaton.make_automaton()
        for batch in source:
            rows, found = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                hits = {n for _, numbers in automaton.iter(text) for n in numbers}
                rows += [i] * len(hits)
                found += sorted(hits)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keys))), pa.array(found, pa.int64())], names=[*keys, "expression_id"])

    types = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keys)
    if not places:
        return texts.select(*keys, F.lit(0).cast("long").alias("expression_id")).limit(0)
    return texts.select(*keys, "text").where("text is not null").mapInArrow(batches, f"{types}, expression_id long")


def _grams(text: Column, n: int) -> Column:
    """The distinct strings of n characters in a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


def _by_join(texts: DataFrame, expressions: DataFrame, keys: list[str]) -> DataFrame:
    """Texts and expressions meet on an expression's rarest three characters (or on all of a shorter one)."""
    short = [expressions.where(F.length("expression") == n).withColumn("gram", F.col("expression")) for n in range(1, GRAM)]
    grams = expressions.where(F.length("expression") >= GRAM).withColumn("gram", F.explode(_grams(F.col("expression"), GRAM)))
    common = grams.groupBy("gram").agg(F.count("*").alias("n"))
    long_ = grams.join(common, "gram").groupBy("expression_id", "expression").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    keyed = long_.unionByName(short[0].select(*long_.columns)).unionByName(short[1].select(*long_.columns))
    pieces = texts.where("text is not null").select(*keys, "text", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))))).alias("gram"))
    return pieces.join(keyed, "gram").where(F.expr("contains(text, expression)")).select(*keys, "expression_id")


def expressions_in(texts: DataFrame, expressions: DataFrame, keys: list[str], most: int = MOST_EXPRESSIONS) -> DataFrame:
    """keys and expression_id of every expression that stands somewhere in a text, each once.

    texts: keys and text. expressions: expression_id and expression; empty ones are in no text. Lists up to a size go to
    the workers as one automaton; above it, texts and expressions meet in a join by rare parts.
    """
    told = expressions.where("expression != ''").select(F.col("expression_id").cast("long").alias("expression_id"), "expression").distinct()
    size = told.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("expression")), F.lit(0)).alias("characters")).first()
    if size["n"] <= most and size["characters"] <= MOST_CHARACTERS:
        return _by_automaton(texts, [tuple(r) for r in told.collect()], keys)
    return _by_join(texts, told, keys)
