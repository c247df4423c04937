"""Scalar functions over text, numbers and values."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is worked out once, however often the body names it; keeps long rules small."""
    return F.get(F.transform(F.array(value), body), 0)


ID_PATTERN = r"^[A-Za-z0-9_.:-]{1,128}$"
CONCEPT_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+)*$"



def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of the basic plane whose compatibility decomposition without marks is one other character, and those with several.

    Korean syllables, which are put together by rule, and characters outside the plane stay as they are.
    """
    one, several = {}, {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare not in ("", c):
            (one if len(bare) == 1 else several)[c] = bare.lower()
    return one, several


_ONE, _SEVERAL = _decompositions()
_MARKED, _PLAIN = "".join(_ONE), "".join(x[0] for x in _ONE.values())
#: Those of the others that texts in alphabets hold: ligatures, fractions, dots, signs of letters.
_LIGATURES = {c: bare for c, bare in _SEVERAL.items() if "\u00a0" < c < "\u2600" or "\ufb00" <= c <= "\ufb06"}


def _class_of(characters: dict[str, str]) -> str:
    """A pattern for any of some characters, by ranges: a class of hundreds is tried one by one at every place."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_LIGATURE, _BEYOND_ASCII = _class_of(_LIGATURES), r"[^\x00-\x7f]"


def fold(text: Column) -> Column:
    """Lower case without marks: compatibility decomposition, in the JVM; punctuation stays.

    Marks that stand alone go, so decomposed and composed texts fold alike; letters with marks and full-width forms become
    plain ones by one translation, and ligatures and the like, where a text has any, by a map of characters.
    """
    low = F.regexp_replace(F.translate(F.lower(F.trim(text)), _MARKED, _PLAIN), r"\p{Mn}+", "")
    parts = F.str_to_map(F.lit("\n".join(f"{c}\t{bare}" for c, bare in _LIGATURES.items())), F.lit("\n"), F.lit("\t"))

    def spelled(low: Column) -> Column:
        each = F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(parts, c), c))
        return F.when(low.rlike(_BEYOND_ASCII) & low.rlike(_LIGATURE), F.array_join(each, "")).otherwise(low)

    return let(low, spelled)


def normalize(text: Column) -> Column:
    """`fold`, with every run of other characters than letters, digits and _ as one space. No Python involved."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


@F.pandas_udf(StringType())
def normalize_exact(texts: pd.Series) -> pd.Series:
    """As `normalize` for any script: compatibility decomposition, marks dropped, case folded. In Arrow batches."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in bare).split()).casefold()

    return texts.map(one, na_action="ignore")


def slug(text: Column, longest: int = 48) -> Column:
    """A key of small letters, digits and _; null if none remains or it can't start with a letter."""
    key = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    key = F.when(key.rlike("^[0-9]"), F.concat(F.lit("r_"), key)).otherwise(key)
    key = F.regexp_replace(F.substring(key, 1, longest), "_+$", "")
    return F.when(key.rlike("^[a-z]"), key)


def decimal_of(text: Column) -> Column:
    """A decimal from text with comma or point; null if it is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(38,6)")


def name_like(text: Column, longest: int = 128) -> Column:
    """One line with single spaces, of limited length and with some letter or digit; else null."""
    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), lambda name: F.when((F.length(name) <= longest) & name.rlike(r"[\p{L}\p{N}_]"), name))


def model_like(text: Column) -> Column:
    """A name of three words at most; else null."""
    return let(name_like(text), lambda name: F.when(F.size(F.split(name, " ")) <= 3, name))


def quantity_of(text: Column) -> Column:
    """struct(number, unit): the first number that a unit follows."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(kg|g|km|m|cm|mm|l|ml|h|min|anos|%)\b"
    low = F.lower(text)
    number = decimal_of(F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")))
    return F.when(number.isNotNull(), F.struct(number.alias("number"), F.regexp_extract(low, pattern, 2).alias("unit")))


def time_of_day(text: Column) -> Column:
    """HH:mm of a valid time; else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*((?:[01]?\d|2[0-3]):[0-5]\d)\s*$", 1), F.lit(""))


def coerce_closed(value: Column, allowed: list[str], aliases: dict[str, str], default: str | None = None) -> Column:
    """A word of a closed vocabulary, by itself or by an alias; else the default."""
    word = F.lower(F.trim(value))
    if aliases:
        names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        word = F.coalesce(names[word], word)
    return F.when(word.isin(allowed), word).otherwise(F.lit(default))


def format_number(value: Column) -> Column:
    """Whole numbers without decimals, others with a comma and no closing zeros."""
    text = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    return F.replace(F.when(text.isin("", "-"), "0").otherwise(text), F.lit("."), F.lit(","))


def format_money(amount: Column, currency: Column) -> Column:
    """R$ 1.234,56 for reais, 1.234,56 CUR for others."""
    text = F.translate(F.format_number(amount, 2), ",.", ".,")
    return F.when(currency == "BRL", F.concat(F.lit("R$ "), text)).otherwise(F.concat_ws(" ", text, currency))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def encode_value(raw: Column) -> Column:
    """struct(kind, value): booleans before whole numbers, then decimals, money and references in JSON, else text."""
    money = F.get_json_object(raw, "$.amount").isNotNull() & F.get_json_object(raw, "$.currency").isNotNull()
    reference = F.get_json_object(raw, "$.entity_id").isNotNull()
    kind = (
        F.when(raw.isNull(), "null")
        .when(F.lower(raw).isin("true", "false"), "bool")
        .when(raw.rlike(r"^-?\d+$"), "int")
        .when(raw.rlike(r"^-?\d+\.\d+$"), "decimal")
        .when(raw.startswith("{") & money, "money")
        .when(raw.startswith("{") & reference, "ref")
        .when(raw.startswith("{") | raw.startswith("["), "json")
        .otherwise("string")
    )
    value = F.when(kind == "money", F.concat_ws(" ", F.get_json_object(raw, "$.amount"), F.get_json_object(raw, "$.currency"))).when(kind == "ref", F.get_json_object(raw, "$.entity_id")).when(kind == "bool", F.lower(raw)).otherwise(raw)
    return F.struct(kind.alias("kind"), value.alias("value"))


def objects_in(text: Column) -> Column:
    """How many braced objects stand side by side in a text, by a scan that knows nesting and quoted strings."""

    def step(state: Column, c: Column) -> Column:
        quoted, escaped, depth = state["quoted"], state["escaped"], state["depth"]
        turns = (c == '"') & ~escaped
        outer = ~quoted & (c == "{") & (depth == 0)
        return F.struct(
            F.when(quoted, depth).when(c == "{", depth + 1).when(c == "}", F.greatest(depth - 1, F.lit(0))).otherwise(depth).alias("depth"),
            F.when(turns, ~quoted).otherwise(quoted).alias("quoted"),
            (quoted & ~escaped & (c == "\\")).alias("escaped"),
            (state["n"] + F.when(outer, 1).otherwise(0)).alias("n"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"))
    return F.aggregate(F.split(text, ""), start, step, lambda state: state["n"])


def json_object_of(text: Column) -> Column:
    """The one object in a reply: code fences off, from the first brace to the last; null if that is no JSON object."""
    bare = F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when((body != "") & F.get_json_object(body, "$").isNotNull() & (objects_in(body) == 1), body)
