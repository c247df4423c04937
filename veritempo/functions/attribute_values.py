"""Typed values of attributes in free text: names, brands and models, quantities, years and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritempo.functions.text import fold, let, model_like, name_like
from veritempo.functions.vocabulary import looked_up

# Words, units and dimensions that decide the result.
COLORS = ["prata", "silver", "branca", "branco", "white", "preto", "preta", "black", "cinza", "gray", "grey", "azul", "blue", "vermelho", "vermelha", "red"]
BRANDS = [
    "honda", "toyota", "ford", "chevrolet", "vw", "volkswagen", "fiat", "hyundai", "nissan", "renault", "peugeot", "citroen", "jeep", "bmw", "mercedes", "audi", "kia", "mitsubishi", "subaru", "volvo", "byd", "caoa",
]
QUANTITIES = [
    ("area", "m²", ["m2", "metrosquadrados", "metroquadrado"]),
    ("weight", "kg", ["kg", "kilo", "kilos", "quilograma", "quilogramas"]),
    ("height", "m", ["m", "metro", "metros"]),
    ("capacity", "L", ["l", "lt", "litro", "litros", "liter", "liters"]),
]
COLOR_NAMES = ["colours", "colour", "color", "cores", "cor"]
NOT_NAMES = ["meu", "carro", "e", "é", "um", "uma", "o", "a", "de"]
VEHICLE_KINDS = ["vehicle", "automobile", "thing", "unknown"]
#: A number and a unit, in folded text (m² is m2 there).
QUANTITY = r"(\d+(?:[.,]\d+)?)\s*(m2|metros?\s+quadrados?|kg|kilos?|quilogramas?|metros?|m\b|litros?|liters?|l\b|lt\b)"
HISTORICAL = r"\bera\b|\beram\b|\bwas\b|\bwere\b"
TRIMMED = r"^[.,;:!\s]+|[.,;:!\s]+$"

VALUE = "struct<dimension:string,kind:string,text:string,number:decimal(38,6),unit:string,year:int>"


def _value(dimension: Column | str, kind: str, text: Column | None = None, number: Column | None = None, unit: Column | None = None, year: Column | None = None) -> Column:
    parts = [dimension if isinstance(dimension, Column) else F.lit(dimension), F.lit(kind), text, number, unit, year]
    return F.struct(*[F.lit(None) if x is None else x for x in parts]).cast(VALUE)


def _said(text: Column, words: str) -> Column:
    """What follows "... is" after one of the words, to the end; null if nothing does."""
    found = F.regexp_extract(text, rf"(?i)(?:{words})\s+(?:is|e|é|=)\s+(.+)$", 1)
    return F.nullif(F.regexp_replace(found, TRIMMED, ""), F.lit(""))


def _name(expression: Column, raw: Column) -> Column:
    value = name_like(F.coalesce(_said(F.trim(expression), "name|nome"), _said(F.trim(raw), "name|nome")))
    return let(value, lambda v: F.when(v.isNotNull(), _value("name", "text", text=v)))


def brand_and_model(expression: Column, raw: Column, subject_kind: Column) -> Column:
    """struct(brand, model) as values, either null; null if neither is stated or the brand is none of the known ones."""
    words = F.filter(F.regexp_extract_all(F.coalesce(F.nullif(F.trim(raw), F.lit("")), expression, F.lit("")), F.lit(r"[A-Za-zÀ-ÿ0-9\-]+"), 0), lambda w: ~F.lower(w).isin(NOT_NAMES))
    read = F.struct(fold(F.coalesce(expression, F.lit(""))).alias("e"), fold(F.coalesce(raw, F.lit(""))).alias("r"), words.alias("words"), subject_kind.alias("kind"))

    def stated(x: Column) -> Column:
        brand, model = (F.coalesce(_said(x["r"], p), _said(x["e"], p)) for p in ("brand|marca", "model|modelo"))
        return F.struct(brand.alias("brand"), model.alias("model"), F.get(x["words"], 0).alias("head"), x["words"].alias("words"), F.concat_ws(" ", x["e"], x["r"]).alias("surface"), x["kind"].alias("kind"))

    def shown(x: Column) -> Column:
        bare = x["brand"].isNull() & x["model"].isNull() & fold(x["head"]).isin(BRANDS)
        return let(bare, lambda b: F.struct(F.coalesce(x["brand"], F.when(b, x["head"])).alias("brand"), F.coalesce(x["model"], F.when(b & (F.size(x["words"]) > 1), F.array_join(F.slice(x["words"], 2, 1000), " "))).alias("model"), x["surface"].alias("surface"), x["kind"].alias("kind")))

    def known(x: Column) -> Column:
        named, fit = name_like(F.when(fold(x["brand"]).isin(BRANDS), x["brand"])), model_like(x["model"])
        return F.struct(named.alias("named"), fit.alias("fit"), x["brand"].isNotNull().alias("some"), ((x["kind"] == "person") & ~x["surface"].contains("carro") & ~x["surface"].contains("car")).alias("person"))

    def pair(x: Column) -> Column:
        title = F.concat(F.upper(F.substring(x["named"], 1, 1)), F.substring(x["named"], 2, 1000))
        refused = (x["some"] & x["named"].isNull()) | F.coalesce(x["person"], F.lit(False))
        both = F.struct(F.when(x["named"].isNotNull(), _value("brand", "text", text=title)).alias("brand"), F.when(x["fit"].isNotNull(), _value("model", "text", text=x["fit"])).alias("model"))
        return F.when(~refused & (x["named"].isNotNull() | x["fit"].isNotNull()), both)

    return let(let(let(let(read, stated), shown), known), pair)


def quantity(text: Column) -> Column:
    """The first number with a unit, as a value of the dimension that the unit belongs to."""
    number = F.replace(F.nullif(F.regexp_extract(text, QUANTITY, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,6)")
    unit = F.regexp_replace(F.regexp_extract(text, QUANTITY, 2), r"\s+", "")

    def of(x: Column) -> Column:
        cases = [x["unit"].isin(names) | F.regexp_replace(x["unit"], "s$", "").isin(names) for _, _, names in QUANTITIES]
        pick = lambda i: F.coalesce(*[F.when(c, F.lit(q[i])) for c, q in zip(cases, QUANTITIES, strict=True)])
        return let(F.struct(pick(0).alias("dimension"), pick(1).alias("unit")), lambda d: F.when(x["number"].isNotNull() & d["dimension"].isNotNull(), _value(d["dimension"], "number", number=x["number"], unit=d["unit"])))

    return let(F.struct(number.alias("number"), unit.alias("unit")), of)


def _color(expression: Column) -> Column:
    """A known colour among the words, or whatever follows a name of the dimension."""
    word = F.get(F.filter(F.concat(F.array(expression), F.split(expression, r"\s+")), lambda w: w.isin(COLORS)), 0)
    named = rf"^(?:{'|'.join(COLOR_NAMES)})(?![a-z0-9])"
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(expression, named, ""), r"^[ \t=:|-]+|[ \t=:|-]+$", ""), r"^(?:e|is)\s+", "")
    rest = F.nullif(F.trim(F.when(expression.rlike(named), rest)), F.lit(""))
    text = F.coalesce(word, let(rest, lambda r: F.when(~r.isin(COLOR_NAMES), name_like(r))))
    return let(text, lambda t: F.when(t.isNotNull(), _value("color", "text", text=t)))


def _pair(p: dict[str, Column]) -> Column:
    return p["pair"] if "pair" in p else brand_and_model(p["attribute_expression"], p["raw_input"], p["subject_kind"])


def attribute_value(p: dict[str, Column]) -> Column:
    """struct of dimension, kind, text, number, unit and year that a proposal states, or null; the first rule that fits.

    p: attribute_expression, raw_input, subject_kind, stable and classification (flags), and claim_dimension, claim_text,
    claim_number and claim_unit, which go before all text. A classification states no attribute. A column pair, if given, is
    `brand_and_model` of these, so that it is worked out once for this and for `companions`.
    """
    expression, raw = p["attribute_expression"], p["raw_input"]
    number = p["claim_number"].try_cast("decimal(38,6)")
    claimed = F.when(p["claim_dimension"].isNotNull(), F.when(number.isNotNull(), _value(p["claim_dimension"], "number", number=number, unit=p["claim_unit"])).when(F.coalesce(p["claim_text"], F.lit("")) != "", _value(p["claim_dimension"], "text", text=p["claim_text"])))
    read = F.struct(
        fold(F.coalesce(expression, F.lit(""))).alias("low"),
        fold(F.concat_ws(" ", F.coalesce(expression, F.lit("")), F.coalesce(raw, F.lit("")))).alias("surface"),
        _name(expression, raw).alias("name"),
        _pair(p).alias("pair"),
    )

    def judged(x: Column) -> Column:
        low, surface = x["low"], x["surface"]
        litres = let(quantity(F.when(surface.rlike("capacidad|capacity"), surface)), lambda q: F.when(q["unit"] == "L", q))
        year = F.when(low.rlike(r"^(19|20)\d{2}$"), low).when((low != "") & surface.rlike("ano|year"), F.nullif(F.regexp_extract(low, r"\b((?:19|20)\d{2})\b", 1), F.lit("")))
        dated = let(year.try_cast("int"), lambda y: F.when(y.isNotNull(), _value("model_year", "year", year=y)))
        return F.coalesce(x["name"], x["pair"]["brand"], x["pair"]["model"], litres, quantity(F.when(low != "", low).otherwise(surface)), dated, F.when(low != "", _color(low)))

    stated = F.coalesce(p["stable"], F.lit(False)) | expression.isNotNull()
    return F.when(~p["classification"], F.coalesce(claimed, F.when(stated, let(read, judged))))


def companions(p: dict[str, Column]) -> Column:
    """The brand and model that a text states together, as an array of values."""
    found = let(_pair(p), lambda x: F.when(x.isNotNull(), F.array_compact(F.array(x["brand"], x["model"]))))
    return F.coalesce(F.when(~p["classification"], found), F.array().cast(f"array<{VALUE}>"))


def is_current(p: dict[str, Column]) -> Column:
    """Whether a stated attribute holds now: not if the text or the proposal's tense is of the past."""
    surface = fold(F.concat_ws(" ", p["attribute_expression"], p["raw_input"]))
    return ~(surface.rlike(HISTORICAL) | F.coalesce(F.lower(p["tense"]).isin("era", "eram", "was"), F.lit(False)))


def dimension_in(text: Column, names: dict[str, str]) -> Column:
    """The dimension whose longest name stands in a text as a word; names: folded name to dimension."""
    ordered = sorted(names, key=lambda x: (-len(x), x))
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(ordered)})(?![\p{{L}}\p{{N}}_])"), 1)
    longest = F.array_min(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("name"))))
    return looked_up(longest["name"], names)
