"""Text normalisation as column expressions; '' is the missing value throughout."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it; keeps generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(value: Column) -> Column:
    """The value as text, '' for null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def collapse(value: Column) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(text_of(value), r"(?U)\s+", " "))


def clean_text(value: Column) -> Column:
    """Line breaks become spaces and runs of two or more spaces one; a lone tab or the like stays."""
    joined = F.regexp_replace(text_of(value), r"\r\n|\n", " ")
    return F.regexp_replace(F.regexp_replace(joined, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if v is not None else "")


def nfkc(value: Column) -> Column:
    """Compatibility composition; Spark has no function for it, so only texts beyond ASCII go through Python."""
    text = text_of(value)
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))


def master_text(value: Column) -> Column:
    """NFKC with collapsed white space."""
    return collapse(nfkc(value))


def audit_text(value: Column) -> Column:
    """master_text in lower case."""
    return F.lower(master_text(value))


# Texts that stand for nothing.
NOTHING = ("", "/", "-", "--", "－", "n/a", "na", "none", "null")


def optional_text(value: Column) -> Column:
    """clean_text, but '' where it stands for nothing."""
    return let(clean_text(value), lambda cleaned: F.when(F.lower(cleaned).isin(*NOTHING), "").otherwise(cleaned))


def plain_number(value: Column) -> Column:
    """A double as text without trailing zeros or a point at the end."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(value.cast("decimal(38,10)").cast("string"), r"\.?0+$", ""))


def quantity(value: Column) -> Column:
    """A whole number loses its fraction; any other text stays."""

    def written(cleaned: Column) -> Column:
        number = F.when(cleaned.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), cleaned.try_cast("double"))
        return let(number, lambda n: F.when(n.isNotNull() & (n == F.floor(n)), n.cast("decimal(38,0)").cast("string")).otherwise(cleaned))

    return let(clean_text(value), written)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words is part of the text."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def first_case(*cases: tuple[Column, str | Column], otherwise: str | Column = "") -> Column:
    """The value of the first case that holds."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def ellipsis(text: Column, limit: int = 180) -> Column:
    """At most limit characters, the last one a mark of omission where something is left out."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…"))).otherwise(text)


def quote_position(quote: Column, snapshots: Column) -> Column:
    """Where a quotation first stands in an array of texts, white space collapsed and case ignored: which text, and the
    zero-based start in it; null where it stands nowhere or is empty."""
    wanted = F.lower(collapse(quote))
    places = F.transform(snapshots, lambda s, i: F.struct(i.alias("snapshot"), (F.position(wanted, F.lower(collapse(s))) - 1).alias("start")))
    return F.when(wanted != "", F.get(F.filter(places, lambda p: p["start"] >= 0), F.lit(0)))


def column_letters(number: Column) -> Column:
    """Spreadsheet letters of a one-based column number up to 702."""
    zero = number - 1
    letter = lambda n: F.char(n + 65)
    return F.when(zero < 26, letter(zero)).otherwise(F.concat(letter(F.floor(zero / 26) - 1), letter(zero % 26)))


def parse_date(value: Column) -> Column:
    """YYYY-MM-DD out of a text: year first, else the first number is the month if it can be; the calendar isn't asked."""
    ymd, dmy = r"\b(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})\b", r"\b(\d{1,2})[-/](\d{1,2})[-/](20\d{2})\b"
    parts = lambda text: F.struct(*[F.regexp_extract(text, p, k).alias(f"{name}{k}") for name, p in (("y", ymd), ("d", dmy)) for k in (1, 2, 3)])
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")

    def written(p: Column) -> Column:
        month_first = p["d1"].cast("int") <= 12
        return first_case(
            (p["y1"] != "", F.concat_ws("-", p["y1"], two(p["y2"]), two(p["y3"]))),
            ((p["d1"] != "") & month_first, F.concat_ws("-", p["d3"], two(p["d1"]), two(p["d2"]))),
            (p["d1"] != "", F.concat_ws("-", p["d3"], two(p["d2"]), two(p["d1"]))),
        )

    return let(let(optional_text(value), parts), written)


def calendar_date(value: Column) -> Column:
    """parse_date, but null where the calendar has no such day."""
    return let(parse_date(value), lambda parsed: F.when(parsed != "", F.date_format(F.to_timestamp(F.try_to_timestamp(parsed, F.lit("yyyy-MM-dd"))), "yyyy-MM-dd")))
