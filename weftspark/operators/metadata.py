"""Order-level fields from the cells around a table: currency, ship date, customer and salesperson.

What a row tells is found in the row's arrays; plain aggregates put it together by sheet, in one pass and without a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.functions.text import let, parse_date
from weftspark.operators.parties import party_aggregates, settled, with_parties
from weftspark.operators.sheets import SHEET

# Currency codes and their names; marks that stand for a code by themselves or as a plain symbol.
CURRENCIES = {"USD": "美元", "CNY": "人民币", "RMB": "人民币", "EUR": "欧元", "GBP": "英镑", "JPY": "日元", "AED": "阿联酋迪拉姆", "SAR": "沙特里亚尔"}
MARKS = {"USD": ("US$",), "CNY": ("CN¥", "CN￥"), "JPY": ("JP¥", "JP￥")}
SYMBOLS = {"USD": ("$",), "EUR": ("€",), "GBP": ("£",), "CNY": ("¥", "￥"), "JPY": ("円",)}
HOLIDAY = r"(?i)\bCNY\s+(?:HOLIDAY|HOLIDAYS|PUBLIC\s+HOLIDAY|NEW\s+YEAR)\b"
SHIP_DATE_LABELS = (
    "planned shipping date", "plan shipping date", "shipping date", "shipment date", "delivery date", "requested delivery date", "etd", "ex-factory date", "ex factory date", "计划发货日期", "交货日期",
)
#: A format that marks a currency counts as a statement if so few columns have it.
FEW_COLUMNS = 3


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks], F.lit(False))


def _names_money(cells: Column, formats: Column) -> Column:
    """Whether a row may name a currency at all; rows that may not need no closer look."""
    symbols = tuple(m for marks in SYMBOLS.values() for m in marks)  # every mark of MARKS has one of them
    told = let(F.upper(F.array_join(cells, "\n")), lambda t: _any(t, (*CURRENCIES, *symbols)))
    return F.coalesce(told, F.lit(False)) | F.coalesce(let(F.array_join(formats, "\n"), lambda t: _any(t, symbols)), F.lit(False))


def _money(cells: Column, formats: Column) -> dict[str, Column]:
    """What a row says about the currency: the codes named by word and by symbol, a bit each, and the codes that formats mark
    with their columns."""
    bits = lambda holds: reduce(Column.__add__, [F.when(holds(code), F.lit(1 << k)).otherwise(0) for k, code in enumerate(CURRENCIES)])
    by_word = lambda t, code: t.rlike(rf"(?<![A-Z0-9]){code}(?![A-Z0-9])") | _any(t, MARKS.get(code, ()))
    explicit = let(F.transform(cells, lambda t: F.regexp_replace(F.upper(t), HOLIDAY, "")), lambda upper: bits(lambda code: F.exists(upper, lambda t: by_word(t, code))))
    marked = lambda f: let(F.upper(f), lambda form: F.coalesce(*[F.when(_any(form, m), F.lit(code)) for code, m in MARKS.items()]))
    plain = lambda f, code: _any(f, SYMBOLS[code]) & marked(f).isNull()
    symbol = bits(lambda code: (F.exists(cells, lambda t: _any(t, SYMBOLS[code])) | F.exists(formats, lambda f: plain(f, code))) if code in SYMBOLS else F.lit(False))
    columns = F.filter(F.transform(formats, lambda f, i: F.struct(marked(f).alias("code"), i.alias("col"))), lambda x: x["code"].isNotNull())
    told = F.exists(cells, lambda c: c != "") & _names_money(cells, formats)
    return {"_explicit": F.when(told, explicit).otherwise(0), "_symbol": F.when(told, symbol).otherwise(0), "_formats": F.when(told & (F.size(columns) > 0), columns)}


def _currency(explicit: Column, symbol: Column, formats: Column) -> list[Column]:
    """Currency and its status out of a sheet's bits and the arrays of its formats.  Codes outrank symbols; several of a kind are ambiguous."""
    few = lambda every, code: F.size(F.filter(every, lambda x: x["code"] == code)).between(1, FEW_COLUMNS)
    by_format = let(F.array_distinct(F.flatten(formats)), lambda every: reduce(Column.__add__, [F.when(few(every, code), F.lit(1 << k)).otherwise(0) for k, code in enumerate(CURRENCIES) if code in MARKS]))
    named = explicit.bitwiseOR(F.coalesce(by_format, F.lit(0)))
    chosen = F.when(named != 0, named).otherwise(symbol)
    names = F.create_map(*[F.lit(x) for k, name in enumerate(CURRENCIES.values()) for x in (1 << k, name)])
    number = F.bit_count(chosen)
    return [
        F.when(number == 1, names[chosen]).otherwise("").alias("currency"),
        F.when(number == 1, "normalized").when(number > 1, "ambiguous").otherwise("source_not_provided").alias("currency_status"),
    ]


def currency(rows: DataFrame) -> DataFrame:
    """Per sheet: currency and its status.  Codes outrank symbols; several of a kind are ambiguous."""
    found = rows.select(*SHEET, "cells", "formats").withColumns(_money(F.col("cells"), F.col("formats")))
    found = found.groupBy(*SHEET).agg(F.bit_or("_explicit").alias("_explicit"), F.bit_or("_symbol").alias("_symbol"), F.collect_set("_formats").alias("_formats"))
    return found.select(*SHEET, *_currency(F.col("_explicit"), F.col("_symbol"), F.col("_formats")))


def beside(labels: DataFrame, cells: DataFrame, by: list[str], at: str, place: str, reach: int) -> DataFrame:
    """labels with each cell up to `reach` places behind them and its distance: the range becomes an equi-join by exploding
    the few places.  labels have the column `at`, cells the column `place`."""
    places = labels.withColumn("distance", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn(place, F.col(at) + F.col("distance"))
    return places.join(cells, [*by, place])


def _may_be_labelled(cells: Column, labels: tuple[str, ...]) -> Column:
    """Whether a row may have one of the labels: a word of each, in lower case, must stand in it."""
    words = tuple(dict.fromkeys(max(label.split(" "), key=len) for label in labels))
    return F.coalesce(let(F.lower(F.array_join(cells, "\n")), lambda t: _any(t, words)), F.lit(False))


def labelled_values(cells: Column, labels: tuple[str, ...], reach: int = 4) -> Column:
    """The values at the labels of a row in their order (label_col, distance, value): behind a label's colon (distance 0), then
    those in the next `reach` cells."""
    pattern = rf"(?is)^\s*({'|'.join(label.replace(' ', r'\s+') for label in labels)})\s*(?:[:：]\s*(.*)|$)"
    places = F.filter(F.transform(cells, lambda t, i: F.when(t.rlike(pattern), i)), lambda i: i.isNotNull())
    near = lambda i: [F.trim(F.regexp_extract(F.get(cells, i), pattern, 2)), *[F.get(cells, i + k) for k in range(1, reach + 1)]]
    at = lambda i: F.array(*[F.struct(i.alias("label_col"), F.lit(k).alias("distance"), v.alias("value")) for k, v in enumerate(near(i))])
    found = F.filter(F.flatten(F.transform(places, at)), lambda v: F.coalesce(v["value"], F.lit("")) != "")
    return F.when(_may_be_labelled(cells, labels), found)


def _first_date(cells: Column, row: Column) -> Column:
    """The first date at a shipping label of a row, with its place in the sheet; null if none."""
    values = F.filter(labelled_values(cells, SHIP_DATE_LABELS), lambda v: F.contains(v["value"], F.lit("20")))  # as every year has
    dates = F.transform(values, lambda v: F.struct(row.alias("row"), v["label_col"].alias("label_col"), v["distance"].alias("distance"), parse_date(v["value"]).alias("date")))
    return F.get(F.filter(dates, lambda d: d["date"] != ""), F.lit(0))


def _ship_date(first: Column) -> list[Column]:
    return [F.coalesce(first["date"], F.lit("")).alias("ship_date"), F.when(first.isNotNull(), "normalized").otherwise("source_not_provided").alias("ship_date_status")]


def ship_date(rows: DataFrame) -> DataFrame:
    """Per sheet: the first date at a shipping label, YYYY-MM-DD."""
    found = rows.select(*SHEET, _first_date(F.col("cells"), F.col("row")).alias("_date")).groupBy(*SHEET).agg(F.min("_date").alias("_date"))
    return found.select(*SHEET, *_ship_date(F.col("_date")))


def metadata(rows: DataFrame, seller_marks: tuple[str, ...] = ()) -> DataFrame:
    """customer, currency, salesperson and ship_date of each sheet, each with its status.

    seller_marks are names by which the seller shows itself, where its block has no label.
    """
    cells, formats = F.col("cells"), F.col("formats")
    found = with_parties(rows.select(*SHEET, "row", "cells", "formats"), seller_marks, keep=_names_money(cells, formats) | _may_be_labelled(cells, SHIP_DATE_LABELS))
    found = found.withColumns(_money(cells, formats) | {"_date": _first_date(cells, F.col("row"))})
    whole = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # sorted so already
    found = found.withColumn("_formats", F.collect_set("_formats").over(whole))
    found = found.groupBy(*SHEET).agg(*party_aggregates(), F.bit_or("_explicit").alias("_explicit"), F.bit_or("_symbol").alias("_symbol"), F.first("_formats").alias("_formats"), F.min("_date").alias("_date"))
    return found.select(*SHEET, *_currency(F.col("_explicit"), F.col("_symbol"), F.col("_formats")), *_ship_date(F.col("_date")), *settled())
