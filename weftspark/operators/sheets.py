"""From cells to a table: sheet choice, merged values, grid, header, body, and blocks of numbered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.functions.text import let

SHEET = ["file", "sheet_idx"]
MOST_COLUMNS = 20
# Words of a header row, and the words that a footer row begins with.
HEADER_WORDS = ("no", "item", "items", "description", "specification", "size", "dimension", "qty", "quantity", "unit price", "amount", "remark", "remarks", "序号", "品名", "描述", "规格", "工艺", "尺寸", "数量")
FOOTER_WORDS = ("total", "subtotal", "grand total", "total value", "amount due", "bank", "payment", "terms", "signature", "seller", "合计", "总计", "付款")


def choose_sheet(cells: DataFrame) -> DataFrame:
    """The cells of each file's order sheet: named pi-update, else pi, else the first with pi in its name, else the first."""
    name = F.lower("sheet")
    plain = F.regexp_replace(name, r"(?U)[^\p{Alnum}]", "")
    priority = F.when(name == "pi-update", 0).when(name == "pi", 1).when(F.contains(plain, F.lit("pi")), 2).otherwise(3)
    chosen = cells.groupBy("file").agg(F.min_by("sheet_idx", F.struct(priority, F.col("sheet_idx"))).alias("sheet_idx"))
    return cells.join(chosen, SHEET, "left_semi")


def fill_merged(cells: DataFrame) -> DataFrame:
    """Every empty cell of a merged range takes the range's first cell's text."""
    first = cells.select(*SHEET, F.col("row").alias("anchor_row"), F.col("col").alias("anchor_col"), F.col("text").alias("_first"))
    filled = cells.join(first, [*SHEET, "anchor_row", "anchor_col"], "left")
    return filled.withColumn("text", F.when((F.col("text") == "") & F.col("_first").isNotNull(), F.col("_first")).otherwise(F.col("text"))).drop("_first")


def grid(cells: DataFrame, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """One row per sheet row up to the last filled one: cells and formats as arrays, trimmed to the last filled column."""
    inside = cells.filter(F.col("col") <= most_columns)
    size = inside.filter("text <> ''").groupBy(*SHEET).agg(F.max("row").alias("last_row"), F.max("col").alias("width"))
    rows = inside.groupBy(*SHEET, "row").agg(
        F.any_value("sheet").alias("_sheet"), F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_texts"), F.map_from_entries(F.collect_list(F.struct("col", "number_format"))).alias("_formats")
    )
    names = inside.groupBy(*SHEET).agg(F.first("sheet").alias("sheet"))
    every = size.join(names, SHEET).withColumn("row", F.explode(F.sequence(F.lit(1), "last_row"))).join(rows, [*SHEET, "row"], "left")
    dense = lambda m: F.transform(F.sequence(F.lit(1), "width"), lambda c: F.coalesce(F.try_element_at(m, c), F.lit("")))
    return every.select(*SHEET, "sheet", "row", dense(F.col("_texts")).alias("cells"), dense(F.col("_formats")).alias("formats"))


def carried(value: Column, by: list[str], order: str) -> Column:
    """The last value that is not null up to a row, among the rows that agree in `by`."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order))


def with_islands(df: DataFrame, by: list[str], number: str, name: str = "_island") -> DataFrame:
    """df, whose numbers are unique, with a value that rows of consecutive numbers share."""
    return df.withColumn(name, F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number)))


def header_score(cells: Column, words: tuple[str, ...] = HEADER_WORDS) -> Column:
    """How many header words are part of some cell."""
    joined = F.coalesce(F.lower(F.array_join(cells, "\n")), F.lit(""))  # no word has a line break, so none is found across two cells
    return let(joined, lambda t: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)))


def is_numbered(cells: Column) -> Column:
    return F.coalesce(F.trim(F.get(cells, F.lit(0))).rlike(r"^\d+(\.0)?$"), F.lit(False))


def is_led_by_number(cells: Column) -> Column:
    """Whether the first filled cell is a number."""
    first = F.get(F.filter(F.transform(cells, F.trim), lambda t: t != ""), F.lit(0))
    return F.coalesce(first.rlike(r"^\d+(\.0)?$"), F.lit(False))


def is_blank(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: F.trim(c) != "")


def row_text(cells: Column) -> Column:
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")


def is_footer(cells: Column) -> Column:
    first = F.lower(F.coalesce(F.get(F.filter(F.transform(cells, F.trim), lambda c: c != ""), F.lit(0)), F.lit("")))
    begins = lambda text: let(text, lambda t: reduce(Column.__or__, [F.startswith(t, F.lit(w)) for w in FOOTER_WORDS]))
    return begins(first) | begins(F.lower(row_text(cells)))


def first_header_row(whole: Window) -> Column:
    """Of rows with score and numbered, the first of their sheet (the window `whole`) with a score of three, else the row
    above the first numbered one."""
    by_score = F.min(F.when(F.col("score") >= 3, F.col("row"))).over(whole)
    by_number = F.greatest(F.min(F.when(F.col("numbered"), F.col("row"))).over(whole) - 1, F.lit(1))
    return F.coalesce(by_score, by_number)


def locate_header(rows: DataFrame) -> DataFrame:
    """rows with first and last header row of their sheet: a score of three, or the row above the first numbered one; up to
    two rows behind it that score two go on with it."""
    c = F.col("cells")
    marked = rows.withColumns({"score": header_score(c), "numbered": is_numbered(c), "blank": is_blank(c)})
    order = Window.partitionBy(*SHEET).orderBy("row")
    goes_on = (F.col("score") >= 2) & ~F.col("blank") & ~F.col("numbered")
    marked = marked.withColumns({"_next": F.coalesce(F.lead(goes_on, 1).over(order), F.lit(False)), "_after": F.coalesce(F.lead(goes_on, 2).over(order), F.lit(False))})
    whole = Window.partitionBy(*SHEET)
    marked = marked.withColumn("header_first", first_header_row(whole))
    length = F.when(F.col("_next") & F.col("_after"), 2).when(F.col("_next"), 1).otherwise(0)
    last = F.max(F.when(F.col("row") == F.col("header_first"), F.col("row") + length)).over(whole)
    return marked.withColumn("header_last", last).filter("header_first is not null").drop("_next", "_after")


def combine_headers(rows: DataFrame) -> DataFrame:
    """One row per sheet: the header texts of each column, top to bottom, a text that repeats (case ignored) once."""
    header = rows.filter("row between header_first and header_last").groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("_rows"))
    return header.select(*SHEET, _combined(F.col("_rows")).alias("headers"))


def _combined(rows: Column) -> Column:
    """The header texts out of a header's rows (row, cells), which stand in their order."""
    column = lambda i: F.filter(F.transform(rows, lambda r: F.get(r["cells"], i)), lambda t: F.coalesce(t, F.lit("")) != "")
    once = lambda parts: F.aggregate(
        parts, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.concat(kept, F.array(t)))
    )
    width = F.size(rows[0]["cells"])
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(F.size(column(i)) > 0, F.array_join(once(column(i)), " ")).otherwise(F.concat(F.lit("Column "), i + 1)))


def table_rows(rows: DataFrame) -> DataFrame:
    """The numbered rows of each sheet's table with its headers and section_note: the last other text since the row before.

    The table ends at the first footer or second blank row in a run after the first numbered row.
    """
    order = Window.partitionBy(*SHEET).orderBy("row")
    whole = Window.partitionBy(*SHEET)
    c = F.col("cells")
    body = locate_header(rows).withColumn("footer", is_footer(c) & ~F.col("blank"))
    # the header's texts are combined in one row of each sheet and handed to the others
    body = body.withColumn("_rows", F.array_sort(F.collect_list(F.when(F.col("row").between(F.col("header_first"), F.col("header_last")), F.struct("row", "cells"))).over(whole)))
    body = body.withColumn("_headers", F.when(F.col("row") == F.col("header_first"), _combined(F.col("_rows")))).drop("_rows")
    body = body.withColumn("headers", F.first("_headers", ignorenulls=True).over(whole)).filter("headers is not null").drop("_headers")
    below = F.col("row") > F.col("header_last")
    item = below & F.col("numbered") & ~F.col("footer")
    body = body.withColumn("item", item)
    body = body.withColumn("first_item", F.min(F.when(F.col("item"), F.col("row"))).over(whole))
    twice = F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(False)) & (F.col("row") - 1 > F.col("first_item"))
    body = body.withColumn("_twice", twice)
    ends = F.min(F.when((F.col("row") > F.col("first_item")) & (F.col("footer") | F.col("_twice")), F.col("row"))).over(whole)
    body = body.withColumn("end_row", F.coalesce(ends, F.lit(2**31 - 1))).filter((F.col("row") > F.col("header_last")) & (F.col("row") < F.col("end_row")))
    note = F.when(~F.col("item") & ~F.col("blank") & ~F.col("footer"), row_text(c))
    before = F.coalesce(F.sum(F.col("item").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = body.withColumns({"_note": note, "_part": before})
    items = body.withColumn("section_note", F.coalesce(carried(F.col("_note"), [*SHEET, "_part"], "row"), F.lit(""))).filter("item")
    return items.select(*SHEET, "sheet", "row", "cells", "headers", "section_note")


def numbered_blocks(rows: DataFrame) -> DataFrame:
    """Runs of consecutive rows whose first filled cell is a number: first and last row, and the header rows (score two)
    among the three rows above."""
    marked = rows.withColumns({"_numeric": is_led_by_number(F.col("cells")), "_score": header_score(F.col("cells"))})
    above = Window.partitionBy(*SHEET).orderBy("row").rangeBetween(-3, -1)
    marked = marked.withColumn("_headers", F.collect_list(F.when(F.col("_score") >= 2, F.col("row"))).over(above))
    numeric = with_islands(marked.filter("_numeric"), SHEET, "row")
    return numeric.groupBy(*SHEET, "_island").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count(F.lit(1)).alias("records"), F.min_by("_headers", "row").alias("header_rows")).drop("_island")
