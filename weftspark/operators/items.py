"""Order lines out of table rows: column choice by header, product filter, inherited descriptions, the formal record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.contracts import FORMAL_FIELDS, FORMAL_SCHEMA
from weftspark.functions import fields as N
from weftspark.functions.text import column_letters, let, quantity, text_of
from weftspark.operators.sheets import SHEET, carried

# The header words that name each column, in order of preference, and the column without any (None: none).
COLUMN_WORDS = {
    "item_name": (("item", "items", "product", "品名"), 1),
    "description": (("description", "描述"), 1),
    "size": (("after wash size", "delivery size", "dimension", "size", "w*l", "w x l", "wxl", "尺寸", "洗涤尺寸", "交货尺寸"), 2),
    "specification": (("specification", "工艺", "fabric", "description", "描述"), 3),
    "quantity": (("total qty", "qty", "quantity", "数量"), 4),
    "remarks": (("remarks", "remark", "notes", "note", "备注"), None),
    "line_number": (("no.", "no", "number", "line", "序号"), 0),
}
# Products that are wanted, and those that are not whatever else a text says.
WANTED = ("duvet cover", "duvetcover", "dubet cover", "quilt cover", "comforter cover")
UNWANTED = ("bed sheet", "bedsheet", "flat sheet", "flatsheet", "pillow", "towel", "blanket", "bath mat", "bathrobe", "bath robe", "mattress protector", "duvet insert", "duvet inner", "down duvet")


def named_places(headers: Column, columns: dict[str, tuple[str, ...]]) -> Column:
    """For each column the zero-based places whose header has one of its words, by word, then by place."""
    low = F.transform(headers, lambda h: F.trim(F.regexp_replace(F.lower(h), r"(?U)\s+", " ")))

    def placed(low: Column) -> Column:
        places = lambda w: F.array_compact(F.transform(low, lambda h, i: F.when(F.contains(h, F.lit(w)), i)))
        return F.struct(*[F.array_distinct(F.concat(*[places(w) for w in words])).alias(n) for n, words in columns.items()])

    return let(low, placed)


def pick_column(cells: Column, headers: Column, words: tuple[str, ...], fallback: int | None) -> Column:
    """Zero-based place of the value: by word, then by column, the first that is filled; else the fallback column; null if
    the row has neither."""
    return first_filled(cells, named_places(headers, {"all": words})["all"], fallback)


def first_filled(cells: Column, places: Column, fallback: int | None) -> Column:
    first = F.get(F.filter(places, lambda i: F.coalesce(F.get(cells, i), F.lit("")) != ""), F.lit(0))
    return first if fallback is None else F.coalesce(first, F.when(F.size(cells) > fallback, fallback))


def mentions(text: Column, products: tuple[str, ...]) -> Column:
    """Whether a text names one of the products, hyphens and spaces aside."""
    return let(_compact(text), lambda c: _names(c, products))


def _compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(text)), r"(?U)[\s-]+", "")


def _names(compact: Column, products: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(compact, F.lit(p)) for p in dict.fromkeys(p.replace(" ", "") for p in products)])


def is_cover(text: Column) -> Column:
    return let(_compact(text), lambda c: _names(c, WANTED) & ~_names(c, UNWANTED))


def raw_items(table: DataFrame) -> DataFrame:
    """One row per table row: the named columns with the cells they came from, descriptions inherited from the row above."""
    c = F.col("cells")
    # what follows from the headers alone is found in one row of each sheet and handed to the others
    sheet = Window.partitionBy(*SHEET)
    table = table.withColumn("_nth", F.row_number().over(sheet.orderBy("row"))).withColumn("_own", F.when(F.col("_nth") == 1, named_places(F.col("headers"), {n: words for n, (words, _) in COLUMN_WORDS.items()})))
    table = table.withColumn("_places", F.first("_own", ignorenulls=True).over(sheet)).drop("_nth", "_own")
    at = {name: first_filled(c, F.col("_places")[name], fallback) for name, (_, fallback) in COLUMN_WORDS.items()}
    value = lambda place: F.coalesce(F.get(c, place), F.lit(""))
    rows = table.withColumns({f"_at_{n}": p for n, p in at.items()}).drop("_places")
    named = value(F.col("_at_item_name")) != ""
    rows = rows.withColumn("_at_item_name", F.when(named, F.col("_at_item_name")).otherwise(F.col("_at_description"))).drop("_at_description")
    names = [n for n in COLUMN_WORDS if n != "description"]
    cell = lambda n: F.when(F.col(f"_at_{n}").isNotNull(), F.concat(column_letters(F.col(f"_at_{n}") + 1), F.col("row")))
    rows = rows.withColumns({n: value(F.col(f"_at_{n}")) for n in names} | {f"{n}_cell": cell(n) for n in names}).drop(*[f"_at_{n}" for n in names])
    order = Window.partitionBy(*SHEET).orderBy("row")
    fresh = (F.lag("row").over(order).isNull()) | (F.col("row") != F.lag("row").over(order) + 1) | (F.col("section_note") != "")
    rows = rows.withColumn("_island", F.sum(F.when(fresh, 1).otherwise(0)).over(order))
    own = F.col("specification") != ""
    source = carried(F.when(own, F.struct("specification", "specification_cell")), [*SHEET, "_island"], "row")
    # the first row of an island follows nothing, so it inherits nothing; a carried text must name the product
    inherits = ~own & source.isNotNull() & is_cover(source["specification"])
    rows = rows.withColumns({"_source": source, "inherited": F.coalesce(inherits, F.lit(False))})
    return rows.withColumns(
        {
            "specification": F.when(F.col("inherited"), F.col("_source.specification")).otherwise(F.col("specification")),
            "specification_cell": F.when(F.col("inherited"), F.col("_source.specification_cell")).otherwise(F.col("specification_cell")),
        }
    ).drop("_source", "_island")


def combined_text() -> Column:
    return F.concat_ws(" ", *[F.when(F.col(n) != "", F.col(n)) for n in ("item_name", "size", "specification", "remarks", "section_note")])


def wanted_items(items: DataFrame) -> DataFrame:
    """Rows of the wanted product: the item's name decides, the whole text where the name says nothing."""
    named = let(_compact(F.col("item_name")), lambda c: F.when(_names(c, UNWANTED), -1).when(_names(c, WANTED), 1).otherwise(0))
    found = items.withColumns({"text": combined_text(), "_named": named})
    return found.filter((F.col("_named") == 1) | ((F.col("_named") == 0) & is_cover(F.col("text")))).drop("_named")


def formal_records(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """The 20 fields of every wanted item (struct `record`) and the status of every field (map `statuses`).

    metadata has, per sheet, customer, currency, salesperson, ship_date and their statuses.
    """
    rows = wanted_items(items).join(metadata, SHEET)
    text = F.col("text")
    value = {
        "客户": F.col("customer"), "币种": F.col("currency"), "业务员": F.col("salesperson"), "表头备注": F.lit(""), "行号": F.col("line_number"), "物料编码": F.lit(""),
        "物料名称": F.when(F.col("customer") != "", F.concat(F.col("customer"), F.lit(" 被套"))).otherwise("被套"),
        "规格": N.order_size(F.col("size"), F.col("specification")), "颜色": N.order_color(text), "面料": N.order_fabric(text), "面料-涤棉成分": N.order_composition(text),
        "款式": N.order_style(text), "加标方式": F.lit("客标"), "尺寸类型": N.order_size_type(text), "数量": quantity(F.col("quantity")), "行备注": N.order_note(text),
        "计划发货日期": F.col("ship_date"), "包装方式": F.lit(N.PACKAGING), "是否绣花": N.order_embroidery(text), "相似分数": F.lit(0.0),
    }
    record = F.struct(*[F.coalesce(v, F.lit("")).alias(f) if f != "相似分数" else v.alias(f) for f, v in value.items()])
    rows = rows.withColumn("record", let(record, lambda r: r))  # computed once, though statuses look at many of its fields
    # The words by which a text speaks of a field at all.
    signal = {
        "颜色": r"(?i)\bwhite\b|\bgrey\b|\bgray\b|\bblue\b|\bred\b|\byellow\b|白色|灰色|蓝色|红色|黄色",
        "面料": r"(?i)cotton|coton|poly(?:ester)?|sateen|satin|twill|stripe|plain\s+weave|thread\s+count|\b\d{3}\s*TC\b|贡缎|缎条|斜纹|平布",
        "面料-涤棉成分": r"(?i)\d{1,3}\s*%|cotton|coton|poly(?:ester)?|涤棉|全棉",
        "款式": r"(?i)\bbag\b|envelope|flap|flange|hem|opening|hand\s+holes?|zip(?:per)?|ties?|口袋|信封|飞边|开口|手洞|拉链|系带",
        "加标方式": r"(?i)\b(?:label|tag)\b|唛标|商标",
        "尺寸类型": r"(?i)before\s+wash|delivery\s+size|after\s*wash(?:ing)?|洗涤尺寸|交货尺寸",
        "是否绣花": r"(?i)\b(?:no|without)?\s*embroider(?:y|ed|ing)\b|绣花|刺绣",
    }
    known = lambda f: F.col("record")[f] != ""
    explicit = lambda f: F.when(text.rlike(signal[f]), "normalized").otherwise("defaulted")
    read = lambda f, spoken: F.when(known(f), "normalized").when(spoken, "unrecognized").otherwise("source_not_provided")
    status = {
        "客户": F.col("customer_status"), "币种": F.col("currency_status"), "业务员": F.col("salesperson_status"), "表头备注": F.lit("source_not_provided"), "行号": F.lit("extracted"),
        "物料编码": F.lit("not_implemented"), "物料名称": F.lit("derived"), "规格": read("规格", F.col("size") != ""), "颜色": explicit("颜色"),
        **{f: read(f, text.rlike(signal[f])) for f in ("面料", "面料-涤棉成分", "款式")}, "加标方式": explicit("加标方式"), "尺寸类型": explicit("尺寸类型"), "数量": F.lit("extracted"),
        "行备注": F.when(known("行备注"), "derived").otherwise("source_not_provided"), "计划发货日期": F.col("ship_date_status"), "包装方式": F.lit("defaulted"),
        "是否绣花": explicit("是否绣花"), "相似分数": F.lit("not_implemented"),
    }
    entries = [x for f in FORMAL_FIELDS for x in (F.lit(f), status[f])]
    cells = F.create_map(*[x for n in ("line_number", "item_name", "size", "specification", "quantity", "remarks") for x in (F.lit(n), F.col(f"{n}_cell"))])
    return rows.select(*SHEET, "sheet", "row", F.col("record").cast(FORMAL_SCHEMA).alias("record"), F.create_map(*entries).alias("statuses"), cells.alias("source_cells"), "inherited", "text")
