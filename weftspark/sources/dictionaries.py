"""The reference dictionaries: three tables of fixed bounds out of two workbooks, pinned by their hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators.sheets import fill_merged
from weftspark.session import stored
from weftspark.sources.xlsx import workbook_cells

# Sheets, header words and last rows of the dictionaries.
RULES = ("被套 提取规则", {"字段名": "field_name", "可能值": "standard_value", "关键描述": "rule_description", "默认值规则": "default_rule", "补充说明": "notes"}, 36)
FABRICS = ("面料类价格表", {"面料品类": "fabric_family", "面料": "fabric_standard", "颜色": "color_standard", "涤棉成份": "composition_raw", "密度": "density"}, 76)
STYLES = (
    "Sheet1",
    {"被套款式": "standard_name", "飞边 (Flange)": "flange", "系带 (Tie)": "tie", "拉链 (Zipper)": "zipper", "是否口袋式 (Has Pocket)": "has_pocket", "是否迎宾式 (Is Welcome Style)": "is_welcome_style", "其他款式结构 (Other Structure)": "other_structure", "备注尺寸 (Dimensions)": "dimensions"},
    106,
)


class DictionaryError(ValueError):
    """A dictionary is not the approved one."""


@dataclass(frozen=True)
class Dictionaries:
    rules: DataFrame
    fabrics: DataFrame
    styles: DataFrame


def _table(cells: DataFrame, sheet: str, columns: dict[str, str], last_row: int) -> DataFrame:
    own = cells.filter((F.col("sheet") == sheet) & (F.col("col") <= len(columns)) & (F.col("row") <= last_row))
    header = {r["col"]: r["text"] for r in own.filter("row = 1").select("col", "text").collect()}  # a handful of cells
    if any(word.lower() not in header.get(i, "").lower() for i, word in enumerate(columns, 1)):
        raise DictionaryError(f"unexpected header in {sheet}: {header}")
    value = [F.coalesce(F.max(F.when(F.col("col") == i, F.col("text"))), F.lit("")).alias(name) for i, name in enumerate(columns.values(), 1)]
    rows = cells.sparkSession.range(2, last_row + 1).select(F.col("id").cast("int").alias("source_row"))
    return rows.join(own.filter("row > 1").groupBy(F.col("row").alias("source_row")).agg(*value), "source_row", "left").fillna("")


def load(spark: SparkSession, rules_path: str, styles_path: str, rules_sha256: str, styles_sha256: str) -> Dictionaries:
    """Rules, fabrics and styles; an error if a file's hash or a header is not the expected one."""
    tables = []
    for path, want, sheets in ((rules_path, rules_sha256, (RULES, FABRICS)), (styles_path, styles_sha256, (STYLES,))):
        cells = stored(fill_merged(workbook_cells(spark, path)), "dictionary")
        found = {r["sha256"] for r in cells.select("sha256").distinct().collect()}
        if found != {want.lower()}:
            raise DictionaryError(f"{path}: expected {want}, found {sorted(found)}")
        tables += [_table(cells, *sheet) for sheet in sheets]
    return Dictionaries(*tables)
