"""Workbooks to formal records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.contracts import PARSE_STATUSES, WARNING_STATUSES
from weftspark.operators import items, metadata, sheets
from weftspark.operators.shadow import FIELDS
from weftspark.operators.summary import status_matrix
from weftspark.session import stored
from weftspark.sources.xlsx import workbook_cells


def parse_cells(cells: DataFrame, seller_marks: tuple[str, ...] = ()) -> DataFrame:
    """Records with statuses of every wanted line in the cells of many workbooks."""
    rows = stored(sheets.grid(sheets.fill_merged(sheets.choose_sheet(cells))), "grid")
    return items.formal_records(items.raw_items(sheets.table_rows(rows)), metadata.metadata(rows, seller_marks))


def parse_workbooks(spark: SparkSession, path: str, seller_marks: tuple[str, ...] = ()) -> DataFrame:
    return parse_cells(stored(workbook_cells(spark, path), "cells"), seller_marks)


def status_report(records: DataFrame) -> DataFrame:
    """Counts of every status per field, with the number of warnings."""
    long = records.select(F.explode("statuses").alias("field", "status"))
    return status_matrix(long, "field", "status", PARSE_STATUSES).withColumn("warnings", sum((F.col(s) for s in WARNING_STATUSES[1:]), F.col(WARNING_STATUSES[0])))


def dictionary_evidence(records: DataFrame) -> DataFrame:
    """What the dictionaries compare: record_id, field, source_text, value, value_status and source_cells of the ten fields."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col("record")[f].cast("string").alias("value"), F.col("statuses")[f].alias("value_status")) for f in FIELDS])
    cells = [F.col("source_cells")[n] for n in ("item_name", "size", "specification", "remarks")]
    long = records.select(F.concat_ws("#", "file", "row").alias("record_id"), F.explode(fields).alias("f"), F.coalesce("text", F.lit("")).alias("source_text"), F.array_compact(F.array(*cells)).alias("source_cells"))
    return long.select("record_id", "f.field", "source_text", F.coalesce("f.value", F.lit("")).alias("value"), F.coalesce("f.value_status", F.lit("")).alias("value_status"), "source_cells")
