"""What works by sheet alone: one exchange a query, and the same results as the operators on cells."""

import re

import pytest
from pyspark.sql import functions as F

import weftspark.plans.run_queries  # noqa: F401  registers its queries
from weftspark.operators import structure
from weftspark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "most"), [("block_chunks", 1), ("block_evidence", 1), ("block_records", 1), ("chosen_layout", 1), ("layout_candidates", 1), ("sheet_items", 1), ("sheet_wanted", 1)])
def test_rows_are_dealt_once(spark, name, most):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= most and not re.search("Exchange (rangepartitioning|SinglePartition)", plan)


def test_rows_give_what_cells_give(spark):
    sheets = {
        "a": ["", "x|No.|Item|Qty", "1|a|  b c", "|2.0|d", "n", "3|e", "Total", "|7|"],
        "b": ["no number here", "|y"],
        "c": ["1", "2", "2", "", "|||4"],
        "d": ["1.5|x", "| 9 |z"],
    }
    rows = spark.createDataFrame([(f, 0, "s", n + 1, c.split("|")) for f, s in sheets.items() for n, c in enumerate(s)], "file string, sheet_idx int, sheet string, row int, cells array<string>").withColumn("sha256", F.sha2("file", 256))
    none = {c: F.lit(v) for c, v in (("formula", ""), ("number_format", ""), ("visibility", "visible"), ("hidden", False))} | {c: F.lit(None).cast("int") for c in ("anchor_row", "anchor_col")}
    cells = rows.select("*", F.posexplode("cells").alias("col", "text")).drop("cells").withColumn("col", F.col("col") + 1).withColumns(none)
    found = structure.blocks(cells)
    items = structure.evidence(cells, found)
    recs = structure.records(found, items)
    same = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    numbered = structure.numbered_rows(rows)
    assert same(numbered, "scope_id", "first_row", "last_row") == same(recs.join(found.select("scope_id", "first_row", "last_row"), "scope_id"), "scope_id", "first_row", "last_row")
    columns = ("scope_id", "row", "evidence_ids", "record_id")
    assert same(structure.own_records(numbered), *columns) == same(recs, *columns)
    columns = ("scope_id", "row", "col", "ref", "original_text", "normalized_text", "evidence_id")
    assert same(structure.own_evidence(numbered), *columns) == same(items.join(recs, ["scope_id", "row"], "left_semi"), *columns)
    columns = ("file", "role", "scope_ids", "record_ids", "ranges", "candidate_id")
    assert same(structure.row_layouts(rows), *columns) == same(structure.layout_candidates(cells, found, recs, rows), *columns)


def test_parties_need_no_join(spark):
    plan = QUERIES["sheet_parties"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 1 and "Join" not in plan and "weftspark-" not in plan


def test_records_deal_rows_once_a_side(spark):
    plan = QUERIES["sheet_records"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2 and plan.count("Join") <= 1 and "weftspark-" not in plan
