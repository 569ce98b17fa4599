"""Providers, the extraction run, the vector index and what is told of sheets that nobody could read."""

import json

import pytest
from pyspark.sql import functions as F

from weftspark.operators import providers, structure
from weftspark.operators.resolution import BUSINESS_FIELDS
from weftspark.plans import extract
from weftspark.sources import vector_index
from weftspark.sources.documents import ContractError, by_line


def answer(*fields):
    return json.dumps({"fields": [{"field": f, "value": v, "interpretation": "direct", "references": ["e1"]} for f, v in fields]}, ensure_ascii=False)


@pytest.fixture(scope="module")
def work(spark):
    units = spark.createDataFrame([(f"u{i}", f"h{i}", f"r{i}", "s", ["e1"]) for i in range(5)], "unit_id string, unit_sha256 string, record_id string, scope_id string, evidence_ids array<string>")
    catalog = spark.createDataFrame([("e1", "s", "Acme blue 12")], "evidence_id string, scope_id string, text string")
    rules = spark.createDataFrame([(f"r{i}", f, "rule", True) for i in range(5) for f in BUSINESS_FIELDS], "record_id string, field string, value string, has_evidence boolean")
    answers = [("h0", answer(("客户", "Acme")), 0), ("h1", answer(("客户", "Acme")), 2), ("h2", answer(("客户", "Acme")), 9), ("h3", '{"fields": [{"field": "nonsense"}]}', 0)]
    return units, catalog, rules, providers.FakeProvider(spark.createDataFrame(answers, "unit_sha256 string, response string, fails int"))


def test_run_with_retries_and_fallback(work):
    units, catalog, rules, provider = work
    found = extract.extract(units, provider, rules, catalog)
    assert {r.unit_id: (r.outcome, r.attempts) for r in found.outcomes.collect()} == {"u0": ("succeeded", 1), "u1": ("succeeded", 3), "u2": ("failed", 3), "u3": ("failed", 1), "u4": ("failed", 1)}
    customers = {r.record_id: (r.value, r.status) for r in found.decisions.filter("field = '客户'").collect()}
    assert customers["r0"] == customers["r1"] == ("Acme", "ai_selected") and customers["r2"] == customers["r4"] == ("rule", "python_fallback")
    assert found.gate.filter("ready").count() == 5
    nothing = extract.extract(units, providers.NullProvider(), rules, catalog)
    assert nothing.decisions.filter("status <> 'python_fallback'").count() == 0


def test_cache_is_read_as_if_it_were_new(work, spark):
    units, _, _, provider = work
    first = extract.ask(units, provider)
    cache = extract.to_cache(units, first)
    assert {r.unit_sha256 for r in cache.collect()} == {"h0", "h1"}
    spoilt = cache.withColumn("response", F.when(F.col("unit_sha256") == "h1", "{}").otherwise(F.col("response")))
    again = {r.unit_id: (r.cached, r.outcome) for r in extract.ask(units, providers.NullProvider(), cache=spoilt).collect()}
    assert again["u0"] == (True, "succeeded") and again["u1"] == (False, "failed")


def test_index_positions_and_manifest(spark, tmp_path):
    documents = spark.createDataFrame([(f"M{i}", 100 - i, "x" if i % 3 else "") for i in range(40)], "material_code string, source_row long, product_category string")
    vectors = documents.select("material_code", F.array(*[(F.hash("material_code", F.lit(k)) % 100 / 100.0).cast("float") for k in range(4)]).alias("vector"))
    assert {k: v["rows"] for k, v in vector_index.write_index(documents, vectors, f"{tmp_path}/i").items()} == {"all": 40, "category": 26}
    rows = vector_index.read_index(spark, f"{tmp_path}/i", "all").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(40)) and [r.source_row for r in rows] == sorted(r.source_row for r in rows)
    hit = vector_index.search(vector_index.read_index(spark, f"{tmp_path}/i"), vectors.filter("material_code = 'M1'").select(F.lit(0).alias("query_id"), "vector"), 3)
    assert hit.count() == 3
    with pytest.raises(ContractError):
        vector_index.write_index(documents, vectors, f"{tmp_path}/i")
    spark.read.parquet(f"{tmp_path}/i/all").limit(1).withColumn("position", F.lit(7).cast("bigint")).write.mode("append").parquet(f"{tmp_path}/i/all")
    with pytest.raises(ContractError):
        vector_index.read_index(spark, f"{tmp_path}/i", "all")


def test_layouts_of_sheets(spark):
    def cell(file, row, col, text, anchor=None):
        return (file, 0, "S", "sha", row, col, text, "", "", "visible", False, *(anchor or (None, None)))

    cells = [cell("a", 2, 1, "No."), cell("a", 2, 2, "Item"), cell("a", 3, 1, "1"), cell("a", 3, 2, "x"), cell("a", 4, 1, "2"), cell("b", 1, 1, "notes"), cell("b", 2, 1, "Bank account 55"), cell("c", 2, 1, "No."), cell("c", 3, 1, "1", (2, 1))]
    df = spark.createDataFrame(cells, "file string, sheet_idx int, sheet string, sha256 string, row int, col int, text string, formula string, number_format string, visibility string, hidden boolean, anchor_row int, anchor_col int")
    geometry = spark.createDataFrame([("a", 0, [2], [3, 4]), ("b", 0, [1], [2]), ("c", 0, [2], [3])], "file string, sheet_idx int, header_rows array<int>, record_rows array<int>")
    found = structure.aligned_blocks(df, geometry)
    assert [(r.file, r.first_row, r.last_row, r.records) for r in found.collect()] == [("a", 3, 4, 2)]
    own = structure.evidence(df, found)
    recs = structure.records(found, own)
    unresolved = spark.createDataFrame([("a", 0), ("b", 0)], "file string, sheet_idx int")
    layouts = {r.file: r for r in structure.layout_candidates(df, found, recs, unresolved).collect()}
    assert layouts["a"].role == "order" and layouts["a"].ranges == ["A3:B4"] and len(layouts["a"].record_ids) == 2
    assert layouts["b"].role == "auxiliary" and layouts["b"].ranges == ["A1:A2"] and layouts["b"].candidate_id.startswith("layout:")
    assert providers.first_layout(structure.layout_candidates(df, found, recs, unresolved)).count() == 1
    assert [(r.file, r.excerpt) for r in structure.bounded_excerpts(df).filter("file = 'b'").collect()] == [("b", "notes")]
    assert {r.file: (r.blocks, r.records) for r in structure.diagnostics(df, found, own, recs).collect()} == {"a": (1, 2), "b": (0, 0), "c": (0, 0)}


def test_artifacts_by_line(spark):
    rows = spark.createDataFrame([("1", "a"), (" 2 ", "b"), ("2.0", "c"), ("3", "d")], "line string, v string")
    assert sorted(r.v for r in by_line(rows, spark.createDataFrame([("2",)], "line string")).collect()) == ["b", "c"]
