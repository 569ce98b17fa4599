"""Strict readers and JSON contracts."""

import json

import pytest
from pyspark.sql import functions as F

from tests.workbooks import workbook
from weftspark.contracts import FORMAL_FIELDS
from weftspark.operators import contracts
from weftspark.sources import documents
from weftspark.sources.xlsx import workbook_cells

SCHEMA = {
    "type": "object", "required": ("name", "items"),
    "properties": {"name": {"type": "string", "min_length": 2}, "kind": {"type": "string", "enum": ("a", "b")}, "n": {"type": "integer", "minimum": 1}, "items": {"type": "array", "min_items": 1, "items": {"type": "object", "required": ("id",), "properties": {"id": {"type": "integer"}}}}},
}


def test_json_contract(spark):
    good = {"name": "xy", "kind": "a", "n": 1, "items": [{"id": 1}]}
    cases = [
        (good, []), ({**good, "extra": 1, "z": 2}, ["$: unknown keys extra,z"]), ({"items": [{"id": 1}]}, ["$.name: missing"]), ({**good, "kind": "c"}, ["$.kind: value not allowed"]), ({**good, "n": 0}, ["$.n: too small"]),
        ({**good, "n": 1.5}, ["$.n: integer expected"]), ({**good, "name": "x"}, ["$.name: too short"]), ({**good, "name": 5}, ["$.name: string expected"]), ({**good, "items": []}, ["$.items: too few items"]),
        ({**good, "items": [{"id": 1}, {"id": "x"}]}, ["$.items[].id: integer expected"]), ({**good, "items": [{}]}, ["$.items[].id: missing"]), ([], ["$: object expected"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(98, "{"), (99, None)], "i int, j string")
    got = {}
    for r in contracts.violations(df, ["i"], "j", SCHEMA).collect():
        got.setdefault(r.i, []).append(r.violation)
    assert [got.get(i, []) for i in range(len(cases))] == [w for _, w in cases] and got[98] == got[99] == ["$: no JSON"]
    told = spark.range(1).select(contracts.safe_diagnostic(F.lit("parse"), F.lit("secret words"), F.lit("$.a[12].b"), ("parse",), ("shape",)).alias("d")).first().d
    assert tuple(told) == ("parse", "unknown", "$.a[].b")


def test_document_lines(spark, tmp_path):
    def read(*lines):
        (tmp_path / "d.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        return documents.read_documents(spark, f"{tmp_path}/d.jsonl")

    line = lambda i, **m: json.dumps({"id": i, "text": "t", "metadata": {"source_row": 2} | m})
    assert read(line("a"), line("b")).count() == 2
    for bad in ((line("a"), line("a")), (line("a"), "", line("b")), ("{}",), (line("a", source_row="x"),), ("no json",)):
        with pytest.raises(documents.ContractError):
            read(*bad)


def test_paired_records(spark, tmp_path):
    record = dict.fromkeys(FORMAL_FIELDS[:-1], "") | {"相似分数": 0.0}

    def write(results, reports):
        for folder, files in (("r", results), ("p", reports)):
            (tmp_path / folder).mkdir(exist_ok=True)
            for old in (tmp_path / folder).iterdir():
                old.unlink()
            for name, value in files.items():
                (tmp_path / folder / name).write_text(json.dumps(value, ensure_ascii=False))
        return documents.paired_records(spark, f"{tmp_path}/r", f"{tmp_path}/p")

    rows = lambda *n: [record | {"行号": str(i)} for i in n]
    report = lambda *n: {"records": [{"行号": str(i), "fields": {"颜色": {"status": "defaulted", "value": "x"}}} for i in n]}
    got = write({"a.json": rows(1, 2), "b.json": rows(7)}, {"a_parse_report.json": report(1, 2), "b_parse_report.json": report(7)}).collect()
    assert sorted((r.stem, r.position, r.record["行号"], r.line) for r in got) == [("a", 0, "1", "1"), ("a", 1, "2", "2"), ("b", 0, "7", "7")] and got[0].fields["颜色"].status == "defaulted"
    for results, reports in (({"a.json": rows(1)}, {"b_parse_report.json": report(1)}), ({"a.json": rows(1, 2)}, {"a_parse_report.json": report(1)}), ({"a.json": rows(1)}, {"a_parse_report.json": report(2)})):
        with pytest.raises(documents.ContractError):
            write(results, reports)


def test_sheets_by_header_and_stems(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(workbook([("Review", [["id", "code"], [1, "M1"], [None, None], ["", "M2"]], {})]))
    (tmp_path / "x_parse_report.json").write_text("{}")
    cells = workbook_cells(spark, str(tmp_path))
    assert sorted((r.id, r.code) for r in documents.sheet_table(cells, "Review", ["id", "code"]).collect()) == [("", "M2"), ("1", "M1")]
    with pytest.raises(documents.ContractError):
        documents.sheet_table(cells, "Review", ["id", "kind"])
    rows = documents.by_stem(spark, books=f"{tmp_path}/*.xlsx", reports=f"{tmp_path}/*.json").collect()
    assert [(r.stem, r.books[-6:], r.reports[-4:]) for r in rows] == [("x", "x.xlsx", "json")]


def test_store_readers_and_manifest(spark, tmp_path):
    from tests.test_match import HEADER, ROWS
    from weftspark.operators import master
    from weftspark.sources.master_csv import checked, read_master

    (tmp_path / "m.csv").write_text("\n".join([HEADER, *ROWS]), encoding="utf-8")
    rows, probe = read_master(spark, f"{tmp_path}/m.csv")
    store = master.normalized(checked(rows))
    master.write_store(store, f"{tmp_path}/store")
    assert documents.material_candidates(spark, f"{tmp_path}/store").count() == 6 and documents.material_index(spark, f"{tmp_path}/store").first().material_code == "M1"
    told = documents.manifest(store, probe, {"rows": 6})
    assert told["category"]["被套"] == 4 and told["statistics"]["color"]["漂白色"] == 4 and told["quality"]["style"]["empty"] == 3 and told["outputs"] == {"rows": 6}
