"""Candidates, evidence, decisions, dictionaries, review, structure."""

import pytest
from pyspark.sql import functions as F

from tests.workbooks import workbook
from weftspark.operators import dictionary, resolution, review, structure
from weftspark.sources.xlsx import workbook_cells


@pytest.mark.parametrize(
    ("field", "value", "want"),
    [("币种", " US$ ", "美元"), ("币种", "doubloon", "doubloon"), ("数量", "+012.500", "12.5"), ("数量", "100", "100"), ("数量", "3 pcs", "3 pcs"), ("计划发货日期", "2026/2/3", "2026-02-03"), ("计划发货日期", "2026年12月1日", "2026-12-01"), ("计划发货日期", "2026-02-30", "2026-02-30"), ("颜色", "ｗｈｉｔｅ  x", "white x")],
)
def test_normalised_values(spark, field, value, want):
    df = spark.createDataFrame([(field, value)], "f string, v string")
    assert df.select(resolution.normalized_value(F.col("f"), F.col("v"))).first()[0] == want


def test_candidates_are_bound_to_evidence(spark):
    catalog = spark.createDataFrame([("e1", "s1", "Duvet  Cover WHITE"), ("e2", "s1", "qty 5"), ("e3", "s2", "white")], "evidence_id string, scope_id string, text string")
    targets = spark.createDataFrame([("r", "s1", ["e1"])], "record_id string, scope_id string, evidence_ids array<string>")
    rows = [
        ("r", "颜色", "white", "direct", "", ["e1"]), ("r", "数量", "5", "direct", "", ["e2"]), ("r", "面料", "x", "direct", "", ["e3"]), ("r", "款式", "x", "direct", "", ["nope"]), ("r", "规格", "blue", "direct", "", ["e1"]),
        ("r", "客户", "cover", "semantic", "", ["e1"]), ("r", "币种", "c", "semantic", "duvet cover", ["e1"]), ("r", "业务员", "c", "semantic", "zzz", ["e1"]), ("r", "行备注", "c", "direct", "", []),
    ]
    got = {r.field: r for r in resolution.bind(spark.createDataFrame(rows, "record_id string, field string, value string, interpretation string, quote string, references array<string>"), catalog, targets).collect()}
    assert (got["颜色"].violation, got["颜色"].issue, got["颜色"].quote_evidence, got["颜色"].quote_start) == (None, None, "e1", 12)
    assert [got[f].violation for f in ("数量", "面料", "款式", "行备注")] == ["evidence_not_in_target", "evidence_cross_scope", "evidence_id_missing", "evidence_id_missing"]
    assert [got[f].issue for f in ("规格", "客户", "币种", "业务员")] == ["direct_candidate_untraceable", "supporting_quote_required", None, "supporting_quote_untraceable"]


def test_decisions(spark):
    ai = [
        ("r", "币种", "usd", "direct", "", None), ("r", "数量", "5", "direct", "", None), ("r", "颜色", "white", "semantic", "w", None), ("r", "面料", "x", "source_summary", "x", None), ("r", "款式", "x", "direct", "", "bad"),
        ("r", "行备注", "do it, now", "source_summary", "do it ,now.", None), ("r", "表头备注", "more words", "source_summary", "words", None), ("r", "客户", "ACME", "direct", "", None),
    ]
    rules = {"币种": "美元", "数量": "6", "面料": "贡缎", "客户": "ACME", "规格": "1*2cm", "计划发货日期": "2026/1/2"}
    given = [("r", f, rules.get(f, ""), f in rules) for f in resolution.BUSINESS_FIELDS]
    decisions = resolution.decide(
        spark.createDataFrame(ai, "record_id string, field string, value string, interpretation string, quote string, issue string"), spark.createDataFrame(given, "record_id string, field string, value string, has_evidence boolean")
    )
    got = {r.field: r for r in decisions.collect()}
    assert len(got) == 17
    short = lambda f: (got[f].value, got[f].status, got[f].comparison, got[f].review_required, got[f].severity, got[f].reasons)
    assert short("币种") == ("美元", "ai_selected", "equivalent_after_normalization", False, "none", ["ai_direct_selected", "ai_python_normalized_equivalent"])
    assert short("数量") == ("5", "ai_selected", "different", True, "high", ["ai_direct_selected", "ai_python_different"])
    assert short("颜色") == ("white", "ai_selected", "ai_only", True, "medium", ["ai_semantic_selected", "ai_only"])
    assert short("面料") == ("贡缎", "python_fallback", "python_fill", True, "medium", ["python_fallback_ai_issue", "ai_interpretation_not_allowed"])
    assert short("款式") == ("", "missing", "both_missing", True, "medium", ["both_missing", "ai_candidate_content_issue"])
    assert got["行备注"].status == "ai_selected" and got["表头备注"].reasons == ["both_missing", "remark_expansion_rejected"]
    assert short("客户")[:4] == ("ACME", "ai_selected", "agree", False) and short("计划发货日期")[:2] == ("2026-01-02", "python_fallback") and got["业务员"].severity == "high"
    expected = spark.createDataFrame([("r",), ("lost",)], "record_id string")
    gate = {r.record_id: r for r in resolution.ready_gate(decisions.unionByName(decisions.limit(0)), expected).collect()}
    assert gate["r"].ready and gate["r"].review_required and gate["lost"].reasons == ["record_missing"]
    assert resolution.ready_gate(decisions.filter("field <> '客户'"), expected).filter("record_id = 'r'").first().reasons == ["fields_missing"]
    assert resolution.wide_records(decisions).first()["客户"] == "ACME"
    first = resolution.review_items(decisions).first()
    assert first.severity == "high" and first.review_required


def test_strict_decisions(spark):
    ai = [("数量", "5", "extracted", ["e"]), ("计划发货日期", "soon", "extracted", ["e"]), ("客户", "A", "extracted", ["e"]), ("颜色", " W ", "normalized", []), ("面料", "x", "invalid", []), ("款式", "x", "extracted", ["e"]), ("规格", "x", "extracted", []), ("币种", "", "missing", []), ("业务员", "y", "extracted", ["e"])]
    rules = [("数量", "6", True), ("计划发货日期", "", False), ("客户", "B", False), ("颜色", "w", True), ("面料", "z", True), ("款式", "", False), ("规格", "y", True), ("币种", "美元", True), ("业务员", "y", True)]
    got = {r.field: r for r in resolution.decide_strict(
        spark.createDataFrame([("r", *a) for a in ai], "record_id string, field string, value string, extraction_status string, references array<string>"), spark.createDataFrame([("r", *r) for r in rules], "record_id string, field string, value string, has_evidence boolean")
    ).collect()}
    want = {
        "数量": ("", "unresolved_direct_evidence_conflict", True), "计划发货日期": ("", "ai_rejected_business_constraint", True), "客户": ("A", "direct_evidence_selected_ai", False), "颜色": ("w", "ai_python_agree", False),
        "面料": ("z", "ai_contract_failure", False), "款式": ("x", "ai_fills_python_blank", False), "规格": ("y", "direct_evidence_selected_python", False), "币种": ("美元", "python_retained_ai_omitted", False), "业务员": ("y", "ai_python_agree", False),
    }
    assert {f: (r.value, r.reason, r.blocking) for f, r in got.items()} == want


def test_fabric_dictionary_match(spark):
    book = spark.createDataFrame([(2, {"category": "贡缎", "density": "T300"}), (3, {"category": "贡缎", "density": "T250"}), (4, {"category": "斜纹", "density": "T300"})], "source_row int, components map<string,string>")
    asked = spark.createDataFrame([("a", {"category": "贡缎"}), ("b", {"density": "T300"}), ("c", {"category": "贡缎", "density": "T300", "color": "灰色"}), ("d", {})], "k string, components map<string,string>")
    got = sorted((r.k, r.source_row) for r in dictionary.match_fabrics(asked, book, "k").collect())
    assert got == [("a", 2), ("a", 3), ("b", 2), ("b", 4), ("d", 2), ("d", 3), ("d", 4)]


def test_single_candidate_and_actions(spark):
    rows = [(["a"], "a"), (["A "], "a"), (["b"], "a"), (["a", "b"], "a"), ([" "], "a"), (["a", "a"], "a")]
    df = spark.createDataFrame(rows, "c array<string>, v string")
    assert [r[0] for r in df.select(dictionary.single_candidate(F.col("c"), F.col("v"))).collect()] == ["exact_match", "equivalent_match", "conflict", "ambiguous", "dictionary_no_match", "exact_match"]
    cases = [
        ("conflict", "x", "normalized", ["y"], "manual_review", "y"), ("dictionary_no_match", "x", "defaulted", [], "keep_default", ""), ("dictionary_no_match", "", "normalized", [], "keep_python", ""),
        ("exact_match", "x", "defaulted", ["x"], "propose_replace_default", "x"), ("exact_match", "", "unrecognized", ["x"], "propose_fill", "x"), ("exact_match", "x", "normalized", ["x"], "keep_python", "x"),
        ("partial_match", "x", "normalized", ["xy"], "propose_enrich", "xy"), ("partial_match", "x", "normalized", ["a", "b"], "keep_python", ""),
    ]
    df = spark.createDataFrame([(*c[:4], "text", ["B2"], ["m"], [], []) for c in cases], "s string, v string, vs string, c array<string>, t string, cells array<string>, m array<string>, mi array<string>, co array<string>")
    got = df.select(dictionary.integration_action(*[F.col(c) for c in ("s", "v", "vs", "c", "t", "cells", "m", "mi", "co")]).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in got] == [c[4:] for c in cases]
    without = df.select(dictionary.integration_action(F.col("s"), F.col("v"), F.col("vs"), F.col("c"), F.lit(""), F.col("cells"), F.col("m"), F.col("mi"), F.col("co"))["action"]).collect()
    assert [r[0] for r in without][3:5] == ["keep_default", "keep_python"]


def test_risk_levels(spark):
    counts = {"颜色": {"exact_match": 10}, "面料": {"exact_match": 7, "conflict": 3}, "币种": {"exact_match": 7, "dictionary_no_match": 3}, "款式": {"exact_match": 1, "conflict": 9}, "规格": {"exact_match": 9, "partial_match": 1}}
    df = spark.createDataFrame([(f, s) for f, c in counts.items() for s, n in c.items() for _ in range(n)], "field string, status string")
    assert {r.field: r.risk for r in dictionary.risk_levels(df).collect()} == {"颜色": "low_risk", "面料": "high_risk", "币种": "medium_risk", "款式": "not_ready", "规格": "medium_risk"}


def test_evidence_text_and_keywords(spark):
    cells = spark.createDataFrame([("f", 0, "A1", "x"), ("f", 0, "B2", "y"), ("f", 0, "C3", "x"), ("f", 0, "D4", "")], "file string, sheet_idx int, ref string, text string")
    refs = spark.createDataFrame([(1, "f", 0, ["B2", "A1", "C3", "D4", "Z9"])], "k int, file string, sheet_idx int, refs array<string>")
    assert dictionary.evidence_text(refs, cells, ["k"]).first().source_text == "y | x"
    rules = spark.createDataFrame([("Duvet", 2), ("towel", 3)], "keyword string, source_row int")
    got = dictionary.match_keywords(spark.createDataFrame([("a DUVET cover",)], "t string"), rules, "t", "keyword").collect()
    assert [r.source_row for r in got] == [2]
    assert spark.createDataFrame([("Plain White and GREY",)], "t string").select(dictionary.color_candidates(F.col("t"))).first()[0] == ["漂白色", "灰色"]


def test_review_issues_and_metrics(spark):
    rows = [
        ("1", "M1", "M1", review.RECOMMENDED, ""), ("2", "M1", "M2", review.RECOMMENDED, ""), ("3", "M1", "M9", review.OTHER, ""), ("4", "", "", review.NO_MATERIAL, ""), ("6", "M1", "", review.WRONG_FIELDS, ""),
        ("6", "M1", "M1", "", ""), ("x", "M1", "M3", review.OTHER, ""), ("7", "M1", "M3", review.OUTSIDE, ""), ("8", "M1", "", "nonsense", ""),
    ]
    sheet = spark.createDataFrame(rows, "audit_id string, recommended string, correct string, conclusion string, fix_fields string")
    materials = spark.createDataFrame([(m,) for m in ("M1", "M2", "M3")], "material_code string")
    cands = spark.createDataFrame([("1", "M1", 1), ("2", "M2", 4), ("7", "M3", 2), ("x", "M3", 11), ("99", "M1", 1)], "audit_id string, material_code string, rank int")
    got = {(r.audit_id, r.rule) for r in review.issues(sheet, materials, cands).collect()}
    assert got == {
        ("2", "recommended_differs"), ("3", "unknown_material"), ("3", "other_not_a_candidate"), ("6", "wrong_fields_not_named"), ("6", "id_repeated"), ("6", "code_without_conclusion"), ("x", "id_not_a_number"),
        ("7", "outside_is_a_candidate"), ("8", "unknown_conclusion"), ("5", "id_missing"), ("99", "candidate_without_row"),
    }
    m = review.metrics(sheet, cands).first()
    assert (m.total_rows, m.reviewed_rows, m.positive_truth_rows, m.top1_hits, m.top3_hits, m.top10_hits, m.outside_top10, m.no_recommendation_rate, m.excluded_rows) == (9, 8, 5, 1, 2, 3, 2, 1.0, 2)
    assert review.metrics(sheet.limit(0), cands).first().top1_rate is None


def test_structure_of_a_workbook(spark, tmp_path):
    rows = [["No", "Item", "Size", "secret"], [1, "a", "1x2", "s"], [2, "b", None, "s"], [None], ["note"], [3, "c", "x", "s"], [4, "hidden", "x", "s"]]
    (tmp_path / "x.xlsx").write_bytes(workbook([("pi", rows, {"hidden_rows": [7], "hidden_cols": [4], "merges": ["C2:C3"]}), ("h", rows, {"state": "hidden"})]))
    cells = workbook_cells(spark, str(tmp_path)).cache()
    sparse = structure.sparse_cells(cells).collect()
    assert {c.ref for c in sparse} == {"A1", "B1", "C1", "A2", "B2", "C2", "A3", "B3", "A5", "A6", "B6", "C6"} and {c.anchor for c in sparse if c.ref == "C2"} == {"C2"}
    found = structure.blocks(cells)
    assert sorted((b.first_row, b.last_row, b.header_rows) for b in found.collect()) == [(2, 3, [1]), (6, 6, [])]
    items = structure.evidence(cells, found)
    recs = structure.records(found, items)
    by_row = {r.row: r for r in recs.collect()}
    assert sorted(by_row) == [2, 3, 6] and len(by_row[2].evidence_ids) == 3 and len({r.record_id for r in by_row.values()}) == 3
    units = {r.row: r for r in structure.extraction_units(found, items, recs).collect()}
    assert [c.excerpt for c in units[3].context] == ["No", "Item", "Size"] and units[6].context is None and units[2].unit_sha256.startswith("sha256:")
    assert structure.chunk_manifest(recs).count() == 2
    chosen = found.filter("first_row = 6").select("scope_id")
    left = structure.apply_layout(found, items, recs, chosen)
    assert [df.count() for df in left] == [1, 3, 1]
    assert structure.used_bounds(cells).first().max_row == 6 and structure.row_patterns(cells).filter("sheet_idx = 0").count() == 6


def test_units_have_every_labelled_row_above_their_block(spark, tmp_path):
    name = "A very long name " * 12
    rows = [["Customer"], [name, "second cell"], ["Buyer:"], ["Bank account 1"], ["Currency", "USD"], ["plain"], [None], [None], ["No", "Item", "Size"], [1, "a", "1x2"], [2, "b", "2x2"], [None], ["delivery date 1 May"]]
    (tmp_path / "x.xlsx").write_bytes(workbook([("pi", rows, {"merges": ["A5:A6"]})]))
    cells = workbook_cells(spark, str(tmp_path)).cache()
    found = structure.blocks(cells)
    items = structure.evidence(cells, found)
    recs = structure.records(found, items)
    own = {r.row: r.evidence_ids for r in recs.collect()}
    assert [len(own[r]) for r in (10, 11)] == [3, 3]
    for unit in structure.extraction_units(found, items, recs).collect():
        assert [(c.row, c.excerpt) for c in unit.context] == [(1, "Customer"), (2, name.strip()), (2, "second cell"), (3, "Buyer:"), (5, "Currency"), (5, "USD"), (9, "No"), (9, "Item"), (9, "Size")]
        assert unit.evidence_ids == own[unit.row] + [c.evidence_id for c in unit.context]
