"""From workbook bytes to formal records."""

import pytest
from pyspark.sql import functions as F

from tests.workbooks import workbook
from weftspark.contracts import FORMAL_FIELDS
from weftspark.operators import items, metadata, sheets
from weftspark.plans.parse import parse_workbooks, status_report
from weftspark.sources.xlsx import read_cells, workbook_cells

INVOICE = [
    ["Proforma Invoice"],
    ["Currency: USD", None, None, "Buyer:", "Grand Hotel"],
    ["Delivery date", "5/28/2026", None, "Sales person: Lee"],
    [None, "Linens"],
    ["No.", "Item", "Size W*L", "Specification", "QTY", "Remarks"],
    ["序号", "品名", "size", None, "quantity pcs", None],
    [None, "KING ROOM"],
    [1.0, "Duvet Cover", "200cm W x 230cm L", "T300 sateen 100% cotton, bag style with ties, 5 cm flange", 12.0, "inner flap 30cm"],
    [2, "Duvet cover", "W: 1600mm L: 2000mm", None, "3.50", None],
    [3, "Flat sheet", "100x200", "twill", 5, None],
    [None, "QUEEN"],
    [4, "Quilt-cover", "60 x 80 inch", "80/20 cotton/poly twill, light grey, envelope, embroidered", 2, None],
    [None, None],
    ["Total:", None, None, None, 20],
    [5, "Duvet cover", "1x2", "x", 9],
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    (path / "a.xlsx").write_bytes(workbook([("Cover", [["x"]], {}), ("My PI list", INVOICE, {"merges": ["B4:D4"], "formats": {(8, 5): '"US$"#,##0'}})]))
    (path / "b.xlsx").write_bytes(workbook([("pi", [["No", "Item", "Qty", "Size"], [1, "duvet cover", 3, "10x20"], [None], [None], [2, "duvet cover", 3, "10x20"]], {}), ("PI-Update", [["€ and £"], ["No", "Item", "Size", "Qty"], [7, "Dubet cover", "abc", 1]], {})]))
    (path / "c.txt").write_text("not a workbook")
    return str(path)


def test_cells_of_a_workbook():
    rows = [["a  b\n c", 3.0, 2.5, True, 45000.5], [None, "x"]]
    data = workbook([("S", rows, {"dates": [(1, 5)], "merges": ["A1:A2"], "hidden_rows": [2], "hidden_cols": [3], "formulas": {(1, 2): "1+2"}, "formats": {(1, 3): "0.00"}, "state": "hidden"})])
    cells = {(c[3], c[4]): c for c in read_cells(data)}
    assert [cells[1, k][5] for k in range(1, 6)] == ["a b c", "3", "2.5", "True", "2023-03-15 12:00:00"]
    assert cells[1, 2][6] == "=1+2" and cells[1, 3][7] == "0.00" and cells[1, 3][8] and cells[2, 2][8] and not cells[1, 1][8]
    assert cells[2, 1][5] == "" and cells[2, 1][9:] == (1, 1) and cells[1, 1][2] == "hidden"


def test_sheet_choice_and_grid(spark, folder):
    cells = workbook_cells(spark, folder)
    chosen = {r.file[-6:]: r.sheet for r in sheets.choose_sheet(cells).select("file", "sheet").distinct().collect()}
    assert chosen == {"a.xlsx": "My PI list", "b.xlsx": "PI-Update"}
    rows = {r.row: r.cells for r in sheets.grid(sheets.fill_merged(sheets.choose_sheet(cells))).filter("file like '%a.xlsx'").collect()}
    assert len(rows) == 15 and {len(c) for c in rows.values()} == {6}
    assert rows[4][:4] == ["", "Linens", "Linens", "Linens"] and rows[13] == [""] * 6


def test_header_body_and_notes(spark, folder):
    rows = sheets.grid(sheets.fill_merged(sheets.choose_sheet(workbook_cells(spark, folder)))).filter("file like '%a.xlsx'")
    found = sheets.table_rows(rows).orderBy("row").collect()
    assert [r.row for r in found] == [8, 9, 10, 12] and [r.section_note for r in found] == ["KING ROOM", "", "", "QUEEN"]
    assert found[0].headers == ["No. 序号", "Item 品名", "Size W*L size", "Specification", "QTY quantity pcs", "Remarks"]
    blocks = sheets.numbered_blocks(rows).orderBy("first_row").collect()
    assert [(b.first_row, b.last_row, b.records) for b in blocks] == [(8, 10, 3), (12, 12, 1), (15, 15, 1)] and blocks[0].header_rows == [5, 6]


def test_two_blank_rows_end_a_table(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(workbook([("pi", [["No", "Item", "Qty", "Size"], ["payment first"], [1, "a", 3, "10x20"], [None], [2, "b", 3, "x"], [None], [None], [3, "c", 3, "x"]], {})]))
    rows = sheets.grid(workbook_cells(spark, str(tmp_path)))
    assert [r.row for r in sheets.table_rows(rows).orderBy("row").collect()] == [3, 5]


def test_header_falls_back_to_the_row_above_the_first_number(spark, tmp_path):
    (tmp_path / "x.xlsx").write_bytes(workbook([("pi", [["hello"], ["Alpha", "Beta"], [1, "thing"]], {})]))
    found = sheets.table_rows(sheets.grid(workbook_cells(spark, str(tmp_path)))).collect()
    assert found[0].headers == ["Alpha", "Beta"] and found[0].cells == ["1", "thing"]


def test_items_inherit_and_filter(spark, folder):
    rows = sheets.grid(sheets.fill_merged(sheets.choose_sheet(workbook_cells(spark, folder)))).filter("file like '%a.xlsx'")
    raw = {r.row: r for r in items.raw_items(sheets.table_rows(rows)).collect()}
    assert raw[9].specification == "" and not raw[9].inherited  # the text above does not name the product
    assert raw[8].item_name_cell == "B8" and raw[12].size_cell == "C12" and raw[10].remarks_cell is None
    assert sorted(r.row for r in items.wanted_items(items.raw_items(sheets.table_rows(rows))).collect()) == [8, 9, 12]


def test_adjacent_description_is_carried_along(spark, tmp_path):
    head = ["No", "Item", "Size", "Specification", "Qty"]
    book = [head, [1, "x", "1x2", "duvet cover T300", 1], [2, "y", "1x2", None, 1], [3, "z", "1x2", None, 1], ["note"], [4, "w", "1x2", None, 1], [5, "v", "1x2", "towel", 1], [6, "u", "1x2", None, 1]]
    (tmp_path / "x.xlsx").write_bytes(workbook([("pi", book, {})]))
    raw = items.raw_items(sheets.table_rows(sheets.grid(workbook_cells(spark, str(tmp_path))))).orderBy("row").collect()
    assert [r.specification for r in raw] == ["duvet cover T300"] * 3 + ["", "towel", ""] and [r.inherited for r in raw] == [False, True, True, False, False, False]
    assert raw[2].specification_cell == "D2"


def test_formal_records(spark, folder):
    found = parse_workbooks(spark, folder)
    rows = {(r.file[-6:], r.row): r for r in found.collect()}
    assert sorted(rows) == [("a.xlsx", 8), ("a.xlsx", 9), ("a.xlsx", 12), ("b.xlsx", 3)]
    one = rows["a.xlsx", 8].record.asDict()
    assert tuple(one) == FORMAL_FIELDS
    assert one | {} == {
        "客户": "Grand Hotel", "币种": "美元", "业务员": "Lee", "表头备注": "", "行号": "1", "物料编码": "", "物料名称": "Grand Hotel 被套", "规格": "230*200cm", "颜色": "漂白色", "面料": "贡缎/T300/100C",
        "面料-涤棉成分": "100C", "款式": "被尾单飞边双层口叠边口袋有系带式", "加标方式": "客标", "尺寸类型": "洗涤尺寸", "数量": "12", "行备注": "重叠片30", "计划发货日期": "2026-05-28",
        "包装方式": "纸箱（三瓦楞七层），内衬防水袋", "是否绣花": "N", "相似分数": 0.0,
    }
    two, four = rows["a.xlsx", 9].record, rows["a.xlsx", 12].record
    assert two["规格"] == "200*160cm" and two["数量"] == "3.50"
    assert (four["规格"], four["颜色"], four["面料"], four["是否绣花"], four["款式"]) == ("203.2*152.4cm", "浅灰色", "斜纹/C80/T20", "Y", "无飞边平口信封式")
    status = rows["a.xlsx", 12].statuses
    assert (status["颜色"], status["款式"], status["币种"], status["尺寸类型"], status["行备注"]) == ("normalized", "normalized", "normalized", "defaulted", "derived")
    odd = rows["b.xlsx", 3]
    assert odd.record["规格"] == "abc" and odd.record["物料名称"] == "被套" and odd.statuses["币种"] == "ambiguous" and odd.statuses["面料"] == "source_not_provided"
    report = {r.field: r for r in status_report(found).collect()}
    assert len(report) == 20 and report["行号"].extracted == 4 and report["币种"].ambiguous == 1 == report["币种"].warnings


def test_currency_rules(spark, tmp_path):
    cases = {"CNY holiday only": "", "RMB and CNY": "", "price in CN¥": "人民币", "JPY": "日元", "pay 5 €": "欧元", "$ or £": "", "XUSDX": "", "US$ 5": "美元"}
    for i, text in enumerate(cases):
        (tmp_path / f"{i}.xlsx").write_bytes(workbook([("pi", [[text], ["No", "Item", "Size"], [1, "a", "b"]], {})]))
    got = {r.file.split("/")[-1]: r.currency for r in metadata.currency(sheets.grid(workbook_cells(spark, str(tmp_path)))).collect()}
    assert [got[f"{i}.xlsx"] for i in range(len(cases))] == list(cases.values())


def test_many_format_columns_do_not_state_a_currency(spark, tmp_path):
    row = [1, 2, 3, 4]
    for name, n in (("few", 3), ("many", 4)):
        (tmp_path / f"{name}.xlsx").write_bytes(workbook([("pi", [["No", "Item", "Size"], row], {"formats": {(2, c): '"US$"0' for c in range(1, n + 1)}})]))
    got = {r.file.split("/")[-1]: r.currency for r in metadata.currency(sheets.grid(workbook_cells(spark, str(tmp_path)))).collect()}
    assert got == {"few.xlsx": "美元", "many.xlsx": ""}


def test_empty_cells_give_no_records(spark, folder):
    from weftspark.plans.parse import parse_cells

    assert parse_cells(workbook_cells(spark, folder).filter(F.lit(False))).count() == 0
