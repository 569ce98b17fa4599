"""Workbooks as a table of cells, read from their bytes with the standard library on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.contracts import CELL_SCHEMA

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
EXTENSIONS = (".xlsx", ".xlsm")
# The built-in number formats of the file format that tell money, dates and percentages.
BUILT_IN_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: '"$"#,##0_);("$"#,##0)', 6: '"$"#,##0_);[Red]("$"#,##0)', 7: '"$"#,##0.00_);("$"#,##0.00)',
    8: '"$"#,##0.00_);[Red]("$"#,##0.00)', 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 42: '_("$"* #,##0_);_("$"* \\(#,##0\\);_("$"* "-"_);_(@_)',
    44: '_("$"* #,##0.00_)_("$"* \\(#,##0.00\\)_("$"* "-"??_)_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@",
}


def _position(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref.replace("$", "")).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _is_date(code: str) -> bool:
    return re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())) is not None


def _joined(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _number(text: str, code: str) -> str:
    value = float(text)
    if code and _is_date(code):
        return (datetime(1899, 12, 30) + timedelta(days=value)).replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")
    return str(int(value)) if value.is_integer() else repr(value)


def clean(text: str) -> str:
    """A cell's text on one line, runs of white space as one space."""
    return re.sub(r"\s{2,}", " ", text.replace("\r\n", " ").replace("\n", " ").replace("\t", " ")).strip()


def read_cells(content: bytes) -> Iterator[tuple]:
    """Rows (sheet_idx, sheet, visibility, row, col, text, formula, number_format, hidden, anchor_row, anchor_col) of a workbook.

    A cell in a merged range names the range's first cell as its anchor; cells of such ranges that the file leaves out are
    rows with an empty text.
    """
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    tree = lambda name: ElementTree.fromstring(book.read(name))
    shared = [_joined(si) for si in tree("xl/sharedStrings.xml").findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
    formats: list[str] = []
    if "xl/styles.xml" in names:
        styles = tree("xl/styles.xml")
        own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{_MAIN}numFmt")}
        xfs = styles.find(f"{_MAIN}cellXfs")
        formats = [own.get(int(x.get("numFmtId", 0)), BUILT_IN_FORMATS.get(int(x.get("numFmtId", 0)), "")) for x in xfs] if xfs is not None else []
    targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
    for index, sheet in enumerate(tree("xl/workbook.xml").iter(f"{_MAIN}sheet")):
        target = targets[sheet.get(_REL)]
        page = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        head = (index, sheet.get("name"), sheet.get("state", "visible"))
        hidden_cols = {c for e in page.iter(f"{_MAIN}col") if e.get("hidden") in ("1", "true") for c in range(int(e.get("min")), min(int(e.get("max")), 16384) + 1)}
        anchors: dict[tuple[int, int], tuple[int, int]] = {}
        for merged in page.iter(f"{_MAIN}mergeCell"):
            (r1, c1), (r2, c2) = (_position(p) for p in (merged.get("ref").split(":") * 2)[:2])
            anchors.update({(r, c): (r1, c1) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)})
        seen, hidden_rows, last = set(), set(), 0
        for row in page.iter(f"{_MAIN}row"):
            last = int(row.get("r", last + 1))
            if row.get("hidden") in ("1", "true"):
                hidden_rows.add(last)
            col = 0
            for cell in row.findall(f"{_MAIN}c"):
                at = _position(cell.get("r")) if cell.get("r") else (last, col + 1)
                col = at[1]
                code = formats[int(cell.get("s", 0))] if int(cell.get("s", 0)) < len(formats) else ""
                kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                raw = "" if value is None else value.text or ""
                if kind == "s" and raw:
                    raw = shared[int(raw)]
                elif kind == "inlineStr":
                    raw = _joined(cell.find(f"{_MAIN}is"))
                elif kind == "b" and raw:
                    raw = str(raw == "1")
                elif kind == "n" and raw:
                    raw = _number(raw, code)
                formula = cell.find(f"{_MAIN}f")
                seen.add(at)
                yield (*head, *at, clean(raw), "" if formula is None else f"={formula.text or ''}", "" if code == "General" else clean(code), last in hidden_rows or at[1] in hidden_cols, *anchors.get(at, (None, None)))
        for at, anchor in anchors.items():
            if at not in seen:
                yield (*head, *at, "", "", "", at[0] in hidden_rows or at[1] in hidden_cols, *anchor)


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks below path; other file types are left out.  A workbook is read whole by one task."""
    files = spark.read.format("binaryFile").load(path)
    files = files.filter(F.lower("path").rlike(r"\.(xlsx|xlsm)$")).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), "content")
    columns = [c.strip().split(" ")[0] for c in CELL_SCHEMA.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, digest, content in zip(batch["file"], batch["sha256"], batch["content"], strict=True):
                rows = [(file, digest, *cell) for cell in read_cells(content)]
                frame = pd.DataFrame(rows, columns=columns)
                for name in ("anchor_row", "anchor_col"):
                    frame[name] = frame[name].astype("Int32")
                yield frame

    return files.mapInPandas(run, CELL_SCHEMA)
