"""Small workbooks for tests, written with the standard library."""

import io
import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(col):
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def workbook(sheets):
    """Bytes of a workbook; sheets: (name, rows, options) with rows of values, and options merges, hidden_rows,
    hidden_cols, state, formats {(row, col): code}, formulas {(row, col): text}."""
    codes = sorted({c for _, _, o in sheets for c in o.get("formats", {}).values()})
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("[Content_Types].xml", "<Types xmlns='http://schemas.openxmlformats.org/package/2006/content-types'/>")
        tags = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" state="{o.get("state", "visible")}" r:id="rId{i}"/>' for i, (n, _, o) in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{tags}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f"<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>{rels}</Relationships>")
        fmts = "".join(f'<numFmt numFmtId="{200 + i}" formatCode="{escape(c, {chr(34): "&quot;"})}"/>' for i, c in enumerate(codes))
        xfs = '<xf numFmtId="0"/>' + "".join(f'<xf numFmtId="{200 + i}"/>' for i in range(len(codes))) + '<xf numFmtId="14"/>'
        out.writestr("xl/styles.xml", f"<styleSheet {NS}><numFmts>{fmts}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>")
        strings = []
        for i, (_, rows, options) in enumerate(sheets, 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, value in enumerate(row, 1):
                    ref, code = f"{letters(c)}{r}", options.get("formats", {}).get((r, c))
                    style = f' s="{1 + codes.index(code)}"' if code else f' s="{len(codes) + 1}"' if (r, c) in options.get("dates", ()) else ""
                    formula = options.get("formulas", {}).get((r, c))
                    formula = f"<f>{escape(formula)}</f>" if formula else ""
                    if value is None and not (style or formula):
                        continue
                    if isinstance(value, bool):
                        cells.append(f'<c r="{ref}" t="b"{style}>{formula}<v>{int(value)}</v></c>')
                    elif isinstance(value, str):
                        strings.append(value)
                        cells.append(f'<c r="{ref}" t="s"{style}>{formula}<v>{len(strings) - 1}</v></c>')
                    else:
                        cells.append(f'<c r="{ref}"{style}>{formula}{"" if value is None else f"<v>{value}</v>"}</c>')
                hidden = ' hidden="1"' if r in options.get("hidden_rows", ()) else ""
                body.append(f'<row r="{r}"{hidden}>{"".join(cells)}</row>')
            cols = "".join(f'<col min="{c}" max="{c}" hidden="1"/>' for c in options.get("hidden_cols", ()))
            merges = "".join(f'<mergeCell ref="{m}"/>' for m in options.get("merges", ()))
            out.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><cols>{cols}</cols><sheetData>{''.join(body)}</sheetData><mergeCells>{merges}</mergeCells></worksheet>")
        items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
        out.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
    return buffer.getvalue()
