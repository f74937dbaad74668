"""Workbooks built in memory."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from xml.sax.saxutils import escape

from gridlark.plans.address import letters

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f"{HEAD}<styleSheet {MAIN}><cellXfs count='2'><xf numFmtId='0'/><xf numFmtId='14'/></cellXfs></styleSheet>"


class Error(str):
    pass


class Formula:
    def __init__(self, text, value=None, array=False):
        self.text, self.value, self.array = text, value, array


def cell(reference, value):
    if value is None:
        return ""
    if isinstance(value, Formula):
        kind = ' t="array"' if value.array else ""
        inner = "" if value.value is None else f"<v>{value.value}</v>"
        return f'<c r="{reference}"><f{kind}>{escape(value.text)}</f>{inner}</c>'
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, Error):
        return f'<c r="{reference}" t="e"><v>{value}</v></c>'
    if isinstance(value, dt.datetime):
        serial = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{reference}" s="1"><v>{serial!r}</v></c>'
    if isinstance(value, str):
        return f'<c r="{reference}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{reference}"><v>{value!r}</v></c>'


def sheet_xml(rows, after=""):
    """rows: {row number: [values from column A]}."""
    body = "".join(f'<row r="{r}">{"".join(cell(f"{letters(i)}{r}", v) for i, v in enumerate(values, 1))}</row>' for r, values in sorted(rows.items()))
    return f"{HEAD}<worksheet {MAIN}><sheetData>{body}</sheetData>{after}</worksheet>"


def book(sheets, strings=(), extra=None, date1904=False, names=""):
    """Bytes of a workbook. sheets: {name: rows or the worksheet's XML}."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", f'{HEAD}<Relationships><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {MAIN}><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets>{names}</workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships>{links}<Relationship Id="s1" Type="{REL}/styles" Target="styles.xml"/><Relationship Id="s2" Type="{REL}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {MAIN}>{''.join(strings)}</sst>")
        for i, content in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", content if isinstance(content, str) else sheet_xml(content))
        for part, content in (extra or {}).items():
            z.writestr(part, content)
    return out.getvalue()


def day(text):
    return dt.datetime.strptime(text, "%Y-%m-%d")


SALES = [
    ["Region", "Month", "NetSales", "Units", "OnPromo", "OrderDate"],
    ["EMEA", "Jan", 100.5, 1.0, True, day("2024-01-15")],
    ["EMEA", "Feb", 200.25, 2.0, False, day("2024-02-15")],
    ["APAC", "Jan", 50.0, 3.0, True, day("2024-01-20")],
    ["APAC", "Feb", "n/a", 4.0, False, day("2024-02-20")],
    ["AMER", "Jan", 75.0, 5.0, True, day("2024-01-25")],
    ["EMEA", "Jan", 10.0, 6.0, False, day("2024-01-30")],
    ["AMER", "Mar", 300.0, 7.0, True, day("2024-03-05")],
    ["APAC", "Mar", 25.75, 8.0, False, day("2024-03-10")],
    ["EMEA", "Mar", None, 9.0, True, day("2024-03-15")],
    ["AMER", "Feb", 60.0, 10.0, False, day("2024-02-25")],
]


def sales(title=False):
    rows = {i + 1 + title: r for i, r in enumerate(SALES)}
    return book({"Sales": ({1: ["Sales Report 2024"]} if title else {}) | rows})
