"""Layout of small sheets; ranges as the fixtures give them."""

import pytest

from gridlark.operators import layout
from gridlark.plans.address import column_number, letters
from gridlark.samples import STACKED, SIBLINGS, YEARS, CALENDAR, PRICING, BAND, UNITS, FORECAST, CAPTION, SECTIONS, ANCHOR, BETWEEN, MATRIX
from gridlark.sources.workbook import cells, files

from .books import book


def grid(text):
    """Rows of cells parted by |; numbers where they parse."""
    out = []
    for r, line in enumerate(text.strip("\n").split("\n"), 1):
        for c, raw in enumerate(line.split("|"), 1):
            value = raw.strip()
            if not value:
                continue
            try:
                number = float(value)
                kind = layout.YEAR if number % 1 == 0 and 1900 <= number <= 2100 else layout.FIGURE
                out.append((r, c, kind, number, None, False))
            except ValueError:
                out.append((r, c, layout.LABEL, 0.0, value, False))
    return layout.Grid(out)


def a1(x):
    return f"{letters(x.left)}{x.top}:{letters(x.right)}{x.bottom}"


@pytest.mark.parametrize(
    ("sheet", "fields"),
    [
        (STACKED, {"B3:D5": 2, "B9:D11": 2}),
        (SIBLINGS, {"B2:D5": 2, "F2:G5": 2}),
        (YEARS, {"C2:D7": 3}),
        (CALENDAR, {"A2:G5": 1}),
        (PRICING, {"A2:D5": 1}),
        (BAND, {"B3:E5": 2}),
        (UNITS, {"B2:D4": 2}),
        (FORECAST, {"C2:G7": 3}),
        (CAPTION, {"B3:D5": 2}),
        (MATRIX, {"B3:F7": 2}),
    ],
)
def test_fields_and_ranks(sheet, fields):
    found, _, _ = layout.infer(grid(sheet))
    assert {a1(f): len(axes) for f, axes in found} == fields


def test_titles_axes_and_sections():
    assert [t for t, *_ in layout.infer(grid(STACKED))[2]] == ["Income statement", "Balance sheet"]
    found, axes, _ = layout.infer(grid(SIBLINGS))
    assert a1(found[0][1][0]) == "A2:A5" and found[0][1][0] is found[1][1][0]
    assert {a1(a): (a.kind, a.primary) for a in layout.infer(grid(YEARS))[1]}["B2:B7"] == ("Numeric", False)
    assert {a1(a): a.kind for a in layout.infer(grid(MATRIX))[1]} == {"A3:A7": "Numeric", "B2:F2": "Numeric"}
    assert {a1(a): a.kind for a in layout.infer(grid(BAND))[1]}["B2:E2"] == "Numeric"
    assert {a1(a): a.title for a in layout.infer(grid(CAPTION))[1]}["B2:D2"] == "Growth (%)"
    sections = {a1(a): a.sections for a in layout.infer(grid(SECTIONS))[1]}["A3:A9"]
    assert sections == [("Funding", 2, 5), ("Loans", 6, 9)]


def test_left_anchor_and_table_between():
    found = {a1(f) for f, _ in layout.infer(grid(ANCHOR))[0]}
    assert {"B2:C4", "E2:F4"} <= found and "E2:F6" not in found
    fields = [f for f, _ in layout.infer(grid(BETWEEN))[0]]
    assert {"B2:C6", "D4:E5", "F2:G6"} <= {a1(f) for f in fields}
    assert not any(a.meets(b) for i, a in enumerate(fields) for b in fields[:i])


def test_rows(spark):
    rows = {r: [None] * 4 for r in range(1, 6)}
    for r, c, kind, number, text, _ in [(1, "B", "n", 2023.0, None, 0), (1, "C", "n", 2024.0, None, 0), (2, "A", "t", 0, "Revenue", 0), (2, "B", "n", 100.0, None, 0), (2, "C", "n", 110.0, None, 0), (3, "A", "t", 0, "Costs", 0), (3, "B", "n", 40.0, None, 0), (3, "C", "n", 44.0, None, 0)]:
        rows[r][column_number(c) - 1] = text if kind == "t" else number
    got = layout.layout(cells(files(spark, book({"Data": rows})))).collect()
    kinds = {(r.item, r.id): r for r in got}
    assert set(kinds) == {("axis", "axis1"), ("axis", "axis2"), ("field", "field1"), ("group", "group1")}
    field = kinds["field", "field1"]
    assert (field.first_row, field.last_row, field.first_column, field.last_column, field.numeric_count, field.min_numeric, field.max_numeric) == (2, 3, 2, 3, 4, 40, 110)
    assert kinds["group", "group1"].field_ids == ["field1"] and kinds["axis", "axis1"].samples in (["Revenue", "Costs"], ["2023", "2024"])
