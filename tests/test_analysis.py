import pytest

from gridlark.api import Workbook
from gridlark.operators import formulas, regions
from gridlark.operators.analyze import analyze
from gridlark.operators.metadata import metadata
from gridlark.operators.profile import profile
from gridlark.sources.workbook import cells, files

from .books import HEAD, MAIN, REL, Error, Formula, book, day, sheet_xml

CROSSTAB = {1: ["Metric", "Q4 2025", "Q3 2025", "Q2 2025"], 2: ["Revenue", 1.0, 2.0, 3.0], 3: ["Cost", 1.0, 2.0, 3.0], 4: ["Profit", 1.0, 2.0, 3.0], 7: ["Product", "Units", "Price"], 8: ["a", 1.0, 2.0], 9: ["b", 3.0, 4.0]}


def test_regions(spark):
    found = regions.regions(cells(files(spark, book({"S": CROSSTAB})))).orderBy("number").collect()
    assert [(r.kind, r.first_row, r.last_row, r.header_rows, r.key_column) for r in found] == [("Crosstab", 1, 4, [1], 1), ("DataTable", 7, 9, [7], 0)]


@pytest.mark.parametrize(("text", "like"), [("12", True), ("FY 2023", True), ("Q1", True), ("q", False), ("Price", False), ("", False), ("1850", True), ("x1850", False)])
def test_value_like(text, like):
    assert regions.value_like(text) == like


def test_header_auto(spark):
    rows = {1: ["Report"], 4: ["Region", "Units", "Amount"], 5: ["x", 1.0, 2.0], 6: ["y", 3.0, 4.0], 7: ["x", 5.0, 6.0]}
    found = Workbook.open(spark, book({"S": rows}))
    assert found.execute_query("FROM S!A1:C7 HEADER AUTO SELECT SUM(Amount) GROUP BY Region").rows() == [("x", 8), ("y", 4)]
    two = Workbook.open(spark, book({"S": {1: ["Region", "Units"], 2: ["x", 1.0], 3: ["y", 2.0], 4: ["z", 3.0], 7: ["Product", "Revenue"], 8: ["p", 10.0], 9: ["q", 20.0], 10: ["r", 30.0]}}))
    assert two.execute_query("FROM S!A7:B10 HEADER AUTO SELECT SUM(Revenue)").rows() == [(60,)]


def test_formulas(spark):
    rows = {1: [Formula("Other!A1+'My Sheet'!B2+Other!C3", 1), Formula("[Book.xlsx]Data!A1", 2), Formula('"Text!A1"&S!A1', "x")], 2: [Formula("SUM(other!A1)", 3, array=True), 5.0]}
    long = cells(files(spark, book({"S": rows, "Other": {1: [1.0]}})))
    found = {(r.target_workbook, r.target_sheet): r.formula_count for r in formulas.dependencies(long).collect()}
    assert found == {(None, "Other"): 2, (None, "My Sheet"): 1, ("[Book.xlsx]", "Data"): 1}
    assert [tuple(r)[2:] for r in formulas.counts(long).collect()] == [(4, 1)]
    texts = Workbook.open(spark, book({"S": rows}), mode="formulas")
    assert texts.read_cell("S", "A2") == "SUM(other!A1)" and texts.read_cell("S", "B2") == 5


def test_profile_of_cells(spark):
    rows = {i: [["EMEA", "APAC", "AMER"][i % 3], 10.0 * i, day("2024-01-01"), Error("#N/A") if i == 2 else 1.0, i % 2 == 0] for i in range(1, 13)}
    found = {r.column_index: r for r in profile(Workbook.open(spark, book({"S": rows})).sheet("S")).collect()}
    assert found[1].distinct_values == ["AMER", "APAC", "EMEA"] and found[1].dominant_type == "Text" and found[1].max_text_length == 4
    assert (found[2].min_numeric, found[2].max_numeric, found[2].distinct_estimate) == (10, 120, 12)
    assert found[3].distinct_values == ["2024-01-01"] and found[4].non_empty_count == 12 and found[4].number_count == 11
    assert found[5].distinct_values == ["FALSE", "TRUE"] and found[1].inferred_header is None


def test_metadata(spark):
    after = '<mergeCells count="1"><mergeCell ref="A1:B1"/></mergeCells><conditionalFormatting sqref="A1"/><dataValidations><dataValidation type="list" sqref="C1"><formula1>"a,b"</formula1></dataValidation></dataValidations><hyperlinks><hyperlink ref="D1" location="S!A1"/></hyperlinks>'
    extra = {
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships><Relationship Id="r1" Type="{REL}/table" Target="../tables/table1.xml"/><Relationship Id="r2" Type="{REL}/comments" Target="../comments1.xml"/><Relationship Id="r3" Type="{REL}/drawing" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/tables/table1.xml": f'{HEAD}<table {MAIN} displayName="T1" ref="A1:B3"><tableColumns><tableColumn name="x"/><tableColumn name="y"/></tableColumns></table>',
        "xl/comments1.xml": f'{HEAD}<comments {MAIN}><commentList><comment ref="A1"><text><r><t>note</t></r></text></comment></commentList></comments>',
        "xl/drawings/drawing1.xml": f"{HEAD}<wsDr/>",
        "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships><Relationship Id="r1" Type="{REL}/chart" Target="../charts/chart1.xml"/></Relationships>',
        "xl/charts/chart1.xml": f"{HEAD}<chart><title><t>Sales</t></title><f>S!A1:A3</f></chart>",
    }
    names = '<definedNames><definedName name="All">S!A1:B3</definedName><definedName name="Own" localSheetId="0">S!A1</definedName></definedNames>'
    content = book({"S": sheet_xml({1: ["x", "y"], 2: [1.0, 2.0]}, after).replace("<sheetData>", '<dimension ref="A1:Z9"/><sheetData>')}, extra=extra, names=names)
    found = {(r.kind, r.name, r.ref, tuple(r.parts), r.detail) for r in metadata(files(spark, content)).collect()}
    assert found == {
        ("dimension", None, "A1:Z9", (), None), ("merge", None, "A1:B1", (), None), ("conditional", None, "A1", (), None), ("validation", "list", "C1", (), '"a,b"'),
        ("hyperlink", None, "D1", (), "S!A1"), ("table", "T1", "A1:B3", ("x", "y"), None), ("comment", None, "A1", (), "note"), ("drawing", None, "xl/drawings/drawing1.xml", (), None),
        ("chart", "Sales", "xl/charts/chart1.xml", ("S!A1:A3",), None), ("name", "All", "S!A1:B3", (), None), ("name", "Own", "S!A1", (), None),
    }
    whole = analyze(files(spark, content))
    assert [r.message for r in whole.warnings.collect()] == ["The sheet declares A1:Z9, but its cells fill A1:B2."]
    seen = whole.observed.first()
    assert (seen.cell_count, seen.row_count, seen.column_count, seen.formula_count) == (4, 2, 2, 0)
    assert whole.headers.first().header_row == 1
