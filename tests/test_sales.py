"""The sales sheet: cell mode end to end, with the reference values of the fixtures."""

import pytest

from gridlark.api import QueryAggregates as A
from gridlark.api import Workbook
from gridlark.errors import QueryError, SheetNotFound, TooManyGroups
from gridlark.plans.ast import QuerySpec

from .books import day, sales


@pytest.fixture(scope="module")
def book(spark):
    return Workbook.open(spark, sales())


def run(book, text):
    return book.execute_query(text).rows()


FROM = "FROM Sales!A1:F11 HEADER ROW 1 "


def test_group_and_order(book):
    assert run(book, FROM + "SELECT SUM(Units) GROUP BY Region ORDER BY Region") == [("AMER", 22), ("APAC", 15), ("EMEA", 18)]
    assert [r[0] for r in run(book, FROM + "SELECT SUM(Units) GROUP BY Region")] == ["EMEA", "APAC", "AMER"]
    result = book.execute_query("SELECT Region, SUM(Units) AS total FROM Sales!A1:F11 HEADER ROW 1 GROUP BY Region HAVING total > 15 LIMIT 1")
    assert result.rows() == [("EMEA", 18)] and result.stats().first().rows_scanned == 10


@pytest.mark.parametrize(("way", "numbers"), [("ASC", [10, 25.75, 50, 60, 75, 100.5, 200.25, 300]), ("DESC", [300, 200.25, 100.5, 75, 60, 50, 25.75, 10])])
def test_mixed_order(book, way, numbers):
    assert [r[0] for r in run(book, FROM + f"SELECT COUNT() GROUP BY NetSales ORDER BY NetSales {way}")] == [*numbers, "n/a", None]


def test_diagnostics(book):
    found = book.execute_query(FROM + "SELECT SUM(NetSales), AVG(NetSales), MIN(NetSales)").diagnostics().collect()
    assert [tuple(r) for r in found] == [("NetSales", 1, [5])]


def test_three_valued_logic(book):
    assert run(book, FROM + "SELECT COUNT() AS n WHERE Units = 'wrong' OR TRUE") == [(10,)]
    assert run(book, FROM + "SELECT COUNT() AS n WHERE Units = 'wrong' AND FALSE") == [(0,)]
    assert run(book, FROM + "SELECT COUNT() AS n WHERE NOT NetSales > 60") == [(4,)]
    assert run(book, FROM + "SELECT COUNT() AS n WHERE NetSales IN (50, 'n/a')") == [(2,)]
    assert run(book, FROM + "SELECT COUNT() AS n WHERE NetSales NOT IN (50, 60)") == [(6,)]
    assert run(book, FROM + "SELECT COUNT() AS n WHERE NetSales IS EMPTY") == [(1,)]
    assert run(book, FROM + 'SELECT COUNT() WHERE Units != "1"') == [(0,)]


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("1 / 0", None), ("7 % 0", None), ("-7 % 3", -1), ("1e308 * 10", None), ("ROUND(1.005, 2)", 1.0), ("ROUND(2.5)", 3), ("ROUND(-2.5)", -3),
        ("ROUND(1, 16)", None), ("ABS(-2)", 2), ("COALESCE(NULL, 'a', 1)", "a"), ("COALESCE(NULL, NULL)", None), ("YEAR(DATE '2024-02-03')", 2024),
        ("DATE_TRUNC('month', DATE '2024-02-03')", day("2024-02-01")), ("1 = '1'", None), ("TRUE < FALSE", None), ("NOT NULL", None), ("NULL IS EMPTY", True),
        ("'' IS EMPTY", False), ("2 IN (1, 'a')", None), ("1 IN (1, 'a')", True), ("2 NOT IN (1)", True), ("MONTH('x')", None), ("TRUE OR 1", True), ("-'x'", None),
    ],
)
def test_constants(book, expression, value):
    assert run(book, f"SELECT {expression} AS x FROM Sales!A1:F2 HEADER ROW 1") == [(value,)]


def test_labels_and_names(book):
    assert book.execute_query(FROM + "SELECT region").columns == ["Region"]
    assert book.execute_query("SELECT region FROM Sales!A1:F11 HEADER ROW 1").columns == ["region"]
    assert book.execute_query("SELECT SUM(Units) / COUNT(), AVG(Units) FILTER (WHERE OnPromo) FROM Sales!A1:F11 HEADER ROW 1").columns == ["(Sum(Units) / Count())", "Average(Units) FILTER (WHERE OnPromo)"]
    assert book.execute_query(FROM + "SELECT * LIMIT 0").columns == ["Region", "Month", "NetSales", "Units", "OnPromo", "OrderDate"]
    with pytest.raises(QueryError, match="Region"):
        run(book, FROM + "SELECT Nowhere")
    with pytest.raises(SheetNotFound):
        run(book, "FROM Other!A1:B2 HEADER ROW 1 SELECT *")


def test_limits(book):
    assert [r[0] for r in run(book, FROM + "SELECT Units LIMIT 3")] == [1, 2, 3]
    assert run(book, FROM + "SELECT Units LIMIT 0") == []
    assert run(book, FROM + "SELECT COUNT() LIMIT 5") == [(10,)]
    assert [r[0] for r in run(book, FROM + "SELECT Units ORDER BY NetSales DESC LIMIT 2")] == [7, 2]
    with pytest.raises(TooManyGroups):
        book.execute_query(QuerySpec.parse(FROM + "SELECT COUNT() GROUP BY Region").with_group_limit(2)).rows()


def test_fluent_like_text(book):
    query = book.query_range("sales", "A1:F11", 1).where("Region", "=", "EMEA").where("Units", "<", 9.0).group_by("Month").select(A.sum("NetSales"), A.count()).order_by(A.sum("NetSales"), True)
    text = FROM + 'SELECT SUM(NetSales), COUNT() WHERE Region = "EMEA" AND Units < 9 GROUP BY Month ORDER BY SUM(NetSales) DESC'
    assert query.execute().rows() == run(book, text) == [("Feb", 200.25, 1), ("Jan", 110.5, 2)]
    assert [tuple(r) for r in book.query_range("Sales", "A1:F11").distinct_values("Region").collect()] == [("EMEA", 4), ("AMER", 3), ("APAC", 3)]
    with pytest.raises(ValueError):
        book.query_range("Sales", "A1:F11").where("OnPromo", "<", True)
    with pytest.raises(QueryError):
        book.query_range("Sales", "A1:F11").group_by("a").group_by("b")


def test_min_max_keep_the_first_kind(spark):
    from .books import book as make

    rows = {1: ["K", "V"], 2: ["a", 5.0], 3: ["a", day("2024-01-01")], 4: ["b", day("2024-02-01")], 5: ["b", 3.0], 6: ["c", "x"]}
    found = Workbook.open(spark, make({"S": rows}))
    result = found.execute_query("SELECT K, MIN(V), MAX(V) FROM S!A1:B6 HEADER ROW 1 GROUP BY K")
    assert result.rows() == [("a", 5, 5), ("b", day("2024-02-01"), day("2024-02-01")), ("c", None, None)]
    assert [tuple(r) for r in result.diagnostics().collect()] == [("V", 3, [3, 5, 6])]


def test_external_header_and_reading(spark):
    titled = Workbook.open(spark, sales(title=True))
    assert titled.execute_query("FROM Sales!A6:F12 HEADER ROW 2 SELECT SUM(Units)").rows() == [(49,)]
    assert titled.read_cell("sales", "A1") == "Sales Report 2024" and titled.read_cell("Sales", "Z9") is None
    dense = titled.read_range("Sales", "A1:B14").collect()
    assert len(dense) == 14 and dense[13][1] is None
    rows = list(titled.stream_rows("Sales"))
    assert rows[0][0] == 1 and rows[2] == (3, ["EMEA", "Jan", 100.5, 1, True, day("2024-01-15")])
    assert titled.sheet_names == ["Sales"] and titled.format == "xlsx" and not titled.is_date1904 and not titled.has_macros
