"""Tables that take more sheets than one."""

from datetime import datetime

import pytest

from gridlark import sheet_queries
from gridlark.api import Workbook
from gridlark.sources import columns
from gridlark.sources.workbook import cells, files
from gridlark.sources.xlsx import open_package

N = 1000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("books"))
    day = datetime(2024, 1, 2)
    spark.createDataFrame([(i, f"nation {i}", 0) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(i, f"supplier {i}", i, 1.5) for i in range(130)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    orders = [(i, i, "FO"[i % 2], 2000.0 - i if i % 3 else 1.0, day, "low") for i in reversed(range(N))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i, f"customer {i}", 0, None if i % 7 == 0 else 1.0, "AB"[i % 2]) for i in range(N)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return folder


@pytest.fixture(params=[(100, 1 << 18), (1 << 16, 90)])
def small(request, monkeypatch):
    """Sheets that hold 400 rows; ranges of about 100 rows, and one range of several workbooks."""
    monkeypatch.setattr(sheet_queries, "END", 400)
    monkeypatch.setattr(sheet_queries, "ROWS", request.param[0])
    monkeypatch.setattr(sheet_queries, "LARGEST", request.param[1])


def test_group(spark, folder, small):
    assert sheet_queries.whole_books(spark, folder, "orders").count() > 5
    found = {r.o_orderstatus: r for r in sheet_queries.QUERIES["xlsx_group"](spark, folder).collect()}
    price = lambda i: 2000.0 - i if i % 3 else 1.0
    assert {s: (r.n, r.total, r.last) for s, r in found.items()} == {s: (500, sum(map(price, range(k, N, 2))), datetime(2024, 1, 2)) for k, s in enumerate("FO")}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert sheet_queries.QUERIES["xlsx_group"](spark, str(tmp_path)).collect() == sheet_queries.QUERIES["xlsx_limit"](spark, str(tmp_path)).collect() == []


def test_cells(spark, folder, small):
    found = {r.sheet: (r.n, r.rows, r.columns, r.numbers) for r in sheet_queries.QUERIES["xlsx_cells"](spark, folder).collect()}
    assert found == {"nation": (78, 26, 3, 50), "supplier": (524, 131, 4, 390), "orders": (6 * N + 6, N + 1, 6, 3 * N)}
    again = cells(files(spark, sheet_queries.whole_books(spark, folder, "orders"))).where("column = 1").orderBy("row").collect()
    assert [(r.row, r.num, r.text) for r in again] == [(1, None, "o_orderkey"), *((i + 2, i, None) for i in range(N))]


def test_limit(spark, folder, small):
    first = [(float(i), 2000.0 - i) for i in range(N) if i % 3 and i < 1000][:10]
    assert [tuple(r) for r in sheet_queries.QUERIES["xlsx_limit"](spark, folder).collect()] == first
    book = Workbook.open(spark, sheet_queries.whole_books(spark, folder, "orders"))
    rows = book.execute_query(f"FROM orders!A1:F{sheet_queries.LAST} HEADER ROW 1 SELECT o_orderkey WHERE o_orderkey >= 150 LIMIT 500").rows()
    assert rows == [(float(i),) for i in range(150, 650)]


def test_single_cells(spark, folder, small):
    assert [tuple(r) for r in sheet_queries.QUERIES["xlsx_read_cell"](spark, folder).collect()] == [("s_suppkey", "supplier 0", 129.0, True)]
    profiled = {r.inferred_header: r for r in sheet_queries.QUERIES["xlsx_profile"](spark, folder).collect()}
    assert profiled["s_suppkey"].number_count == 130 and profiled["s_suppkey"].max_numeric == 129 and profiled["s_name"].text_count == 131


def test_binary_group(spark, folder, small):
    found = {r.c_mktsegment: (r.n, r.total, r.format) for r in sheet_queries.QUERIES["xlsb_group"](spark, folder).collect()}
    assert found == {s: (500, float(sum(i % 7 > 0 for i in range(k, N, 2))), "xlsb") for k, s in enumerate("AB")}


def test_rows_stay_whole(monkeypatch):
    """A binary sheet's cells come in pieces that end with rows; a row in two pieces would count twice."""
    monkeypatch.setattr(columns, "CELLS", 7)
    body = b"".join(sheet_queries.binary_row(r, [float(r), "x", None if r % 3 else 1.0]) for r in range(1, 30))
    package = open_package(sheet_queries.binary_zipped({"S": body}))
    seen = [set(c.row.tolist()) for c in columns.pieces(package, "S")]
    assert len(seen) > 5 and sum(map(len, seen)) == len(set().union(*seen)) == 29
