"""Queries over whole tables as sheets."""

from datetime import datetime

import pytest

from gridlark import sheet_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    day = datetime(2024, 1, 2)
    spark.createDataFrame([(i, f"nation {i}", 0) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(i, f"supplier {i}", 0, 1.5) for i in range(130)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, i, "F", 2.0, day, "low") for i in range(450)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_whole_tables(spark, folder):
    (group,) = sheet_queries.QUERIES["xlsx_group"](spark, folder).collect()
    assert (group.o_orderstatus, group.n, group.total) == ("F", 450, 900.0)
    profiled = {r.inferred_header: r for r in sheet_queries.QUERIES["xlsx_profile"](spark, folder).collect()}
    assert profiled["s_suppkey"].number_count == 130 and profiled["s_suppkey"].max_numeric == 129
    assert {r.sheet: r.rows for r in sheet_queries.QUERIES["xlsx_cells"](spark, folder).collect()} == {"nation": 26, "supplier": 131, "orders": 451}


def test_larger_than_a_sheet(spark, folder, monkeypatch):
    monkeypatch.setattr(sheet_queries, "END", 400)
    with pytest.raises(ValueError, match="orders has 450 rows"):
        sheet_queries.whole_book(spark, folder, "orders")
