"""What plans and readers leave out: joins, single partitions, columns and rows that a query doesn't need."""

import asyncio

import pytest

from gridlark.api import QueryAggregates as A
from gridlark.api import Workbook
from gridlark.errors import TooManyGroups
from gridlark.sources import columns
from gridlark.sources.xlsx import open_package

from .books import Error, Formula, book, day, sheet_xml


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("files"))
    rows = spark.range(0, 1000, 1, 4).selectExpr("id AS k", "id % 10 AS g", "concat('t', id) AS name")
    rows.write.parquet(f"{folder}/many.parquet")
    rows.coalesce(1).write.parquet(f"{folder}/one.parquet")
    return folder


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def query(spark, folder, text, name="many", **options):
    return Workbook.of_tables(spark, folder, name).execute_query(text.replace("T!", f"{name}!A1:C1048576 HEADER ROW 1"), **options)


def test_several_files_join_only_for_row_numbers(spark, folder):
    plan = physical(query(spark, folder, "FROM T! SELECT name WHERE k > 5", ordered=False).named())
    assert "Join" not in plan and "SinglePartition" not in plan and "Exchange" not in plan
    grouped = query(spark, folder, "FROM T! SELECT g, COUNT() AS n GROUP BY g", ordered=False).named()
    main = physical(grouped).split("Subquery")[0]
    assert "Join" not in physical(grouped) and "SinglePartition" not in main
    assert {r.g: r.n for r in grouped.collect()} == {float(i): 100.0 for i in range(10)}
    assert "Join" in physical(query(spark, folder, "FROM T! SELECT name", ordered=True).named())


def test_row_numbers_of_several_files(spark, folder):
    rows = query(spark, folder, "FROM T! SELECT k").df.collect()
    assert [r[0] for r in rows] == list(range(2, 1002)) and [r[1] for r in rows] == [float(i) for i in range(1000)]


@pytest.mark.parametrize("name", ["one", "many"])
def test_first_rows(spark, folder, name):
    result = query(spark, folder, "FROM T! SELECT k WHERE g = 3 LIMIT 4", name)
    assert result.rows() == [(3.0,), (13.0,), (23.0,), (33.0,)]
    assert (result.early is not None) == (name == "one")
    if name == "one":
        assert "CollectLimit" in physical(result.early) and "Sort" not in physical(result.early)


def test_group_count_shares_the_shuffle(spark, folder):
    df = query(spark, folder, "FROM T! SELECT g, SUM(k) AS s GROUP BY g", ordered=False).named()
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_group_cap(spark, folder):
    fluent = Workbook.of_tables(spark, folder, "many").query_range("many", "A1:C1048576", 1).group_by("k").select(A.count())
    with pytest.raises(TooManyGroups):
        fluent.with_group_limit(999).execute().rows()
    assert len(fluent.with_group_limit(1000).execute().rows()) == 1000


def mixed_rows():
    rows = {1: ["n", "t", "d", "b", "e", "f"]}
    for r in range(2, 400):
        rows[r] = [r / 3, f"x & {r}", day("2024-01-15"), r % 2 == 0, Error("#N/A") if r % 5 == 0 else None, Formula("A1+1", 2.0) if r == 300 else 1.5e-7]
    return rows


def decoded(content, size, monkeypatch):
    monkeypatch.setattr(columns, "PIECE", size)
    out = []
    for c in columns.pieces(open_package(content), "S"):
        parts = [x.to_pylist() for x in c.parts()]
        out += list(zip(c.row.tolist(), c.column.tolist(), *parts, c.has_formula.tolist()))
    return out


def test_pieces_like_single_cells(monkeypatch):
    """Usual, unusual and mixed markup, cut anywhere, gives the cells that one scan gives."""
    odd = sheet_xml(mixed_rows()).replace('<row r="50">', '<row r="50"><!-- c --><c><v><![CDATA[7]]></v></c>').replace('<c r="A60">', '<c  r="A60" >')
    for content in (book({"S": mixed_rows()}), book({"S": odd}), book({"S": sheet_xml(mixed_rows()).replace("sheetData", "x:sheetData").replace("<worksheet", '<worksheet xmlns:x="u"')})):
        cells = [(c.row, c.column, c.kind) for c in open_package(content).cells("S")]
        whole = decoded(content, 1 << 30, monkeypatch)
        assert [x[:3] for x in whole] == cells and len(cells) > 1900
        assert decoded(content, 200, monkeypatch) == whole
        assert columns.width(open_package(content), "S") == max(c[1] for c in cells)


def test_workbook_columns_and_first_rows(spark, monkeypatch):
    opened = Workbook.open(spark, book({"S": mixed_rows()}))
    asked = []
    sheet = opened.sheet("S")
    narrow = sheet.narrow
    sheet.narrow = lambda c: asked.append(c) or narrow(c)
    result = opened.execute_query("FROM S!A1:F500 HEADER ROW 1 SELECT n, b AS flag WHERE t != \"x & 2\" LIMIT 3")
    assert result.rows() == [(1.0, False), (4 / 3, True), (5 / 3, False)] and asked == [[1, 2, 4]]
    assert opened.execute_query("FROM S!A1:F500 HEADER ROW 1 SELECT COUNT() AS k, SUM(n) AS s HAVING k > 0").rows()[0][0] == 398.0
    assert opened.read_cell("S", "B7") == "x & 7" and opened.read_cell("S", "C7") == day("2024-01-15") and opened.read_cell("S", "E10") == "#N/A"


def test_table_range_has_its_header(spark, folder):
    rows = Workbook.of_tables(spark, folder, "one").read_range("one", "A1:D3").collect()
    assert [[None if c is None else c.text if c.kind == 1 else c.num for c in r[1:]] for r in rows] == [["k", "g", "name", None], [0.0, 0.0, "t0", None], [1.0, 1.0, "t1", None]]


def test_async_entry_points(spark):
    async def run():
        opened = await Workbook.open_async(spark, book({"S": mixed_rows()}))
        result = await opened.execute_query_async("FROM S!A1:F500 HEADER ROW 1 SELECT n LIMIT 2")
        fluent = await opened.query_range("S", "A1:F500", 1).select(A.count()).execute_async()
        streamed = [r async for r, _ in opened.stream_rows_async("S", "A1:A5")]
        return await result.rows_async(), await fluent.rows_async(), streamed

    assert asyncio.run(run()) == ([(2 / 3,), (1.0,)], [(398.0,)], [1, 2, 3, 4, 5])
