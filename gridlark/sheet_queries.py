"""Queries over workbooks: whole tables are written into a package and read back as sheets; fixed sheets show what they have."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable
from datetime import date, datetime, timedelta
from decimal import Decimal
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Workbook
from .operators import formulas
from .operators.analyze import analyze
from .operators.layout import layout
from .operators.metadata import metadata
from .operators.profile import profile
from .operators.regions import regions
from .plans.address import MAX_ROWS, letters
from .plans.ast import QuerySpec
from .samples import SHEETS, rows_of
from .sources.workbook import cells, files

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
#: A sheet's last row, and the tables whose key isn't called like them.
END = 1_048_576
#: As an area's last row it means all rows, however many workbooks they take.
LAST = MAX_ROWS
KEYS = {"supplier": "supp", "orders": "order", "customer": "cust"}
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def cell(reference: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, str) and value.startswith("="):
        return f'<c r="{reference}"><f>{escape(value[1:])}</f><v>0</v></c>'
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, datetime):
        return f'<c r="{reference}" s="1"><v>{(value - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
    if isinstance(value, str):
        return f'<c r="{reference}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{reference}"><v>{value!r}</v></c>'


def package(sheets: dict[str, list[list]], after: str = "") -> bytes:
    """A workbook of rows from A1 on; text that begins with = is a formula. after: markup behind each sheet's cells."""
    body = lambda rows: "".join(f'<row r="{r}">{"".join(cell(f"{letters(c)}{r}", v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
    return zipped({n: body(rows) for n, rows in sheets.items()}, after)


def zipped(bodies: dict[str, str], after: str = "") -> bytes:
    """A package of sheets, each given by the markup of its rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(bodies, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(bodies) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{links}<Relationship Id="s" Type="{REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, body in enumerate(bodies.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData>{after}</worksheet>")
    return out.getvalue()


def xml_row(r: int, row: list) -> bytes:
    return f'<row r="{r}">{"".join(cell(f"{letters(c)}{r}", v) for c, v in enumerate(row, 1))}</row>'.encode()


def record(kind: int, data: bytes = b"") -> bytes:
    """A record of a binary workbook: kind and size in seven bits a byte, then the data."""
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size, count = b"", len(data)
    while count > 127:
        size, count = size + bytes([count & 0x7F | 0x80]), count >> 7
    return head + size + bytes([count]) + data


def wide(text: str) -> bytes:
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def binary_row(r: int, row: list) -> bytes:
    """A row's records: numbers, dates (style 1) and text."""
    out = [record(0, struct.pack("<I", r - 1))]
    for c, v in enumerate(row):
        if isinstance(v, str):
            out.append(record(6, struct.pack("<II", c, 0) + wide(v)))
        elif v is not None:
            day = isinstance(v, datetime)
            out.append(record(5, struct.pack("<IId", c, day, (v - datetime(1899, 12, 30)) / timedelta(days=1) if day else v)))
    return b"".join(out)


def binary_zipped(bodies: dict[str, bytes]) -> bytes:
    """A binary package of sheets, each given by the records of its rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.bin"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.bin"/>' for i in range(1, len(bodies) + 1))
        z.writestr("xl/_rels/workbook.bin.rels", f'<Relationships>{links}<Relationship Id="s" Type="{REL}/styles" Target="styles.bin"/></Relationships>')
        z.writestr("xl/workbook.bin", record(153, bytes(8)) + b"".join(record(156, bytes(8) + wide(f"rId{i}") + wide(n)) for i, n in enumerate(bodies, 1)))
        z.writestr("xl/styles.bin", record(617) + record(47, struct.pack("<HH", 0, 0)) + record(47, struct.pack("<HH", 0, 14)) + record(619))
        for i, body in enumerate(bodies.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.bin", record(145) + body + record(146))
    return out.getvalue()


def whole_book(spark: SparkSession, sf_dir: str, *names: str, binary: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """A workbook with whole tables as sheets in order of their keys, as (workbook, content), and the sheets' last rows.

    Executors write it: a task writes a sheet's rows in pieces, another one packs the book. A sheet's rows are
    bounded by its format; a table that one sheet can't hold is an error.
    """
    last, parts = {}, None
    for number, name in enumerate(names, 1):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        last[name] = df.count() + 1
        if last[name] > END:
            raise ValueError(f"{name} has {last[name] - 1} rows; a sheet holds {END - 1} below its header")
        rows = df.repartition(1).sortWithinPartitions(f"{name[0]}_{KEYS.get(name, name)}key")
        part = rows.mapInArrow(sheet_parts(number, name, df.columns, binary_row if binary else xml_row), PARTS)
        parts = part if parts is None else parts.union(part)
    packed = parts.groupBy(F.lit("book").alias("workbook")).applyInArrow(pack_binary if binary else pack_book, "workbook string, content binary")
    return packed.persist(StorageLevel.DISK_ONLY), last


def whole_books(spark: SparkSession, sf_dir: str, *names: str, binary: bool = False) -> DataFrame:
    """Whole tables of any size as sheets in order of their keys, as (workbook, content, before).

    A table's rows are dealt out by ranges of its key; each range is a workbook of about ROWS rows below a header, or
    several if it has more than a sheet may hold or than LARGEST. So tasks are bounded, and sheets are written and read
    side by side. before: how many rows of the table come in earlier workbooks, for sources.workbook.files.
    """
    parts = None
    for number, name in enumerate(names, 1):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key = f"{name[0]}_{KEYS.get(name, name)}key"
        count = df.count()
        rows = df.repartitionByRange(max(1, -(-count // ROWS)), key).sortWithinPartitions(key)
        part = rows.mapInArrow(sheet_books(number, name, df.columns, min(LARGEST, END - 1), binary), BOOKS)
        if not count:
            part = spark.createDataFrame([(f"book {number:03d}", name, 0, packed(name, [binary_row(1, df.columns) if binary else xml_row(1, df.columns)], binary))], BOOKS)
        parts = part if parts is None else parts.union(part)
    parts = parts.persist(StorageLevel.DISK_ONLY)
    before, seen = [], dict.fromkeys(names, 0)
    for book, name, n in sorted(tuple(r) for r in parts.select("workbook", "sheet", "rows").collect()):  # one row a workbook
        before.append((book, seen[name]))
        seen[name] += n
    return parts.select("workbook", "content").join(F.broadcast(spark.createDataFrame(before, "workbook string, before long")), "workbook")


#: Rows of a table's workbook, about and at most.
ROWS, LARGEST = 1 << 16, 1 << 18
BOOKS = "workbook string, sheet string, rows long, content binary"
PARTS = "number int, sheet string, place long, body binary"


def cell_value(v):
    """Integers as numbers, dates and times without a zone."""
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day)
    return float(v) if isinstance(v, (int, Decimal)) else v


def sheet_parts(number: int, name: str, columns: list[str], line: Callable[[int, list], bytes]):
    """Rows to pieces of a sheet, the header first."""
    schema = pa.schema([("number", pa.int32()), ("sheet", pa.string()), ("place", pa.int64()), ("body", pa.binary())])
    part = lambda at, body: pa.record_batch([pa.array([x], f.type) for x, f in zip((number, name, at, body), schema)], schema=schema)

    def run(batches):
        yield part(1, line(1, columns))
        at = 2
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield part(at, b"".join(line(r, list(map(cell_value, row))) for r, row in enumerate(rows, at)))
            at += batch.num_rows

    return run


def packed(name: str, lines: list[bytes], binary: bool) -> bytearray:
    body = b"".join(lines)
    return bytearray(binary_zipped({name: body}) if binary else zipped({name: body.decode()}))


def sheet_books(number: int, name: str, columns: list[str], most: int, binary: bool):
    """Rows to workbooks of one sheet with a header and at most so many rows; their names are in order of tables and tasks."""
    schema = pa.schema([("workbook", pa.string()), ("sheet", pa.string()), ("rows", pa.int64()), ("content", pa.binary())])
    line = binary_row if binary else xml_row

    def run(batches):
        task, made, lines = TaskContext.get().partitionId(), 0, []

        def book():
            content = packed(name, [line(1, columns), *lines], binary)
            return pa.record_batch([pa.array([x], f.type) for x, f in zip((f"book {number:03d} {task:09d} {made:09d}", name, len(lines), content), schema)], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(lines) == most:
                    yield book()
                    made, lines = made + 1, []
                lines.append(line(len(lines) + 2, list(map(cell_value, row))))
        if lines:
            yield book()

    return run


def bodies_of(parts: pa.Table) -> dict[str, bytes]:
    ordered = parts.sort_by([("number", "ascending"), ("place", "ascending")])
    bodies: dict[str, list[bytes]] = {}
    for name, body in zip(ordered.column("sheet").to_pylist(), ordered.column("body").to_pylist()):
        bodies.setdefault(name, []).append(body)
    return {n: b"".join(x) for n, x in bodies.items()}


def pack_book(parts: pa.Table) -> pa.Table:
    return pa.table({"workbook": ["book"], "content": [zipped({n: x.decode() for n, x in bodies_of(parts).items()})]})


def pack_binary(parts: pa.Table) -> pa.Table:
    return pa.table({"workbook": ["book"], "content": [binary_zipped(bodies_of(parts))]})


STATEMENT = {
    "Model": [
        ["Income statement"], [None, 2023.0, 2024.0, 2025.0], ["Revenue", 100.0, 110.0, 120.0], ["Costs", 40.0, 45.0, 50.0], ["EBITDA", "=B3-B4", "=C3-C4", "=D3-Inputs!B2"], [], [],
        ["Product", "Units", "Price"], ["a", 1.0, 2.5], ["b", 3.0, 4.0],
    ],
    "Inputs": [["Rate", 0.5], ["Growth", 0.25], ["Tax", 0.3]],
}


def native(result, kinds: list[str]) -> DataFrame:
    """A result's cells by the kind that each column is known to have."""
    field = {"number": "num", "text": "text", "date": "ts"}
    return result.df.select(*(F.col(f"c{i}")[field[k]].alias(n) if k else F.col(f"c{i}").alias(n) for i, (n, k) in enumerate(zip(result.columns, kinds), 1)))


def xlsx_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    book, last = whole_book(spark, sf_dir, "nation")
    return native(Workbook.open(spark, book).execute_query(f"FROM nation!A1:C{last['nation']} HEADER ROW 1 SELECT n_name, n_regionkey WHERE n_regionkey >= 2", ordered=False), ["text", "number"])


def xlsx_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = f"SELECT o_orderstatus, COUNT() AS n, ROUND(SUM(o_totalprice), 2) AS total, MAX(o_orderdate) AS last FROM orders!A1:F{LAST} HEADER ROW 1 GROUP BY o_orderstatus"
    return native(Workbook.open(spark, whole_books(spark, sf_dir, "orders")).execute_query(QuerySpec.parse(query).with_group_limit(None), ordered=False), ["text", "", "", "date"])


def xlsx_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows that match, of which the sheet's rest stays unread."""
    result = Workbook.open(spark, whole_books(spark, sf_dir, "orders")).execute_query(f"FROM orders!A1:F{LAST} HEADER ROW 1 SELECT o_orderkey, o_totalprice WHERE o_totalprice > 1000 LIMIT 10")
    return spark.createDataFrame(result.rows(), "o_orderkey double, o_totalprice double")


def xlsx_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(Workbook.open(spark, whole_books(spark, sf_dir, "supplier")).sheet("supplier")).select("column_index", "inferred_header", "dominant_type", "non_empty_count", "number_count", "text_count", "max_numeric")


def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = whole_books(spark, sf_dir, "nation", "supplier", "orders")
    return cells(files(spark, book)).groupBy("sheet").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("rows"), F.max("column").alias("columns"), F.count("num").alias("numbers"))


def xlsb_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = Workbook.open(spark, whole_books(spark, sf_dir, "customer", binary=True))
    query = f"SELECT c_mktsegment, COUNT() AS n, ROUND(SUM(c_acctbal), 2) AS total FROM customer!A1:E{LAST} HEADER ROW 1 GROUP BY c_mktsegment"
    found = opened.execute_query(QuerySpec.parse(query).with_group_limit(None), ordered=False)
    return native(found, ["text", "", ""]).withColumn("format", F.lit(opened.format))


def xlsx_read_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell of each kind and the header; the table's last row is read from the workbook that it is in."""
    book = whole_books(spark, sf_dir, "supplier")
    before, count = book.agg(F.max("before")).first()[0], spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    opened, end = Workbook.open(spark, book), Workbook.open(spark, book.where(F.col("before") == before).drop("before"))
    found = [b.read_cell("supplier", a) for b, a in ((opened, "A1"), (opened, "B2"), (end, f"C{count - before + 1}"), (opened, "Z9"))]
    return spark.createDataFrame([(found[0], found[1], found[2], found[3] is None)], "header string, name string, nation double, empty boolean")


def xlsx_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are pulled, in order, counted on the way."""
    book, _ = whole_book(spark, sf_dir, "nation")
    rows = list(Workbook.open(spark, book).stream_rows("nation", "A2:B1048576"))
    return spark.createDataFrame([(r, float(v[0]), v[1]) for r, v in rows], "row long, key double, name string")


def xlsx_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two reading modes: a formula's text, and its value."""
    found = []
    for mode in ("values", "formulas"):
        sheet = Workbook.open(spark, package(STATEMENT), mode)
        found += [(mode, a, str(sheet.read_cell("Model", a))) for a in ("B5", "D5", "A5")]
    return spark.createDataFrame(found, "mode string, cell string, shown string")


def xlsx_header_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = Workbook.open(spark, package(STATEMENT)).execute_query("FROM Model!A8:C10 HEADER AUTO SELECT Product, Units * Price AS value")
    return native(result, ["text", ""])


def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(cells(files(spark, package(STATEMENT)))).select("sheet", "kind", "first_row", "last_row", "first_column", "last_column")


def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(cells(files(spark, package(STATEMENT)))).where("item = 'field'").select("sheet", "first_row", "last_row", "first_column", "last_column", F.size("axis_ids").alias("rank"))


def samples(spark: SparkSession) -> DataFrame:
    return cells(files(spark, package({n: rows_of(t) for n, t in SHEETS.items()})))


def a1_of(found: DataFrame) -> DataFrame:
    """found with its range as text; the sample sheets have fewer than 26 columns."""
    corner = lambda column, row: F.concat(F.char(F.col(column) + 64), F.col(row).cast("string"))
    return found.withColumn("area", F.concat_ws(":", corner("first_column", "first_row"), corner("last_column", "last_row")))


def layout_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of sheets of many shapes: matrices, dense and sibling fields, bands, vectors."""
    return a1_of(layout(samples(spark)).where(F.col("item") == "field").where(F.col("sheet").isin(list(FIELDS)))).select("sheet", "area", F.size("axis_ids").alias("rank"))


def layout_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that share axes, and the titles above them."""
    return layout(samples(spark)).where("item = 'group' and title is not null").select("sheet", "title", F.size("field_ids").alias("fields"))


def layout_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cells of each field hold, beside the sheets' own cells."""
    found = layout(samples(spark)).where("item = 'field' and sheet in ('Pricing', 'Units', 'Matrix')")
    return found.select("sheet", F.col("numeric_count").cast("long").alias("numbers"), F.col("min_numeric").alias("low"), F.col("max_numeric").alias("high"))


def layout_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes with their titles, roles, kinds and first samples."""
    found = a1_of(layout(samples(spark)).where(F.col("item") == "axis").where(F.col("sheet").isin("Siblings", "Years", "Matrix", "Caption")))
    return found.select("sheet", "area", "title", "orientation", "role", "value_kind", F.array_join("samples", "|").alias("shown"))


def layout_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of an axis, from label rows without figures."""
    found = layout(samples(spark)).where("item = 'axis' and sheet = 'Sections'")
    return found.select("sheet", F.inline("sections"))


def sheet_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.dependencies(cells(files(spark, package(STATEMENT)))).select("sheet", "target_sheet", "formula_count")


def sheet_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyze(files(spark, package(STATEMENT)))
    observed = found.observed.select("sheet", "cell_count", "row_count", "column_count", "formula_count")
    return observed.join(found.headers.select("sheet", F.col("header_row").cast("long").alias("header_row")), "sheet")


def workbook_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = '<mergeCells><mergeCell ref="A1:B1"/></mergeCells><hyperlinks><hyperlink ref="A2"/><hyperlink ref="A3"/></hyperlinks>'
    return metadata(files(spark, package(STATEMENT, merged))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (xlsx_project, xlsx_group, xlsx_limit, xlsx_profile, xlsx_cells, xlsb_group, xlsx_read_cell, xlsx_stream, xlsx_formulas, xlsx_header_auto, sheet_regions, sheet_layout, layout_fields, layout_groups, layout_axes, layout_sections, layout_profiles, sheet_formulas, sheet_analysis, workbook_metadata)}
ORACLES = {
    "xlsx_project": "SELECT n_name, CAST(n_regionkey AS DOUBLE) n_regionkey FROM nation WHERE n_regionkey >= 2",
    "xlsx_group": f"SELECT o_orderstatus, CAST(count(*) AS DOUBLE) n, round(sum(o_totalprice), 2) total, max(o_orderdate) AS last FROM orders GROUP BY 1",
    "xlsx_profile": "SELECT CAST(i AS INTEGER) column_index, h AS inferred_header, k AS dominant_type, n + 1 AS non_empty_count, CASE WHEN k = 'Number' THEN n ELSE 0 END AS number_count, CASE WHEN k = 'Text' THEN n + 1 ELSE 1 END AS text_count, m AS max_numeric FROM (WITH s AS (SELECT * FROM supplier) SELECT 1 i, 's_suppkey' h, 'Number' k, count(s_suppkey) n, CAST(max(s_suppkey) AS DOUBLE) m FROM s UNION ALL SELECT 2, 's_name', 'Text', count(s_name), NULL FROM s UNION ALL SELECT 3, 's_nationkey', 'Number', count(s_nationkey), max(s_nationkey) FROM s UNION ALL SELECT 4, 's_acctbal', 'Number', count(s_acctbal), max(s_acctbal) FROM s)",
    "xlsx_cells": f"SELECT 'nation' sheet, CAST(3 + count(*) * 3 AS BIGINT) n, CAST(count(*) + 1 AS BIGINT) AS rows, CAST(3 AS INTEGER) columns, count(*) * 2 numbers FROM nation UNION ALL SELECT 'supplier', 4 + count(*) * 4, count(*) + 1, 4, count(*) * 3 FROM supplier UNION ALL SELECT 'orders', 6 + count(*) * 6, count(*) + 1, 6, count(*) * 3 FROM orders",
    "xlsx_header_auto": "SELECT 'a' AS \"Product\", 2.5::DOUBLE AS value UNION ALL SELECT 'b', 12.0",
    "sheet_formulas": "SELECT 'Model' sheet, 'Inputs' target_sheet, CAST(1 AS BIGINT) formula_count",
    "workbook_metadata": "SELECT 'merge' AS kind, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'hyperlink', 4",
    "sheet_regions": "SELECT sheet, kind, CAST(a AS BIGINT) first_row, CAST(b AS BIGINT) last_row, CAST(c AS INTEGER) first_column, CAST(d AS INTEGER) last_column FROM (VALUES ('Model', 'TitleRow', 1, 1, 1, 1), ('Model', 'Crosstab', 2, 5, 1, 4), ('Model', 'DataTable', 8, 10, 1, 3), ('Inputs', 'ParameterBlock', 1, 3, 1, 2)) t(sheet, kind, a, b, c, d)",
    "sheet_analysis": "SELECT sheet, CAST(n AS BIGINT) cell_count, CAST(r AS BIGINT) row_count, CAST(c AS INTEGER) column_count, CAST(f AS BIGINT) formula_count, CAST(h AS BIGINT) header_row FROM (VALUES ('Model', 25, 10, 4, 3, 2), ('Inputs', 6, 3, 2, 0, 0)) t(sheet, n, r, c, f, h)",
    "sheet_layout": "SELECT sheet, CAST(a AS BIGINT) first_row, CAST(b AS BIGINT) last_row, CAST(c AS INTEGER) first_column, CAST(d AS INTEGER) last_column, CAST(r AS INTEGER) AS rank FROM (VALUES ('Model', 3, 4, 2, 4, 2), ('Model', 9, 10, 2, 3, 2), ('Inputs', 1, 3, 2, 2, 1)) t(sheet, a, b, c, d, r)",
}
#: Fields and their ranks as the rules give them.
FIELDS = {"Stacked": {"B3:D5": 2, "B9:D11": 2}, "Siblings": {"B2:D5": 2, "F2:G5": 2}, "Years": {"C2:D7": 3}, "Calendar": {"A2:G5": 1}, "Pricing": {"A2:D5": 1}, "Band": {"B3:E5": 2}, "Units": {"B2:D4": 2}, "Forecast": {"C2:G7": 3}, "Caption": {"B3:D5": 2}, "Matrix": {"B3:F7": 2}}
ORACLES |= {
    "layout_fields": "SELECT sheet, area, CAST(r AS INTEGER) AS rank FROM (VALUES " + ", ".join(f"('{s}', '{a}', {r})" for s, x in FIELDS.items() for a, r in x.items()) + ") t(sheet, area, r)",
    "layout_groups": "SELECT sheet, title, CAST(n AS INTEGER) AS fields FROM (VALUES ('Caption', 'Growth (%)', 1), ('Matrix', 'Sensitivity', 1), ('Stacked', 'Income statement', 1), ('Stacked', 'Balance sheet', 1)) t(sheet, title, n)",
    "layout_axes": "SELECT * FROM (VALUES ('Caption', 'B2:D2', 'Growth (%)', 'Horizontal', 'Primary', 'Text', 'Q1|Q2|Q3'), ('Caption', 'A3:A5', NULL, 'Vertical', 'Primary', 'Text', 'Foo|Bar|Baz'), ('Matrix', 'B2:F2', NULL, 'Horizontal', 'Primary', 'Numeric', '0.5|1|1.5'), ('Matrix', 'A3:A7', 'Sensitivity', 'Vertical', 'Primary', 'Numeric', '3.2|4.2|5.2'), ('Siblings', 'B1:D1', NULL, 'Horizontal', 'Primary', 'Numeric', '2023|2024|2025'), ('Siblings', 'F1:G1', NULL, 'Horizontal', 'Primary', 'Text', 'CAGR|Avg'), ('Siblings', 'A2:A5', NULL, 'Vertical', 'Primary', 'Text', 'Revenue|Costs|EBITDA'), ('Years', 'C1:D1', 'Year', 'Horizontal', 'Primary', 'Text', 'Assets|Deposits'), ('Years', 'A2:A7', NULL, 'Vertical', 'Primary', 'Text', 'Bank A|Bank A|Bank A'), ('Years', 'B2:B7', 'Year', 'Vertical', 'Context', 'Numeric', '2020|2021|2022')) t(sheet, area, title, orientation, role, value_kind, shown)",
    "layout_sections": "SELECT 'Sections' AS sheet, title, CAST(a AS BIGINT) first_row, CAST(b AS BIGINT) last_row FROM (VALUES ('Funding', 2, 5), ('Loans', 6, 9)) t(title, a, b)",
    "layout_profiles": "SELECT * FROM (VALUES ('Pricing', CAST(16 AS BIGINT), CAST(3.9 AS DOUBLE), CAST(40 AS DOUBLE)), ('Units', 9, 5, 14070), ('Matrix', 25, 3, 22)) t(sheet, numbers, low, high)",
    "xlsx_limit": "SELECT CAST(o_orderkey AS DOUBLE) o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 10",
    "xlsb_group": "SELECT c_mktsegment, CAST(count(*) AS DOUBLE) n, round(sum(c_acctbal), 2) total, 'xlsb' AS format FROM customer GROUP BY 1",
    "xlsx_read_cell": "SELECT 's_suppkey' header, arg_min(s_name, s_suppkey) AS name, CAST(arg_max(s_nationkey, s_suppkey) AS DOUBLE) nation, true AS empty FROM supplier",
    "xlsx_stream": "SELECT row_number() OVER (ORDER BY n_nationkey) + 1 AS \"row\", CAST(n_nationkey AS DOUBLE) AS key, n_name AS name FROM nation",
    "xlsx_formulas": "SELECT * FROM (VALUES ('values', 'B5', '0.0'), ('values', 'D5', '0.0'), ('values', 'A5', 'EBITDA'), ('formulas', 'B5', 'B3-B4'), ('formulas', 'D5', 'D3-Inputs!B2'), ('formulas', 'A5', 'EBITDA')) t(mode, cell, shown)",
}
