"""Workbooks as Spark sheets: files are read by Spark and decoded sheet by sheet on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.kinds import CELL
from .columns import following, pieces, rows_of, width
from .sheet import ROW, cell_sheet, physical
from .xlsx import Package, open_package

#: Cells of a long-form relation.
CELLS = T.StructType([
    T.StructField("workbook", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType()), T.StructField("column", T.IntegerType()),
    *CELL.fields, T.StructField("is_formula", T.BooleanType()), T.StructField("is_array", T.BooleanType()), T.StructField("formula", T.StringType()),
])
SHEETS = T.StructType([T.StructField(n, t) for n, t in (("workbook", T.StringType()), ("sheet", T.StringType()), ("position", T.IntegerType()), ("format", T.StringType()), ("date1904", T.BooleanType()), ("macros", T.BooleanType()))])


def files(spark: SparkSession, source: str | bytes | DataFrame) -> DataFrame:
    """(workbook, content) of a path or glob that Spark reads, of bytes, or as given.

    Given ones may have `before`: how many rows each one's sheet has in workbooks before it, the header not counted.
    Sheets of one name are then one sheet, with as many rows as they have together; workbooks follow one another in
    order and are so small that each is one task.
    """
    if isinstance(source, DataFrame):
        return source.select("workbook", "content", *(c for c in source.columns if c == "before"))
    if isinstance(source, bytes):
        return spark.createDataFrame([("bytes", bytearray(source))], "workbook string, content binary")
    return spark.read.format("binaryFile").load(source).select(F.col("path").alias("workbook"), "content")


def sheets(files: DataFrame) -> DataFrame:
    """(workbook, sheet, position, format, date1904, macros) of all files."""
    arrow = to_arrow_schema(SHEETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = open_package(content)
                rows += [(name, s, i, p.format, p.date1904, p.has_macros) for i, s in enumerate(p.sheets)]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)

    return files.mapInArrow(run, SHEETS)


def each_sheet(batch: pa.RecordBatch) -> Iterator[tuple[str, Package, str, int]]:
    """(workbook, package, sheet, before) of the sheets that rows name, or of all where they name none."""
    for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
        package = open_package(row["content"])
        for sheet in [row["sheet"]] if "sheet" in row else package.sheets:
            yield row["workbook"], package, sheet, row.get("before") or 0


def cells(files: DataFrame, names: DataFrame | None = None, mode: str = "values") -> DataFrame:
    """Long form of all cells; one task decodes one sheet. names: (workbook, sheet) pairs, all by default."""
    tasks = files
    if names is not None or "before" not in files.columns:
        names = sheets(files).select("workbook", "sheet") if names is None else names
        tasks = files.join(names, "workbook").repartition("workbook", "sheet")
    arrow = to_arrow_schema(CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, package, sheet, before in each_sheet(batch):
                for found in following(pieces(package, sheet, mode == "formulas"), before):
                    n = len(found.row)
                    columns = [pa.array([name] * n), pa.array([sheet] * n), pa.array(found.row), pa.array(found.column), *found.parts()]
                    columns += [pa.array(found.has_formula), pa.array(found.array), pa.array(found.formula, pa.string())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return tasks.mapInArrow(run, CELLS)


def wide(files: DataFrame, sheet: str, columns: list[int], mode: str, keep_blank: bool) -> DataFrame:
    """Rows of one sheet in document order, with cell structs of these columns. keep_blank: rows of blank cells count as present."""
    schema = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(physical(i), CELL) for i in columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, package, name, before in each_sheet(batch):
                if name == sheet:
                    yield from rows_of(following(pieces(package, sheet, mode == "formulas"), before), columns, keep_blank, arrow)

    return files.mapInArrow(run, schema)


def widths(files: DataFrame) -> DataFrame:
    """SHEETS with `width`, each sheet's last column that has a cell; one task a sheet, which decodes no value."""
    if "before" in files.columns:
        known = files
    else:
        known = files.join(sheets(files).select("workbook", "sheet"), "workbook").repartition("workbook", "sheet")
    schema = T.StructType([*SHEETS, T.StructField("width", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, p, sheet, _ in each_sheet(batch):
                found = (name, sheet, list(p.sheets).index(sheet), p.format, p.date1904, p.has_macros, width(p, sheet))
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, found))], schema=arrow)

    return known.mapInArrow(run, schema)


def open_workbook(kind, spark: SparkSession, source: str | bytes | DataFrame, mode: str):
    """A Workbook of all sheets of one file, or of the sheets that files have together. One job learns the sheets' names and widths."""
    content = files(spark, source)
    found = widths(content)
    if "before" in content.columns:
        found = found.groupBy("sheet").agg(F.min("position").alias("position"), F.max("width").alias("width"), *(F.min_by(c, "workbook").alias(c) for c in ("format", "date1904", "macros")))
    rows = found.orderBy("position", "sheet").collect()
    out = []
    for r in rows:
        one = lambda columns, r=r: wide(content, r["sheet"], columns, mode, keep_blank=r["format"] != "xlsb")
        out.append(cell_sheet(r["sheet"], one(list(range(1, r["width"] + 1))), {"files": content, "mode": mode}, in_order=True, narrow=one))
    info = {"format": rows[0]["format"], "date1904": rows[0]["date1904"], "macros": rows[0]["macros"], "files": content} if rows else {"files": content}
    return kind(spark, out, info)
