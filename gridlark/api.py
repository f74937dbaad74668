"""Entry points: workbooks of sheets, the fluent query and the query text."""

from __future__ import annotations

import asyncio
import datetime as dt
from collections.abc import AsyncIterator, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError, RangeTooLarge, SheetNotFound
from .functions.kinds import Value
from .plans import execute as plan
from .plans.address import MAX_CELLS, Range, parse_cell, parse_range
from .plans.ast import Agg, Binary, Col, Expr, Header, Lit, QuerySpec, Selection, key
from .sources.sheet import ROW, Sheet, parquet_sheet, physical, table_sheet
from .streaming.rows import plain, rows


class QueryAggregates:
    """Aggregates for SheetQuery.select."""

    @staticmethod
    def sum(column: str) -> Agg:
        return Agg("Sum", Col(column))

    @staticmethod
    def count() -> Agg:
        return Agg("Count")

    @staticmethod
    def min(column: str) -> Agg:
        return Agg("Min", Col(column))

    @staticmethod
    def max(column: str) -> Agg:
        return Agg("Max", Col(column))

    @staticmethod
    def average(column: str) -> Agg:
        return Agg("Average", Col(column))


class Workbook:
    """Sheets by name, whatever they come from."""

    def __init__(self, spark: SparkSession, sheets: list[Sheet], info: dict | None = None):
        self.spark, self.sheets, self.info = spark, sheets, info or {}

    @classmethod
    def of_tables(cls, spark: SparkSession, directory: str, *names: str) -> Workbook:
        """Parquet tables `<directory>/<name>.parquet` as sheets."""
        return cls(spark, [parquet_sheet(spark, f"{directory.rstrip('/')}/{n}.parquet", n) for n in names])

    @classmethod
    def of_frames(cls, spark: SparkSession, **frames: DataFrame) -> Workbook:
        return cls(spark, [table_sheet(n, df) for n, df in frames.items()])

    @classmethod
    def open(cls, spark: SparkSession, source: str | bytes | DataFrame, mode: str = "values") -> Workbook:
        """An xlsx, xlsm or xlsb file: a path that Spark can read, the bytes, or a relation (workbook, content)."""
        from .sources.workbook import open_workbook

        return open_workbook(cls, spark, source, mode)

    @classmethod
    async def open_async(cls, spark: SparkSession, source: str | bytes | DataFrame, mode: str = "values") -> Workbook:
        return await asyncio.to_thread(cls.open, spark, source, mode)

    @property
    def sheet_names(self) -> list[str]:
        return [s.name for s in self.sheets]

    @property
    def is_date1904(self) -> bool:
        return bool(self.info.get("date1904"))

    @property
    def format(self) -> str:
        return self.info.get("format", "table")

    @property
    def has_macros(self) -> bool:
        return bool(self.info.get("macros"))

    def sheet(self, name: str) -> Sheet:
        for s in self.sheets:
            if s.name.lower() == name.lower():
                return s
        raise SheetNotFound(f"There is no sheet '{name}'.")

    def read_cell(self, sheet: str, address: str):
        """The value of one cell: None, float, str, datetime or bool."""
        column, row = parse_cell(address)
        found = self.sheet(sheet)
        if found.names is not None and row == 1:
            return found.names[column - 1] if column <= found.width else None
        found_rows = found.narrowed([column]).df.where(F.col(ROW) == row).select(found.value(column).col.alias("v")).limit(1).collect()
        return plain(found_rows[0][0]) if found_rows else None

    def read_range(self, sheet: str, area: str | Range) -> DataFrame:
        """The dense rectangle: every row of the range, absent ones with empty cells.

        A table's header stands in row 1; a range with that row has cells, since it holds text over other kinds.
        """
        found, area = self.sheet(sheet), parse_range(area) if isinstance(area, str) else area
        if area.unbounded or area.width * area.height > MAX_CELLS:
            raise RangeTooLarge(f"{area} has too many cells.")
        numbers = range(area.left, area.right + 1)
        found = found.narrowed(list(numbers))
        if found.names is not None and area.top == 1:
            present = found.rows(area).select(ROW, *(found.value(c).cell.alias(physical(c)) for c in numbers))
            head = [Value("text", F.lit(found.names[c - 1])) if c <= found.width else Value("empty", F.lit(None)) for c in numbers]
            present = present.union(self.spark.range(1, 2).select("id", *(v.cell for v in head)))
        else:
            present = found.rows(area).select(ROW, *(found.value(c).col.alias(physical(c)) for c in numbers))
        every = self.spark.range(area.top, area.bottom + 1).select(F.col("id").alias(ROW))
        return every.join(present, ROW, "left").orderBy(ROW)

    def stream_rows(self, sheet: str, area: str | Range = ":") -> Iterator[tuple[int, list]]:
        """(row number, values) of the present rows, in order, one partition at a time."""
        return rows(self.sheet(sheet), parse_range(area) if isinstance(area, str) else area)

    async def stream_rows_async(self, sheet: str, area: str | Range = ":") -> AsyncIterator[tuple[int, list]]:
        """The same without holding up the event loop; at most one partition is read ahead."""
        found, end = self.stream_rows(sheet, area), object()
        while (row := await asyncio.to_thread(next, found, end)) is not end:
            yield row

    def query_range(self, sheet: str, area: str, header_row: int = 0) -> SheetQuery:
        spec = QuerySpec(self.sheet(sheet).name, parse_range(area), Header("row", header_row), select_all=True, simple=True)
        if header_row > spec.range.bottom:
            raise ValueError("The header row lies below the range.")
        return SheetQuery(self, spec)

    def execute_query(self, query: str | QuerySpec, ordered: bool = True) -> plan.Result:
        spec = QuerySpec.parse(query) if isinstance(query, str) else query
        sheet = self.sheet(spec.sheet)
        return plan.execute(sheet, spec, self._header_row(sheet, spec), ordered)

    async def execute_query_async(self, query: str | QuerySpec, ordered: bool = True) -> plan.Result:
        return await asyncio.to_thread(self.execute_query, query, ordered)

    def _header_row(self, sheet: Sheet, spec: QuerySpec) -> int:
        if spec.header.kind == "column":
            raise NotImplementedError("HEADER COLUMN can be parsed but not run.")
        if spec.header.kind == "row":
            return spec.header.row
        if sheet.names is not None:
            return 1
        from .operators.regions import header_row_for

        return header_row_for(sheet, spec.range)


class SheetQuery:
    """A query built step by step; execute() runs it."""

    def __init__(self, workbook: Workbook, spec: QuerySpec):
        self.workbook, self.spec = workbook, spec
        self._projected: list[str] = []
        self._aggregates: list[Agg] = []

    def _with(self, **changes) -> SheetQuery:
        self.spec = replace(self.spec, **changes)
        return self

    def where(self, column: str, op: str, value: float | str | bool | dt.datetime) -> SheetQuery:
        op = {"==": "=", "<>": "!="}.get(op, op)
        if isinstance(value, bool):
            if op not in ("=", "!="):
                raise ValueError("Boolean values are only equal or not.")
            found = Lit("boolean", value)
        elif isinstance(value, str):
            found = Lit("text", value)
        elif isinstance(value, (dt.datetime, dt.date)):
            found = Lit("date", value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day))
        else:
            found = Lit("number", float(value))
        one: Expr = Binary(op, Col(column), found)
        return self._with(where=one if self.spec.where is None else Binary("AND", self.spec.where, one))

    def group_by(self, column: str) -> SheetQuery:
        if self.spec.group_by:
            raise QueryError("The query is grouped already.")
        return self._with(group_by=(Col(column),))

    def order_by(self, by: str | Agg, descending: bool = False) -> SheetQuery:
        if self.spec.order_by is not None:
            raise QueryError("The query is ordered already.")
        return self._with(order_by=Col(by) if isinstance(by, str) else by, descending=descending)

    def select(self, *aggregates: Agg) -> SheetQuery:
        if not aggregates:
            raise ValueError("Some aggregate is needed.")
        self._aggregates += aggregates
        return self

    def project(self, *columns: str) -> SheetQuery:
        if not columns:
            raise ValueError("Some column is needed.")
        self._projected += columns
        return self

    def take(self, n: int) -> SheetQuery:
        if n < 0:
            raise ValueError("A limit is not negative.")
        return self._with(limit=n)

    def with_group_limit(self, n: int | None) -> SheetQuery:
        return self._with(max_groups=self.spec.with_group_limit(n).max_groups)

    def with_stats(self, profiles: DataFrame | list[dict]) -> SheetQuery:
        """Column profiles; a numeric filter outside a column's bounds then gives an empty result without a scan."""
        known = [r.asDict() for r in profiles.collect()] if isinstance(profiles, DataFrame) else profiles  # one row a column
        return self._with(stats=tuple(known))

    def build(self) -> QuerySpec:
        if self._projected and self._aggregates:
            raise QueryError("A query has columns or aggregates, not both.")
        if self.spec.group_by and not self._aggregates:
            raise QueryError("Groups need some aggregate.")
        order, groups = self.spec.order_by, self.spec.group_by
        if order is not None:
            if not groups and self._aggregates:
                raise QueryError("A global aggregate is one row and takes no order.")
            if not groups and (self.spec.limit is None or isinstance(order, Agg)):
                raise QueryError("OrderBy on row results takes a column and requires Take.")
            if groups and key(order) not in [*map(key, groups), *map(key, self._aggregates)]:
                raise QueryError("Unknown ordering key.")
        chosen = tuple(map(Selection, self._aggregates or map(Col, self._projected)))
        return replace(self.spec, select_all=not chosen, selections=chosen)

    def execute(self, ordered: bool = True) -> plan.Result:
        spec = self.build()
        return plan.execute(self.workbook.sheet(spec.sheet), spec, spec.header.row, ordered)

    async def execute_async(self, ordered: bool = True) -> plan.Result:
        return await asyncio.to_thread(self.execute, ordered)

    def distinct_values(self, column: str, top: int = 100) -> DataFrame:
        if self.spec.order_by is not None:
            raise QueryError("Distinct values have their own order.")
        return plan.distinct_values(self.workbook.sheet(self.spec.sheet), self.spec, self.spec.header.row, column, top)
