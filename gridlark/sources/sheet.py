"""Sheets: rows with a sheet row number and one column per sheet column, typed or made of cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kinds import CELL, Value, typed
from ..plans.address import MAX_ROWS, Range, letters

ROW = "_row_index"


def physical(column: int) -> str:
    return f"c{column}"


@dataclass
class Sheet:
    """df has ROW and the physical columns c1..cN. names: the header of a table, which stands in row 1.

    in_order: partitions, and the rows in them, follow one another by ROW. narrow: df with some columns only, for
    sources that Catalyst can't prune.
    """

    name: str
    df: DataFrame
    width: int
    names: list[str] | None = None
    extra: dict = field(default_factory=dict)
    in_order: bool = False
    narrow: Callable[[list[int]], DataFrame] | None = None

    def narrowed(self, columns: list[int]) -> Sheet:
        """The sheet for queries that need these columns only."""
        return self if self.narrow is None else replace(self, df=self.narrow(sorted({c for c in columns if c <= self.width})), narrow=None)

    def value(self, column: int) -> Value:
        """The values of a column; columns beyond the sheet are empty."""
        if column > self.width:
            return Value("empty", F.lit(None))
        return typed(F.col(physical(column)), self.df.schema[physical(column)].dataType)

    def rows(self, area: Range) -> DataFrame:
        """Rows of the area; a bottom at the format's limit means all rows, however many a table has."""
        out = self.df
        if area.top > (1 if self.names is None else 2):
            out = out.where(F.col(ROW) >= area.top)
        return out if area.bottom >= MAX_ROWS else out.where(F.col(ROW) <= area.bottom)

    def header_cells(self, area: Range, row: int) -> tuple[int, list[str | None]] | None:
        """(row number, display strings) of a row, or of the first present one for 0; None if there is none."""
        columns = range(area.left, min(area.right, self.width) + 1)
        if self.names is not None and (row == 1 or row == 0 and area.top == 1):
            return 1, [self.names[c - 1] for c in columns]
        found = self.df.where(F.col(ROW) == row) if row else self.rows(area)
        shown = [self.value(c).display.alias(physical(c)) for c in columns]
        found = found.select(ROW, *shown)
        first = (found if self.in_order else found.orderBy(ROW)).limit(1).collect()  # in order, later rows stay unread
        return (first[0][0], list(first[0][1:])) if first else None


def table_sheet(name: str, df: DataFrame, row_index: Column | None = None) -> Sheet:
    """A table as a sheet: its names in row 1, its rows from row 2. row_index: their order, from 0."""
    if row_index is None:
        row_index = F.monotonically_increasing_id()
    kinds = []
    for c in df.columns:
        try:
            typed(F.col(f"`{c}`"), df.schema[c].dataType)
            kinds.append(F.col(f"`{c}`"))
        except TypeError:  # no cell kind covers it: its cells are empty
            kinds.append(F.lit(None))
    index = (row_index + F.lit(2)).cast("long").alias(ROW)
    return Sheet(name, df.select(index, *(x.alias(physical(i)) for i, x in enumerate(kinds, 1))), len(df.columns), list(df.columns))


def parquet_sheet(spark: SparkSession, path: str, name: str) -> Sheet:
    """A Parquet table in file order. Row numbers come from file metadata, so scans stay prunable.

    Of several files each one's first row number is joined by its path. The paths are unique on that side, so
    the join goes from plans that need no row number.
    """
    df = spark.read.parquet(path)
    index = F.col("_metadata.row_index")
    if len(df.inputFiles()) > 1:
        from pyspark.sql import Window

        files = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        bases = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a file
        bases = bases.groupBy("file").agg(F.first("base").alias("_base"))
        own = df.select("*", F.col("_metadata.file_path").alias("_file"), index.alias("_index")).join(bases, F.col("_file") == F.col("file"), "left")
        sheet = table_sheet(name, own.select(*(f"`{c}`" for c in df.columns), (F.col("_base") + F.col("_index")).alias("_index")), F.col("_index"))
        return Sheet(name, sheet.df.drop(physical(sheet.width)), sheet.width - 1, df.columns)
    return replace(table_sheet(name, df, index), in_order=True)


def cell_sheet(name: str, df: DataFrame, extra: dict | None = None, **known) -> Sheet:
    """Rows of ROW and the cell structs c1..cN; the header is one of the rows."""
    return Sheet(name, df, sum(f.dataType == CELL for f in df.schema), None, extra or {}, **known)


def letters_of(area: Range) -> list[str]:
    return [letters(c) for c in range(area.left, area.right + 1)]
