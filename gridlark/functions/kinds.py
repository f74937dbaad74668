"""Cell kinds, and typed or dynamically typed Spark columns.

A column of known type is a Value of one kind, whose null is an empty cell. A column of cells is a
struct (kind, num, ts, bool, text); its kind may differ from row to row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .display import date_column, number_column

EMPTY, TEXT, NUMBER, DATE, BOOLEAN, ERROR, FORMULA = range(7)
NAMES = {"empty": EMPTY, "text": TEXT, "number": NUMBER, "date": DATE, "boolean": BOOLEAN, "error": ERROR, "formula": FORMULA}
CELL = T.StructType([
    T.StructField("kind", T.ByteType()),
    T.StructField("num", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("bool", T.BooleanType()),
    T.StructField("text", T.StringType()),
])
TYPES = {"number": T.DoubleType(), "text": T.StringType(), "date": T.TimestampNTZType(), "boolean": T.BooleanType()}
_FIELDS = {"number": ("num", NUMBER), "date": ("ts", DATE), "boolean": ("bool", BOOLEAN), "text": ("text", TEXT)}


def null(kind: str) -> Column:
    return F.lit(None).cast(TYPES.get(kind, T.DoubleType()))


def finite(x: Column) -> Column:
    """x unless it is NaN or infinite. NaN compares greater than all numbers, so one bound drops it."""
    return F.when(F.abs(x) < float("inf"), x)


@dataclass(frozen=True)
class Value:
    """kind: number, text, date, boolean, empty or cell. exact: a number column that can't hold NaN or infinities."""

    kind: str
    col: Column
    exact: bool = False

    def part(self, kind: str) -> Column:
        """The value where it is of this kind, else null."""
        if self.kind == kind:
            return self.col
        if self.kind != "cell":
            return null(kind)
        name, number = _FIELDS[kind]
        return F.when(self.col["kind"] == number, self.col[name])

    def may_be(self, kind: str) -> bool:
        return self.kind in (kind, "cell")

    @property
    def finite(self) -> Column:
        x = self.part("number")
        return x if self.exact and self.kind == "number" else finite(x)

    @property
    def missing(self) -> Column:
        if self.kind == "empty":
            return F.lit(True)
        return F.coalesce(self.col["kind"] == EMPTY, F.lit(True)) if self.kind == "cell" else self.col.isNull()

    @property
    def cell(self) -> Column:
        """As a cell struct; an empty cell is kind 0 with all fields null."""
        if self.kind == "cell":
            return self.col
        parts = {k: (self.col if k == self.kind else null(k)) for k in _FIELDS}
        number = F.lit(EMPTY) if self.kind == "empty" else F.when(self.col.isNull(), F.lit(EMPTY)).otherwise(F.lit(_FIELDS[self.kind][1]))
        return F.struct(number.cast("tinyint").alias("kind"), parts["number"].alias("num"), parts["date"].alias("ts"), parts["boolean"].alias("bool"), parts["text"].alias("text"))

    @property
    def display(self) -> Column:
        """The display string; null for an empty cell."""
        shown = {"number": number_column, "date": date_column, "boolean": lambda x: F.when(x, "TRUE").otherwise("FALSE"), "text": lambda x: x}
        if self.kind in shown:
            return F.when(self.col.isNotNull(), shown[self.kind](self.col))
        if self.kind == "empty":
            return null("text")
        by_kind = [F.when(self.col["kind"] == _FIELDS[k][1], f(self.part(k))) for k, f in shown.items()]
        other = [F.when(self.col["kind"] == k, F.concat(F.lit(p), self.col["text"])) for k, p in ((ERROR, "#ERROR: "), (FORMULA, "="))]
        return F.coalesce(*by_kind, *other)

    def order_keys(self, descending: bool = False) -> list[Column]:
        """Sort keys: empty cells last either way; numbers, dates, booleans, text, others, in this order either way; NaN below all numbers."""
        turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
        if self.kind != "cell":
            nan = [turn(~F.isnan(self.col))] if self.kind == "number" and not self.exact else []
            return [self.missing.asc(), *nan, turn(self.col)]
        kind = self.col["kind"]
        rank = F.when(kind == NUMBER, 0).when(kind == DATE, 1).when(kind == BOOLEAN, 2).when(kind == TEXT, 3).otherwise(4)
        return [self.missing.asc(), rank.asc(), turn(~F.isnan(self.col["num"])), *(turn(self.col[n]) for n in ("num", "ts", "bool", "text"))]


def typed(column: Column, kind: T.DataType) -> Value:
    """A native column as a value; kinds follow from its type."""
    if kind == CELL or isinstance(kind, T.StructType) and kind.fieldNames() == CELL.fieldNames():
        return Value("cell", column)
    if isinstance(kind, T.BooleanType):
        return Value("boolean", column)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return Value("text", column)
    if isinstance(kind, T.DoubleType):
        return Value("number", column)
    if isinstance(kind, T.FloatType):
        return Value("number", column.cast("double"))
    if isinstance(kind, T.NumericType):
        return Value("number", column.cast("double"), exact=True)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return Value("date", column.cast("timestamp_ntz"))
    if isinstance(kind, T.TimestampNTZType):
        return Value("date", column)
    if isinstance(kind, T.NullType):
        return Value("empty", column)
    raise TypeError(f"No cell kind covers {kind.simpleString()}.")
