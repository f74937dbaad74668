"""Column profiles and used ranges of a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import ERROR, Value
from ..sources.sheet import ROW, Sheet

#: Distinct values that a profile lists at most.
LISTED = 32
#: Kinds in the order that breaks ties of the dominant type.
DOMINANT = ["Number", "Text", "Date", "Boolean", "Error"]


def _iso(x: Column) -> Column:
    midnight = x == F.date_trunc("day", x).cast("timestamp_ntz")
    return F.when(midnight, F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"))


def _cell(sheet: Sheet, c: int, value: Value) -> Column:
    """A long-form entry: column, rank of the kind among listed values, and the value as a key and as shown."""
    number, text, date, flag = (value.part(k) for k in ("number", "text", "date", "boolean"))
    kind = F.when(text.isNotNull(), 0).when(number.isNotNull(), 1).when(date.isNotNull(), 2).when(flag.isNotNull(), F.when(flag, 4).otherwise(3))
    return F.struct(F.lit(c).alias("column_index"), kind.alias("kind"), text.alias("text"), number.alias("num"), date.alias("ts"))


def profile(sheet: Sheet, listed: int = LISTED, formulas: DataFrame | None = None) -> DataFrame:
    """One row per column of the sheet, by two passes: conditional counts, and distinct values in long form.

    The counts are exact; values are deduplicated before they are shuffled. The header of a table isn't a
    row; that of a sheet of cells is. formulas: rows with column_index of cells that hold one.
    """
    spark, columns = sheet.df.sparkSession, range(1, sheet.width + 1)
    values = {c: sheet.value(c) for c in columns}
    aggregates = []
    for c, v in values.items():
        error = F.when(v.col["kind"] == ERROR, 1) if v.kind == "cell" else F.lit(None).cast("int")
        number, text = v.part("number"), v.part("text")
        counts = [F.count(x) for x in (number, text, v.part("date"), v.part("boolean"), error)]
        non_empty = F.count(F.when(~v.missing, 1))
        aggregates.append(F.struct(F.lit(c).alias("column_index"), *(x.alias(n) for n, x in zip(("number_count", "text_count", "date_count", "boolean_count", "error_count"), counts)), non_empty.alias("non_empty_count"), F.min(number).alias("min_numeric"), F.max(number).alias("max_numeric"), F.max(F.length(text)).alias("max_text_length")).alias(f"p{c}"))
    wide = sheet.df.agg(*aggregates).select(F.inline(F.array(*(f"p{c}" for c in columns))))
    cells = sheet.df.select(F.inline(F.array(*(_cell(sheet, c, v) for c, v in values.items())))).where("kind is not null")
    distinct = cells.groupBy("column_index", "kind", "text", "num", "ts").agg(F.lit(1).alias("_one"))
    counted = distinct.groupBy("column_index").agg(F.count(F.lit(1)).alias("distinct_estimate"))
    few = distinct.join(counted.where(F.col("distinct_estimate") <= listed), "column_index")
    shown = F.when(F.col("kind") == 0, F.col("text")).when(F.col("kind") == 1, Value("number", F.col("num")).display).when(F.col("kind") == 2, _iso(F.col("ts"))).when(F.col("kind") == 3, "FALSE").otherwise("TRUE")
    entries = F.sort_array(F.collect_list(F.struct("kind", "text", "num", "ts", shown.alias("shown"))))
    lists = few.groupBy("column_index").agg(F.transform(entries, lambda e: e["shown"]).alias("distinct_values"))
    heads = [(c, sheet.names[c - 1] if sheet.names is not None else None) for c in columns]
    if sheet.names is None:
        inferred = infer_header(sheet)
        heads = [(c, inferred[c - 1] if inferred else None) for c in columns]
    named = spark.createDataFrame(heads, "column_index int, inferred_header string")
    most = F.greatest(*(F.col(f"{k.lower()}_count") for k in DOMINANT))
    dominant = F.coalesce(*(F.when((F.col(f"{k.lower()}_count") == most) & (most > 0), k) for k in DOMINANT), F.lit("Empty"))
    has = (formulas.groupBy("column_index").agg(F.lit(True).alias("has_formulas")) if formulas is not None else spark.createDataFrame([], "column_index int, has_formulas boolean"))
    out = wide.join(named, "column_index").join(counted, "column_index", "left").join(lists, "column_index", "left").join(has, "column_index", "left")
    return out.select("column_index", "inferred_header", dominant.alias("dominant_type"), "non_empty_count", "text_count", "number_count", "date_count", "boolean_count", F.coalesce("distinct_estimate", F.lit(0)).alias("distinct_estimate"), "distinct_values", "min_numeric", "max_numeric", "max_text_length", F.coalesce("has_formulas", F.lit(False)).alias("has_formulas"))


def infer_header(sheet: Sheet) -> list[str | None] | None:
    """The first present row's texts, if all its cells are text and other rows follow."""
    rows = sheet.df.orderBy(ROW).limit(2).collect()
    if len(rows) < 2:
        return None
    cells = [rows[0][f"c{c}"] for c in range(1, sheet.width + 1)]
    present = [x for x in cells if x is not None and x["kind"]]
    if not present or any(x["kind"] != 1 for x in present):
        return None
    return [x["text"] if x is not None and x["kind"] else None for x in cells]


def used_range(sheet: Sheet) -> DataFrame:
    """One row: the box of non-empty cells, its extents and the number of cells. A table's header counts."""
    values = {c: sheet.value(c) for c in range(1, sheet.width + 1)}
    filled = {c: ~v.missing for c, v in values.items()}
    some = F.greatest(*(F.when(x, F.lit(1)).otherwise(0) for x in filled.values()), F.lit(0)) == 1
    first = [F.min(F.when(some, F.col(ROW))).alias("top"), F.max(F.when(some, F.col(ROW))).alias("bottom")]
    counts = [F.count(F.when(x, 1)).alias(f"n{c}") for c, x in filled.items()]
    found = sheet.df.agg(*first, *counts)
    names = sheet.names
    columns = {c: (F.col(f"n{c}") > 0) if names is None else F.lit(True) for c in filled}
    left = F.coalesce(*(F.when(x, c) for c, x in columns.items()))
    right = F.coalesce(*(F.when(columns[c], c) for c in reversed(columns)))
    cells = sum((F.col(f"n{c}") for c in filled), F.lit(len(names or [])))
    top = F.col("top") if names is None else F.lit(1).cast("long")
    bottom = F.col("bottom") if names is None else F.coalesce("bottom", F.lit(1).cast("long"))
    boxed = found.select(top.alias("first_row"), bottom.alias("last_row"), left.cast("int").alias("first_column"), right.cast("int").alias("last_column"), cells.cast("long").alias("cell_count"))
    return boxed.select("*", (F.col("last_row") - F.col("first_row") + 1).alias("row_count"), (F.col("last_column") - F.col("first_column") + 1).alias("column_count"))

