"""Analysis of workbooks at three levels: exact metadata, observed figures, inferred structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workbook import cells, sheets
from . import formulas
from .metadata import metadata
from .regions import regions


@dataclass
class Analysis:
    """Lazy relations keyed by (workbook, sheet); those above the level are None."""

    sheets: DataFrame
    items: DataFrame
    observed: DataFrame | None = None
    formula_columns: DataFrame | None = None
    dependencies: DataFrame | None = None
    regions: DataFrame | None = None
    headers: DataFrame | None = None
    warnings: DataFrame | None = None


def analyze(files: DataFrame, level: str = "full") -> Analysis:
    """level: exact, observed or full."""
    out = Analysis(sheets(files), metadata(files))
    if level == "exact":
        return out
    every = cells(files)
    filled = F.col("kind") > 0
    box = lambda f, c, w: f(F.when(w, F.col(c)))
    names = {"first_row": (F.min, "row"), "last_row": (F.max, "row"), "first_column": (F.min, "column"), "last_column": (F.max, "column")}
    boxes = [box(f, c, filled).alias(f"value_{n}") for n, (f, c) in names.items()] + [f(c).alias(f"styled_{n}") for n, (f, c) in names.items()]
    observed = every.groupBy("workbook", "sheet").agg(*boxes, F.count(F.when(filled, 1)).alias("cell_count"))
    observed = observed.withColumn("row_count", F.col("value_last_row") - F.col("value_first_row") + 1).withColumn("column_count", F.col("value_last_column") - F.col("value_first_column") + 1)
    counted = formulas.counts(every)
    out.observed = observed.join(counted, ["workbook", "sheet"], "left").fillna(0, ["formula_count", "array_formula_count"])
    out.formula_columns, out.dependencies = formulas.columns(every), formulas.dependencies(every)
    if level == "observed":
        return out
    out.regions = regions(every)
    tables = out.regions.where("kind in ('DataTable', 'Crosstab')").groupBy("workbook", "sheet").agg(F.min_by("first_row", "number").alias("table_row"))
    first = every.where(filled).join(observed.select("workbook", "sheet", "value_first_row", "row_count"), ["workbook", "sheet"]).where("row = value_first_row")
    plain = first.groupBy("workbook", "sheet").agg(F.min(F.col("kind") == 1).alias("texts"), F.max("row_count").alias("rows"), F.min("row").alias("row"))
    inferred = plain.select("workbook", "sheet", F.when(F.col("texts") & (F.col("rows") > 1), F.col("row")).alias("text_row"))
    heads = observed.join(tables, ["workbook", "sheet"], "left").join(inferred, ["workbook", "sheet"], "left")
    out.headers = heads.select("workbook", "sheet", F.coalesce("table_row", "text_row", F.lit(0)).alias("header_row"), F.col("value_first_column").alias("first_column"), F.col("value_last_column").alias("last_column"))
    corner = lambda c, r: F.concat(letters_column(F.col(c)), F.col(r).cast("string"))
    start, end = corner("value_first_column", "value_first_row"), corner("value_last_column", "value_last_row")
    actual = observed.where("cell_count > 0").select("workbook", "sheet", F.when(start == end, start).otherwise(F.concat_ws(":", start, end)).alias("used"))
    declared = out.items.where("kind = 'dimension' and ref is not null").select("workbook", "sheet", "ref")
    differ = declared.join(actual, ["workbook", "sheet"]).where("upper(ref) <> used")
    message = F.concat(F.lit("The sheet declares "), "ref", F.lit(", but its cells fill "), "used", F.lit("."))
    out.warnings = differ.select("workbook", "sheet", F.lit("declared-dimension-mismatch").alias("code"), message.alias("message"))
    return out


def letters_column(c):
    """Column letters of a number, up to three."""
    one = lambda n: F.when(n > 0, F.char((n - 1) % 26 + 65)).otherwise("")
    up = lambda n: F.floor((n - 1) / 26)
    return F.concat(one(up(F.greatest(up(c), F.lit(0)))), one(F.greatest(up(c), F.lit(0))), one(c))
