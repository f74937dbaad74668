"""Formulas: counts, columns and what other sheets they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sheet name in quotes, or bare with its book, before an exclamation mark.
_REFERENCE = r"('(?:[^']|'')+'|[A-Za-z0-9_.\[\]:\\]+)!"


def counts(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, formula_count, array_formula_count)."""
    array = F.count(F.when(F.col("is_array"), 1))
    return cells.where("is_formula").groupBy("workbook", "sheet").agg(F.count(F.lit(1)).alias("formula_count"), array.alias("array_formula_count"))


def columns(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, column_index, formula_count)."""
    return cells.where("is_formula").groupBy("workbook", "sheet", F.col("column").alias("column_index")).agg(F.count(F.lit(1)).alias("formula_count"))


def references(formula) -> F.Column:
    """Distinct (book, name) pairs that a formula refers to; text literals don't count."""
    bare = F.regexp_replace(formula, '"(?:[^"]|"")*"', '""')
    found = F.regexp_extract_all(bare, F.lit(_REFERENCE), 1)
    plain = F.transform(found, lambda x: F.when(x.startswith("'"), F.regexp_replace(x, "^'|'$", "")).otherwise(x))
    return F.array_distinct(F.transform(plain, lambda x: F.struct(F.nullif(F.regexp_extract(x, r"^(.*\])[^\]]+$", 1), F.lit("")).alias("book"), F.regexp_extract(x, r"^(?:.*\])?([^\]]+)$", 1).alias("name"))))


def dependencies(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, target_workbook, target_sheet, formula_count): once a formula; a sheet's own name doesn't count; case doesn't part names."""
    used = cells.where("is_formula and formula is not null").select("workbook", "sheet", "row", "column", F.explode(references(F.col("formula"))).alias("r"))
    others = used.where((F.lower("r.name") != F.lower("sheet")) | F.col("r.book").isNotNull()).where("r.name <> ''")
    keyed = others.groupBy("workbook", "sheet", F.lower("r.book").alias("b"), F.lower("r.name").alias("n"))
    first = F.struct("row", "column")
    out = keyed.agg(F.min_by("r.book", first).alias("target_workbook"), F.min_by("r.name", first).alias("target_sheet"), F.count_distinct("row", "column").alias("formula_count"))
    return out.select("workbook", "sheet", "target_workbook", "target_sheet", "formula_count")
