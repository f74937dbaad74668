"""Regions of sheets: contiguous runs of cells gathered into blocks, and what the blocks are.

A sheet's rows are worked through in order, so each sheet is one task; sheets are bounded by their
format and run side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.kinds import BOOLEAN, DATE, NUMBER, TEXT
from ..plans.address import Range
from ..sources.sheet import Sheet

#: Rows with cells that a block may miss before it ends, and the share of columns that binds a run to it.
GAP, SHARED = 1, 0.5
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")
_PERIOD = re.compile(r"[QqHhWw][0-9]")
SCHEMA = "workbook string, sheet string, number int, kind string, first_row long, last_row long, first_column int, last_column int, cell_count long, row_count long, column_count int, formula_count long, header_rows array<long>, evidence array<string>, key_column int, confidence double"


@dataclass
class Run:
    """Neighbouring cells of one row."""

    first: int
    last: int
    cells: int = 0
    texts: int = 0
    numbers: int = 0
    formulas: int = 0
    values: int = 0
    starts_with_text: bool = False


@dataclass
class Block:
    top: int
    bottom: int
    left: int
    right: int
    head: Run
    cells: int
    texts: int
    numbers: int
    formulas: int
    labelled: int = 0
    missed: int = 0
    touched: bool = True


def value_like(text: str) -> bool:
    """A number, a year anywhere, or a period such as Q1."""
    text = text.strip()
    if not text:
        return False
    try:
        float(text.replace(",", ""))
        return True
    except ValueError:
        return bool(_YEAR.search(text) or _PERIOD.match(text))


def runs(cells: Iterable[tuple[int, int, str | None, bool]]) -> list[Run]:
    """Of one row's non-empty cells (column, kind, text, is_formula) in column order."""
    out: list[Run] = []
    for column, kind, text, is_formula in cells:
        if not out or column > out[-1].last + 1:
            out.append(Run(column, column, starts_with_text=kind == TEXT))
        run = out[-1]
        run.last = column
        run.cells += 1
        run.formulas += bool(is_formula)
        run.texts += kind == TEXT
        run.numbers += kind in (NUMBER, DATE, BOOLEAN)
        run.values += kind in (NUMBER, DATE) or kind == TEXT and value_like(text or "")
    return out


def segment(rows: Iterable[tuple[int, list]]) -> list[Block]:
    """Blocks in the order in which they end. rows: (row number, cells) of rows that have cells, in order."""
    active: list[Block] = []
    done: list[Block] = []
    for row, cells in rows:
        for block in active:
            block.touched = False
        for run in runs(cells):
            found, widest = None, 0
            for block in active:
                shared = min(run.last, block.right) - max(run.first, block.left) + 1
                width = max(run.last - run.first, block.right - block.left) + 1
                if row - block.bottom <= GAP + 1 and shared > widest and shared / width >= SHARED:
                    found, widest = block, shared
            if found is None:
                active.append(Block(row, row, run.first, run.last, run, run.cells, run.texts, run.numbers, run.formulas))
                continue
            found.bottom, found.left, found.right = row, min(found.left, run.first), max(found.right, run.last)
            found.cells += run.cells
            found.texts += run.texts
            found.numbers += run.numbers
            found.formulas += run.formulas
            found.touched, found.missed = True, 0
            found.labelled += run.first == found.left and run.starts_with_text and run.numbers > 0 and run.numbers >= run.texts
        for block in reversed(list(active)):
            if not block.touched:
                block.missed += 1
                if block.missed > GAP:
                    done.append(block)
                    active.remove(block)
    return done + active


def classify(b: Block) -> tuple[str, int, float]:
    """Kind, key column (0: none) and confidence."""
    width, height = b.right - b.left + 1, b.bottom - b.top + 1
    head = b.head.texts / b.head.cells
    body = (b.numbers - b.head.numbers) / max(1, b.cells - b.head.cells)
    labels = b.labelled / height if height > 1 else 0.0
    if height == 1 and head >= 0.6:
        return "TitleRow", 0, head
    if width <= 3 and labels >= 0.4 and head < 0.6:
        return "ParameterBlock", b.left, labels
    if labels >= 0.5 and b.head.values / b.head.cells >= 0.6:
        return "Crosstab", b.left, labels
    if head >= 0.6 and body >= 0.5:
        return "DataTable", 0, body
    if width >= 2 and height >= 2 and body > 0.5:
        return "SummaryBlock", 0, body
    return "Unknown", 0, 0.0


def evidence(b: Block) -> list[str]:
    width, height = b.right - b.left + 1, b.bottom - b.top + 1
    found = {"text": b.texts > 0, "numeric": b.numbers > 0, "grid": width >= 3 and height >= 3, "label-value": width <= 3 and b.texts > 0 and b.numbers > 0}
    return [k for k, v in found.items() if v]


def describe(blocks: list[Block]) -> list[dict]:
    out = []
    for i, b in enumerate(blocks):
        kind, key_column, confidence = classify(b)
        heads = [b.top] if kind in ("DataTable", "TitleRow", "Crosstab") else []
        out.append({"number": i, "kind": kind, "first_row": b.top, "last_row": b.bottom, "first_column": b.left, "last_column": b.right, "cell_count": b.cells, "row_count": b.bottom - b.top + 1, "column_count": b.right - b.left + 1, "formula_count": b.formulas, "header_rows": heads, "evidence": evidence(b), "key_column": key_column, "confidence": min(max(confidence, 0.0), 1.0)})
    return out


def by_row(cells: pd.DataFrame) -> list[tuple[int, list]]:
    """Non-empty cells of one sheet, by row."""
    filled = cells[cells["kind"] > 0].sort_values(["row", "column"])
    rows: dict[int, list] = {}
    for row, column, kind, text, formula in zip(filled["row"], filled["column"], filled["kind"], filled["text"], filled["is_formula"]):
        rows.setdefault(int(row), []).append((int(column), int(kind), text, bool(formula)))
    return list(rows.items())


def regions(cells: DataFrame) -> DataFrame:
    """The regions of all sheets of a long-form cell relation."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(describe(segment(by_row(part))))
        out.insert(0, "sheet", part["sheet"].iloc[0])
        out.insert(0, "workbook", part["workbook"].iloc[0])
        return out if len(out.columns) > 2 else pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])

    needed = cells.where("kind > 0").select("workbook", "sheet", "row", "column", "kind", "text", "is_formula")
    return needed.groupBy("workbook", "sheet").applyInPandas(run, SCHEMA)


def header_row_for(sheet: Sheet, area: Range) -> int:
    """Top of the first data table or crosstab that meets the area; 0 if there is none."""
    from ..sources.workbook import cells

    files = sheet.extra["files"]
    names = files.sparkSession.createDataFrame([(sheet.name,)], "sheet string").crossJoin(files.select("workbook"))
    found = regions(cells(files, names)).where("kind in ('DataTable', 'Crosstab')").orderBy("number").collect()
    for r in found:
        if area.overlaps(Range(r["first_column"], r["first_row"], r["last_column"], r["last_row"])):
            return r["first_row"]
    return 0
