"""Rows of a sheet in order, one partition at a time, for readers that stop early or hold little."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from ..plans.address import Range
from ..sources.sheet import ROW, Sheet, physical


def plain(v):
    """A cell as a Python value: None, float, str, datetime or bool."""
    if hasattr(v, "asDict") and "kind" in v:
        return {2: v["num"], 3: v["ts"], 4: v["bool"], 1: v["text"], 0: None}.get(v["kind"], v["text"])
    return v


def rows(sheet: Sheet, area: Range) -> Iterator[tuple[int, list]]:
    """(row number, values) of the present rows; only the area's columns are read."""
    numbers = range(area.left, min(area.right, sheet.width) + 1)
    sheet = sheet.narrowed(list(numbers))
    found = sheet.rows(area).select(F.col(ROW), *(sheet.value(c).col.alias(physical(c)) for c in numbers))
    for r in (found if sheet.in_order else found.orderBy(ROW)).toLocalIterator():
        yield r[0], [plain(v) for v in r[1:]]


def chunks(sheet: Sheet, area: Range, size: int) -> Iterator[list[tuple[int, list]]]:
    """The same in lists of at most `size` rows."""
    held = []
    for row in rows(sheet, area):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
