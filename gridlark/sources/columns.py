"""Cells decoded piece by piece into columns, so that most of the work is done for many cells at once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from html import unescape as html_unescape

import numpy as np
import pyarrow as pa

from ..functions.kinds import BOOLEAN, DATE, EMPTY, ERROR, FORMULA, NUMBER, TEXT
from ..plans.address import MAX_COLUMNS, MAX_ROWS
from .formats import to_date
from .xlsx import Cell, Package, Xlsx, column_of, unescape

#: Bytes of markup in a piece, about; and cells of one that has no fast form.
PIECE, CELLS = 4 << 20, 50_000
_CELL = re.compile(rb'<c r="([A-Z]{1,3})([0-9]{1,7})"(?: s="([0-9]+)")?(?: t="([A-Za-z]+)")?(?:/>|></c>|><v>([^<]+)</v></c>|><is><t>([^<]+)</t></is></c>)')
_REFERENCE = re.compile(rb'<c r="([A-Z]{1,3})[0-9]')
_STARTS = (b"<c ", b"<c>", b"<c/")


@dataclass
class Cells:
    """Parallel arrays; num, ts, flag and text have a value where the kind says so."""

    row: np.ndarray
    column: np.ndarray
    kind: np.ndarray
    num: np.ndarray
    ts: np.ndarray
    flag: np.ndarray
    text: np.ndarray
    formula: np.ndarray
    has_formula: np.ndarray
    array: np.ndarray

    def take(self, at: np.ndarray) -> Cells:
        return Cells(*(getattr(self, f.name)[at] for f in fields(self)))

    def parts(self) -> list[pa.Array]:
        """kind, num, ts, bool and text as Arrow arrays with nulls."""
        return [
            pa.array(self.kind),
            pa.array(self.num, mask=self.kind != NUMBER),
            pa.array(self.ts, pa.timestamp("us"), mask=self.kind != DATE),
            pa.array(self.flag, mask=self.kind != BOOLEAN),
            pa.array(self.text, pa.string(), mask=~np.isin(self.kind, (TEXT, ERROR, FORMULA))),
        ]


def blank(n: int) -> Cells:
    objects = lambda: np.full(n, None, object)
    return Cells(np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int8), np.zeros(n), np.zeros(n, "M8[us]"), np.zeros(n, bool), objects(), objects(), np.zeros(n, bool), np.zeros(n, bool))


def whole_rows(cells: Iterable[Cell]) -> Iterator[list[Cell]]:
    """About CELLS cells at a time, to the end of a row: a row in two pieces would count as two."""
    some: list[Cell] = []
    for cell in cells:
        if len(some) >= CELLS and cell.row != some[-1].row:
            yield some
            some = []
        some.append(cell)
    if some:
        yield some


def of_cells(cells: Iterable[Cell]) -> Iterator[Cells]:
    for some in whole_rows(cells):
        out = blank(len(some))
        out.row[:], out.column[:], out.kind[:] = [c.row for c in some], [c.column for c in some], [c.kind for c in some]
        out.formula[:], out.has_formula[:], out.array[:] = [c.formula for c in some], [c.has_formula for c in some], [c.array for c in some]
        for i, c in enumerate(some):
            if c.kind != EMPTY:
                {NUMBER: out.num, DATE: out.ts, BOOLEAN: out.flag}.get(c.kind, out.text)[i] = c.value
        yield out


def pieces(package: Package, sheet: str, formulas: bool = False) -> Iterator[Cells]:
    """All cells of a sheet in document order; what a reader doesn't ask for stays compressed."""
    if not isinstance(package, Xlsx):
        yield from of_cells(package.cells(sheet, formulas))
        return
    state = package.scan_state(sheet, formulas)
    for body in state.bodies(PIECE):
        found = usual(package, body)
        if found is None:
            yield from of_cells(state.cells(body))
        elif len(found.row):
            state.row = int(found.row[-1])
            yield found


def following(found: Iterable[Cells], before: int) -> Iterator[Cells]:
    """Cells of a sheet that follows so many rows of other workbooks: they take its header's place, its rows come after them."""
    for cells in found:
        if before:
            cells = cells.take(np.flatnonzero(cells.row > 1))
            cells.row += before
        yield cells


def usual(package: Xlsx, body: bytes) -> Cells | None:
    """The cells of markup in its usual form; None if there is any other."""
    if b"<f" in body or b"<![CDATA[" in body or b"<!--" in body:
        return None
    found = _CELL.findall(body)
    if len(found) != sum(map(body.count, _STARTS)):
        return None
    if not found:
        return blank(0)
    letters, rows, styles, types, values, inline = zip(*found)
    out = blank(len(found))
    out.row[:] = np.array(rows, "S7").astype(np.int64)
    out.column[:] = np.fromiter(map(column_of, letters), np.int32, len(found))
    if out.row.min() < 1 or out.row.max() > MAX_ROWS or out.column.min() < 1 or out.column.max() > MAX_COLUMNS:
        return None
    kinds = np.array(types, "S9")
    filled = np.fromiter(map(bool, values), bool, len(found))
    known = np.zeros(len(found), bool)
    try:
        for kind in np.unique(kinds).tolist():
            mine = kinds == kind
            at = np.flatnonzero(mine & filled)
            given = [values[i] for i in at.tolist()]
            known |= mine
            if kind in (b"", b"n"):
                out.num[at], out.kind[at] = pa.array(given, pa.string()).cast(pa.float64()).to_numpy(zero_copy_only=False), NUMBER
                dates = {s: package.style.is_date(int(s or 0)) for s in set(styles)}
                if any(dates.values()):
                    on = at[np.fromiter((dates[styles[i]] for i in at.tolist()), bool, len(at))]
                    numbers, inverse = np.unique(out.num[on], return_inverse=True)
                    found_dates = [to_date(x, package.date1904) for x in numbers.tolist()]
                    out.ts[on] = np.array(found_dates, "M8[us]")[inverse]
                    out.kind[on] = np.array([EMPTY if d is None else DATE for d in found_dates], np.int8)[inverse]
            elif kind == b"s":
                index = pa.array(given, pa.string()).cast(pa.int64()).to_numpy()
                there = (index >= 0) & (index < len(package.strings))
                out.text[at[there]], out.kind[at[there]] = package.string_array[index[there]], TEXT
            elif kind == b"b":
                if not {b"0", b"1"}.issuperset(given):
                    return None
                out.flag[at], out.kind[at] = np.array(given, "S1") == b"1", BOOLEAN
            elif kind == b"inlineStr":
                at = np.flatnonzero(mine & np.fromiter(map(bool, inline), bool, len(found)))
                out.text[at], out.kind[at] = [plain(inline[i]) for i in at.tolist()], TEXT
            elif kind == b"str":
                out.text[at], out.kind[at] = list(map(plain, given)), TEXT
            else:
                return None
    except pa.ArrowInvalid:
        return None
    return out


def plain(text: bytes) -> str:
    shown = text.decode()
    return unescape(html_unescape(shown) if "&" in shown else shown)


def width(package: Package, sheet: str) -> int:
    """The last column that has a cell."""
    if isinstance(package, Xlsx):
        most = 0
        for body in package.scan_state(sheet, False).bodies(PIECE):
            letters = _REFERENCE.findall(body)
            if len(letters) != sum(map(body.count, _STARTS)) or b"<![CDATA[" in body or b"<!--" in body:
                break
            most = max([most, *map(column_of, set(letters))])
        else:
            return most if most <= MAX_COLUMNS else max((int(x.column.max()) for x in pieces(package, sheet)), default=0)
    return max((int(x.column.max(initial=0)) for x in pieces(package, sheet)), default=0)


def rows_of(found: Iterable[Cells], wanted: list[int], keep_blank: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in document order: their number, and a cell struct for each wanted column, null where there is no cell."""
    for cells in found:
        if not len(cells.row):
            continue
        new = np.flatnonzero(np.diff(cells.row, prepend=-1))
        at = np.zeros(len(cells.row), np.int64)
        at[new[1:]] = 1
        at = np.cumsum(at)
        numbers = cells.row[new]
        present = np.ones(len(numbers), bool)
        if not keep_blank:
            present = np.bincount(at, cells.kind != EMPTY, len(numbers)) > 0
        columns: list[pa.Array] = [pa.array(numbers[present])]
        for i, column in enumerate(wanted, 1):
            own = np.flatnonzero(cells.column == column)
            place = np.full(len(numbers), -1)
            place[at[own]] = own
            place = place[present]
            one = cells.take(np.maximum(place, 0))
            columns.append(pa.StructArray.from_arrays(one.parts(), fields=list(schema.field(i).type), mask=pa.array(place < 0)))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
