"""Layout of unfamiliar sheets: measure fields, the axes that label them, and groups of fields.

A sheet becomes a grid of its present rows with summed-area tables, so that any rectangle's counts
take four look-ups. Detection is sequential within a sheet; sheets are bounded by their format and each
is one task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.display import number_text
from ..functions.kinds import DATE, NUMBER, TEXT
from ..plans.address import Range

NONE, LABEL, FIGURE, YEAR, DAY, OTHER = range(6)
#: Rows that a data start is looked for, that end a table, and so on.
START_ROWS, EMPTY_ROWS, LABEL_COLUMNS, COORDINATE_ROWS, TITLE_ROWS = 6, 4, 4, 3, 3
SCHEMA = "workbook string, sheet string, item string, id string, first_row long, last_row long, first_column int, last_column int, title string, orientation string, role string, value_kind string, samples array<string>, sections array<struct<title:string,first_row:bigint,last_row:bigint>>, axis_ids array<string>, field_ids array<string>, cell_count long, numeric_count long, text_count long, formula_count long, min_numeric double, max_numeric double"


class Grid:
    """kind, number and formula of every cell of the present rows, from the leftmost to the rightmost column."""

    def __init__(self, cells: Iterable[tuple[int, int, int, float, str | None, bool]]):
        """cells: (row, column, kind code, number, text, is_formula)."""
        cells = list(cells)
        self.rows = sorted({c[0] for c in cells})
        self.left, self.right = min(c[1] for c in cells), max(c[1] for c in cells)
        place = {r: i for i, r in enumerate(self.rows)}
        shape = (len(self.rows), self.right - self.left + 1)
        self.kind, self.number, self.formula, self.heads = np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
        self.text: dict[tuple[int, int], str] = {}
        for row, column, kind, number, text, is_formula in cells:
            i, j = place[row], column - self.left
            self.kind[i, j], self.number[i, j], self.formula[i, j] = kind, number, is_formula
            self.heads[i, j] = kind in (YEAR, DAY) or kind == LABEL and 1 <= len(text or "") <= 40
            if kind == LABEL:
                self.text[row, column] = (text or "")[:64]
        numeric = (self.kind >= FIGURE) & (self.kind <= DAY)
        masks = {"numeric": numeric, "zero": numeric & (self.number == 0), "measure": self.kind == FIGURE, "axis": (self.kind >= LABEL) & (self.kind <= DAY), "label": self.kind == LABEL, "cell": self.kind > NONE, "formula": self.formula, "head": self.heads}
        self.sums = {n: np.pad(m.astype(np.int32).cumsum(0).cumsum(1), ((1, 0), (1, 0))) for n, m in masks.items()}
        self.runs = cache(self._runs)

    def _rows(self, top: int, bottom: int) -> tuple[int, int]:
        return bisect_left(self.rows, top), bisect_left(self.rows, bottom + 1)

    def _box(self, top: int, bottom: int, left: int, right: int) -> tuple[int, int, int, int]:
        a, b = self._rows(top, bottom)
        width = self.right - self.left + 1
        return a, max(a, b), min(max(left - self.left, 0), width), min(max(right - self.left + 1, 0), width)

    def count(self, what: str, top: int, bottom: int, left: int, right: int) -> int:
        a, b, c, d = self._box(top, bottom, left, right)
        s = self.sums[what]
        return int(s[b, d] - s[a, d] - s[b, c] + s[a, c]) if d > c else 0

    def at(self, row: int, column: int) -> tuple[int, float]:
        i = bisect_left(self.rows, row)
        if i == len(self.rows) or self.rows[i] != row or not self.left <= column <= self.right:
            return NONE, 0.0
        return int(self.kind[i, column - self.left]), float(self.number[i, column - self.left])

    def figure(self, row: int, column: int) -> float | None:
        kind, number = self.at(row, column)
        return number if kind == FIGURE else None

    def _runs(self, row: int) -> list[tuple[int, int]]:
        """Column spans of neighbouring header-like cells."""
        i = bisect_left(self.rows, row)
        if i == len(self.rows) or self.rows[i] != row:
            return []
        edges = np.diff(np.pad(self.heads[i].astype(np.int8), 1))
        return [(int(a) + self.left, int(b) + self.left - 1) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))]

    def heads_run(self, row: int, left: int, right: int) -> bool:
        """Whether one run of header-like cells covers at least half of the span, and two columns."""
        least = max(2, (right - left + 1) // 2)
        return any(min(b, right) - max(a, left) + 1 >= least for a, b in self.runs(row))

    def full_band(self, row: int, left: int, right: int) -> bool:
        return self.count("head", row, row, left, right) == right - left + 1

    def column(self, top: int, bottom: int, column: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self._box(top, bottom, column, column)
        return (self.kind[a:b, c], self.number[a:b, c]) if d > c else (np.zeros(0, np.uint8), np.zeros(0))

    def years(self, top: int, bottom: int, column: int) -> bool:
        """A key column of years or dates: no figures, at least two, climbing, and back at or below a run's start where it falls."""
        kind, number = self.column(top, bottom, column)
        if (kind == FIGURE).any():
            return False
        found = number[(kind == YEAR) | (kind == DAY)]
        start = found[0] if len(found) else 0.0
        for before, now in zip(found, found[1:]):
            if now < before:
                if now > start:
                    return False
                start = now
        return len(found) >= 2


@dataclass(frozen=True)
class Field:
    top: int
    bottom: int
    left: int
    right: int
    head: int = 0  # header row, 0 without
    head_left: int = 0
    head_right: int = 0

    @property
    def height(self) -> int:
        return self.bottom - self.top + 1

    @property
    def width(self) -> int:
        return self.right - self.left + 1

    def meets(self, o: Field) -> bool:
        return self.top <= o.bottom and o.top <= self.bottom and self.left <= o.right and o.left <= self.right


def same_step(step: float, first: float) -> bool:
    return np.sign(step) == np.sign(first) and abs(step - first) <= max(abs(first) * 0.05, 1e-9)


def steady(values: Iterable[float | None]) -> int:
    """How many leading values advance by one non-zero step."""
    n, before, first = 0, None, None
    for v in values:
        if v is None:
            break
        if before is not None:
            step = v - before
            if step == 0 or first is not None and not same_step(step, first):
                break
            first = step if first is None else first
        n, before = n + 1, v
    return n


def matrices(g: Grid) -> list[Field]:
    """Blocks between a row and a column of evenly spaced coordinates, below a title or a gap."""
    figures = np.where(g.kind == FIGURE, g.number, np.nan)
    first, second = np.diff(figures, axis=1)[:, :-1], np.diff(figures, axis=1)[:, 1:]
    even = (np.sign(first) * np.sign(second) > 0) & (np.abs(second - first) <= np.maximum(np.abs(first) * 0.05, 1e-9))
    out: list[Field] = []
    done: dict[int, int] = {}  # by row, the last column of coordinates of a block
    for i, j in np.argwhere(even).tolist():  # each place where two equal steps begin, row by row
        row, column = g.rows[i], g.left + j
        if done.get(row, 0) < column and (found := matrix(g, row, column)) and not any(found.meets(o) for o in out):
            out.append(found)
            done[row] = found.right
    return out


def matrix(g: Grid, row: int, column: int) -> Field | None:
    """The block whose upper coordinates start here, if it has a column of others to its left and is half full."""
    last = g.rows[-1]
    beside = [g.figure(r, column - 1) for r in range(row + 1, min(row + COORDINATE_ROWS, last) + 1)]
    gap = next((i for i, v in enumerate(beside) if v is not None), None)
    if gap is None:
        return None
    top = row + 1 + gap
    height = steady(g.figure(r, column - 1) for r in range(top, last + 1))
    right = column - 1 + steady(g.figure(row, c) for c in range(column, g.right + 1))
    box = Field(top, top + height - 1, column, right, row, column, right)
    crowned = g.heads_run(row - 1, column, right) or g.count("measure", row - 1, row - 1, column - 1, right)
    filled = g.count("numeric", box.top, box.bottom, column, right)
    return box if height >= 3 and not crowned and 2 * filled >= box.width * box.height else None


def dense(g: Grid, blocks: list[Field]) -> list[Field]:
    """Fields under runs of header-like cells."""
    raw: list[Field] = []
    claimed: list[Field] = []
    for row in g.rows:
        claimed = [c for c in claimed if c.bottom > row]
        for left, right in g.runs(row):
            if right == left or any(c.top <= row and c.left <= left and right <= c.right for c in claimed):
                continue
            found = under_header(g, row, left, right, blocks)
            if found is not None:
                raw.append(found)
                claimed.append(replace(found, left=left, right=right))
    return sorted(aligned(g, raw), key=lambda f: (f.top, f.left))


def under_header(g: Grid, head: int, left: int, right: int, blocks: list[Field]) -> Field | None:
    top = 0
    for row in range(head + 1, min(g.rows[-1], head + START_ROWS) + 1):
        if g.full_band(row, left, right):
            return None
        if g.count("numeric", row, row, left, right):
            top = row
            break
    if not top:
        return None
    bottom = last_row(g, top, left, right, blocks)
    while left <= right and g.count("numeric", top, bottom, left, left) < 2:
        left += 1
    while right >= left and g.count("numeric", top, bottom, right, right) < 2:
        right -= 1
    while left < right and g.years(top, bottom, left):
        left += 1
    if right - left < 1 or g.count("numeric", top, bottom, left, right) < min(4, right - left + 1):
        return None
    return Field(top, bottom, left, right, head, left, right)


def last_row(g: Grid, top: int, left: int, right: int, blocks: list[Field]) -> int:
    """Before four empty rows, a header printed again after a gap, a matrix, or thin figures after a gap; trailing zeros don't count."""
    width, last, empty = right - left + 1, top, 0
    for row in range(top, g.rows[-1] + 1):
        if row > top and (empty and g.heads_run(row, left, right) or any(b.head <= row <= b.bottom and left <= b.head_right and b.left - 1 <= right for b in blocks)):
            break
        figures = g.count("numeric", row, row, left, right)
        if not figures:
            empty += 1
            if empty >= EMPTY_ROWS:
                break
            continue
        if empty and width >= 4 and figures < max(2, width // 4):
            break
        if figures > g.count("zero", row, row, left, right):
            last = row
        empty = 0
    return last


def aligned(g: Grid, raw: list[Field]) -> list[Field]:
    """Fields of one header row share its leftmost field's rows; header runs between them that found none get one."""
    out: list[Field] = []
    for head in dict.fromkeys(f.head for f in raw):
        group = sorted((f for f in raw if f.head == head), key=lambda f: f.left)
        top, bottom = min(f.top for f in group), group[0].bottom
        out += [replace(f, top=top, bottom=bottom) for f in group]
        for left, right in g.runs(head):
            between = group[0].left <= left and right <= group[-1].right
            if between and not any(f.left <= right and left <= f.right for f in group) and g.count("numeric", top, bottom, left, right) >= 2:
                out.append(Field(top, bottom, left, right, head, left, right))
    return out


def bridged(g: Grid, fields: list[Field]) -> list[Field]:
    """Fields with the same rows join across columns that all hold figures, unless another field lies between."""
    left_over = sorted(fields, key=lambda f: (f.top, f.left))
    out: list[Field] = []
    while left_over:
        now = left_over.pop(0)
        for other in list(left_over):
            if (other.top, other.bottom) != (now.top, now.bottom) or other.left <= now.right:
                continue
            gap = range(now.right + 1, other.left)
            filled = all(g.count("numeric", now.top, now.bottom, c, c) for c in gap)
            foreign = any((f.top, f.bottom) != (now.top, now.bottom) and f.top <= now.bottom and now.top <= f.bottom and f.left < other.left and f.right > now.right for f in out + left_over)
            if filled and not (len(gap) and foreign):
                now = replace(now, right=other.right, head_right=max(now.head_right, other.head_right))
                left_over.remove(other)
        out.append(now)
    return sorted(out, key=lambda f: (f.top, f.left))


def vectors(g: Grid, taken: list[Field]) -> list[Field]:
    """Runs of figures down one column, at most one row apart, with labels to the left; then joined where they touch."""
    single: list[Field] = []
    for column in range(g.left, g.right + 1):
        kind = g.kind[:, column - g.left]
        rows = [g.rows[i] for i in np.flatnonzero(kind == FIGURE)]
        rows = [r for r in rows if not any(t.top <= r <= t.bottom and t.left <= column <= t.right for t in taken)]
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] - rows[i - 1] > 2:
                found = Field(rows[start], rows[i - 1], column, column, 0, column, column)
                labelled = g.count("axis", found.top, found.bottom, max(g.left, column - LABEL_COLUMNS), column - 1) > 0
                if found.height >= 2 and labelled and not any(found.meets(t) for t in taken):
                    single.append(found)
                start = i
    return sorted(gathered(single), key=lambda f: (f.top, f.left))


def gathered(parts: list[Field]) -> list[Field]:
    """Hulls of parts in neighbouring columns with common rows; overlapping hulls join until none do."""
    near = lambda a, b: a.top <= b.bottom and b.top <= a.bottom and a.left <= b.right + 1 and b.left <= a.right + 1
    groups: list[list[Field]] = []
    for p in sorted(parts, key=lambda f: (f.left, f.top)):
        linked = [g for g in groups if any(near(p, q) for q in g if q.right >= p.left - 1)]
        groups = [g for g in groups if g not in linked] + [[p, *(q for g in linked for q in g)]]
    hulls = [hull(g) for g in groups]
    while True:
        pair = next(((a, b) for i, a in enumerate(hulls) for b in hulls[i + 1 :] if a.meets(b)), None)
        if pair is None:
            return hulls
        hulls = [h for h in hulls if h not in pair] + [hull(list(pair))]


def hull(parts: list[Field]) -> Field:
    left, right = min(p.left for p in parts), max(p.right for p in parts)
    return Field(min(p.top for p in parts), max(p.bottom for p in parts), left, right, 0, left, right)


@dataclass
class Axis:
    id: str
    vertical: bool
    primary: bool
    top: int
    bottom: int
    left: int
    right: int
    kind: str = "Text"
    title: str | None = None
    samples: list[str] = field(default_factory=list)
    sections: list[tuple[str, int, int]] = field(default_factory=list)


class Axes:
    def __init__(self, g: Grid, fields: list[Field]):
        self.g, self.fields, self.made = g, fields, {}

    def get(self, vertical: bool, primary: bool, top: int, bottom: int, left: int, right: int) -> Axis:
        place = (vertical, primary, top, bottom, left, right)
        if place not in self.made:
            axis = Axis(f"axis{len(self.made) + 1}", *place)
            axis.kind, axis.samples = self.contents(axis)
            if not vertical or axis.kind in ("Numeric", "Date"):
                probes = ((top - 1, left), (top - 2, left), (top, left - 1), (top, left - 2))
                axis.title = next((self.g.text[p] for p in probes if p in self.g.text), None)
            self.made[place] = axis
        return self.made[place]

    def copy(self, a: Axis) -> Axis:
        return self.get(a.vertical, False, a.top, a.bottom, a.left, a.right)

    def contents(self, a: Axis) -> tuple[str, list[str]]:
        g = self.g
        r0, r1, c0, c1 = g._box(a.top, a.bottom, a.left, a.right)
        kinds = g.kind[r0:r1, c0:c1]
        tally = {"Date": int((kinds == DAY).sum()), "Numeric": int(((kinds == FIGURE) | (kinds == YEAR)).sum()), "Text": int((kinds == LABEL).sum())}
        total, samples = sum(tally.values()), []
        for i, j in np.argwhere(kinds > NONE)[:64].tolist():
            row, column, kind = g.rows[r0 + i], g.left + c0 + j, kinds[i, j]
            if kind == LABEL:
                samples.append(g.text[row, column])
            elif kind == DAY:
                samples.append((datetime(1899, 12, 30) + timedelta(days=float(g.number[r0 + i, c0 + j]))).strftime("%Y-%m-%d"))
            elif kind in (FIGURE, YEAR):
                samples.append(number_text(float(g.number[r0 + i, c0 + j])))
        found = next((k for k, n in tally.items() if n > total // 2), "Text" if not total else "Mixed")
        return found, samples[:3]

    def of(self, f: Field) -> list[Axis]:
        g, out = self.g, []
        main = self.label_column(f)
        if main:
            out.append(self.get(True, True, f.top, f.bottom, main, main))
            for c in range(main + 1, f.left):
                if g.count("axis", f.top, f.bottom, c, c) >= max(2, f.height // 3) and not g.count("measure", f.top, f.bottom, c, c):
                    out.append(self.get(True, False, f.top, f.bottom, c, c))
        if f.head:
            out.append(self.get(False, True, f.head, f.head, f.head_left, f.head_right))
        return out

    def label_column(self, f: Field) -> int:
        """The best-scoring column to the left, the leftmost of equals. Fields with the same rows are crossed, others end the search."""
        best = score = 0
        for c in range(f.left - 1, self.g.left - 1, -1):
            other = next((o for o in self.fields if o != f and o.left <= c <= o.right and o.top <= f.bottom and f.top <= o.bottom), None)
            if other is not None:
                same = (other.top, other.bottom) == (f.top, f.bottom)
                fragment = other.right == f.left - 1 and f.top <= other.top and other.bottom <= f.bottom
                if not (same or fragment) or score:
                    break
                continue
            kind, _ = self.g.column(f.top, f.bottom, c)
            now = 3 * int((kind == LABEL).sum()) + int(((kind >= FIGURE) & (kind <= DAY)).sum())
            if now and now >= score:
                best, score = c, now
        return best

    def inherit(self, found: list[tuple[Field, list[Axis]]]) -> None:
        """Fields without a header take one that covers them from above, or that of the field they lean on, as context."""
        heads = sorted((a for a in self.made.values() if not a.vertical and a.primary), key=lambda a: (a.top, a.left))
        for f, axes in found:
            if all(a.vertical for a in axes):
                above = [a for a in heads if a.top < f.top and a.left <= f.left and f.right <= a.right and f.width * 2 >= a.right - a.left + 1]
                if above:
                    axes.append(self.copy(max(reversed(above), key=lambda a: (a.top, -a.left))))
        for f, axes in found:
            if all(a.vertical for a in axes):
                hosts = (h for o, h in found if o is not f and o.left == f.right + 1 and o.top <= f.top and f.bottom <= o.bottom)
                covering = (a for h in hosts for a in h if not a.vertical and a.left <= f.left and f.right <= a.right)
                if (axis := next(covering, None)) is not None:
                    axes.append(self.copy(axis))

    def divide(self, found: list[tuple[Field, list[Axis]]]) -> None:
        """Sections: label rows of a vertical axis with no figure in its fields' columns."""
        for axis in self.made.values():
            own = [f for f, axes in found if axis in axes]
            if not (axis.vertical and axis.primary and own):
                continue
            left, right = min(f.left for f in own), max(f.right for f in own)
            rows = [r for r in range(max(1, axis.top - 2), axis.bottom + 1) if (r, axis.left) in self.g.text and not self.g.count("measure", r, r, left, right)]
            axis.sections = [(self.g.text[r, axis.left], r, (rows[i + 1] - 1 if i + 1 < len(rows) else axis.bottom)) for i, r in enumerate(rows)]


def groups(g: Grid, found: list[tuple[Field, list[Axis]]]) -> list[tuple[str | None, Range, list[str], list[int]]]:
    """Fields linked by common axes: title, hull, axis ids and field numbers."""
    root = list(range(len(found)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    owner: dict[str, int] = {}
    for i, (_, axes) in enumerate(found):
        for a in axes:
            root[find(i)] = find(owner.setdefault(a.id, i))
    out = []
    for r in dict.fromkeys(find(i) for i in range(len(found))):
        members = [i for i in range(len(found)) if find(i) == r]
        axes = list({a.id: a for i in members for a in found[i][1]}.values())
        if not axes:
            continue
        boxes = [found[i][0] for i in members] + axes
        area = Range(min(b.left for b in boxes), min(b.top for b in boxes), max(b.right for b in boxes), max(b.bottom for b in boxes))
        title = None
        for row in range(area.top - 1, max(1, area.top - TITLE_ROWS) - 1, -1):
            left = max(1, area.left - 1)
            if g.count("measure", row, row, left, area.right):
                break
            if g.count("label", row, row, left, area.right) == 1:
                title = next(t for (r2, c), t in g.text.items() if r2 == row and left <= c <= area.right)
                break
        out.append((title, area, [a.id for a in axes], members))
    return out


def infer(g: Grid) -> tuple[list[tuple[Field, list[Axis]]], list[Axis], list]:
    """Fields with their axes, all axes in order, and groups."""
    blocks = matrices(g)
    zones = [z for b in blocks for z in (b, Field(b.head, b.head, b.head_left, b.head_right), Field(b.top, b.bottom, b.left - 1, b.left - 1))]
    chosen: list[Field] = []
    for f in dense(g, blocks):
        if not any(f.meets(o) for o in zones + chosen):
            chosen.append(f)
    chosen = bridged(g, chosen)
    fields = chosen + blocks + vectors(g, zones + chosen)
    axes = Axes(g, fields)
    found = [(f, axes.of(f)) for f in fields]
    axes.inherit(found)
    axes.divide(found)
    return found, sorted(axes.made.values(), key=lambda a: (a.top, a.left)), groups(g, found)


def facts(cells: pd.DataFrame) -> list[tuple]:
    """Cells of one sheet in the codes of the grid; dates as serial days."""
    out = []
    start = pd.Timestamp(1899, 12, 30)
    for row, column, kind, num, ts, text, formula in zip(cells["row"], cells["column"], cells["kind"], cells["num"], cells["ts"], cells["text"], cells["is_formula"]):
        if kind == TEXT:
            out.append((row, column, LABEL, 0.0, text, formula))
        elif kind == NUMBER:
            out.append((row, column, YEAR if num % 1 == 0 and 1900 <= num <= 2100 else FIGURE, num, None, formula))
        elif kind == DATE:
            out.append((row, column, DAY, (ts - start) / pd.Timedelta(days=1), None, formula))
        elif kind:
            out.append((row, column, OTHER, 0.0, None, formula))
    return [(int(r), int(c), k, float(n), t, bool(f)) for r, c, k, n, t, f in out]


def rows_of(cells: pd.DataFrame) -> list[dict]:
    known = facts(cells)
    if not known:
        return []
    g = Grid(known)
    found, axes, clusters = infer(g)
    out = []
    for a in axes:
        out.append({"item": "axis", "id": a.id, "first_row": a.top, "last_row": a.bottom, "first_column": a.left, "last_column": a.right, "title": a.title, "orientation": "Vertical" if a.vertical else "Horizontal", "role": "Primary" if a.primary else "Context", "value_kind": a.kind, "samples": a.samples, "sections": [{"title": t, "first_row": x, "last_row": y} for t, x, y in a.sections]})
    for i, (f, own) in enumerate(found, 1):
        r0, r1, c0, c1 = g._box(f.top, f.bottom, f.left, f.right)
        numbers = g.number[r0:r1, c0:c1][(g.kind[r0:r1, c0:c1] >= FIGURE) & (g.kind[r0:r1, c0:c1] <= DAY)]
        counts = {f"{n}_count": g.count(w, f.top, f.bottom, f.left, f.right) for n, w in (("cell", "cell"), ("numeric", "numeric"), ("text", "label"), ("formula", "formula"))}
        out.append({"item": "field", "id": f"field{i}", "first_row": f.top, "last_row": f.bottom, "first_column": f.left, "last_column": f.right, "axis_ids": [a.id for a in own], "min_numeric": float(numbers.min()) if len(numbers) else None, "max_numeric": float(numbers.max()) if len(numbers) else None} | counts)
    for i, (title, area, ids, members) in enumerate(clusters, 1):
        out.append({"item": "group", "id": f"group{i}", "first_row": area.top, "last_row": area.bottom, "first_column": area.left, "last_column": area.right, "title": title, "axis_ids": ids, "field_ids": [f"field{m + 1}" for m in members]})
    return out


def layout(cells: DataFrame) -> DataFrame:
    """Axes, measure fields and groups of all sheets of a long-form cell relation."""
    names = []
    depth = 0
    for part in SCHEMA.replace(", ", "\n").split("\n"):
        if not depth:
            names.append(part.split()[0])
        depth += part.count("<") - part.count(">")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [{"workbook": part["workbook"].iloc[0], "sheet": part["sheet"].iloc[0]} | r for r in rows_of(part.sort_values(["row", "column"]))]
        out = pd.DataFrame(rows, columns=names)
        return out.astype(object).where(out.notna(), None)

    needed = cells.where("kind > 0").select("workbook", "sheet", "row", "column", "kind", "num", "ts", "text", "is_formula")
    return needed.groupBy("workbook", "sheet").applyInPandas(run, SCHEMA)
