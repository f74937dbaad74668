"""Decoding of binary workbooks: records of a type, a length and a payload."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property

from ..errors import MalformedWorkbook, SheetNotFound
from ..functions.display import number_text
from ..functions.kinds import BOOLEAN, EMPTY, ERROR, FORMULA, TEXT
from ..plans.address import MAX_COLUMNS, MAX_ROWS, letters
from .formats import is_date_id
from .xlsx import Cell, Package, Style, numeric

#: Record types of the format.
ROW, BLANK, RK, ERR, BOOL, REAL, STRING, SHARED, F_STRING, F_NUMBER, F_BOOL, F_ERROR = range(12)
STRING_ITEM, NAME, FORMAT, XF, VALIDATION, SHEET_DATA, END_SHEET_DATA, DIMENSION, WORKBOOK, SHEET = 19, 39, 44, 47, 64, 145, 146, 148, 153, 156
MERGE, EXTERN, CONDITIONAL, LINK, CELL_FORMATS, END_CELL_FORMATS = 176, 362, 461, 494, 617, 619
LINK_SHEETS, LINK_BOOK, LINK_NAME, COMMENT, COMMENT_TEXT = 358, 360, 577, 635, 637
#: Error codes and formula tokens.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A", 0x2B: "#GETTING_DATA"}
BINARY = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}
UNARY = {0x12: "{}", 0x13: "-{}", 0x14: "{}%", 0x15: "({})"}
MOST_PAYLOAD = 16 << 20


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    at, n = 0, len(data)
    while at < n:
        kind = shift = 0
        for _ in range(2):
            if at >= n:
                return
            kind |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                break
        size = shift = 0
        for _ in range(4):
            if at >= n:
                return
            size |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                break
        if size > MOST_PAYLOAD or at + size > n:
            raise MalformedWorkbook("A record is longer than its part.")
        yield kind, data[at : at + size]
        at += size


def wide_string(data: bytes, at: int) -> tuple[str, int]:
    """A counted UTF-16 string and where it ends; null strings are empty."""
    if at + 4 > len(data):
        raise MalformedWorkbook("A string is cut off.")
    (count,) = struct.unpack_from("<I", data, at)
    if count == 0xFFFFFFFF:
        return "", at + 4
    end = at + 4 + 2 * count
    if end > len(data):
        raise MalformedWorkbook("A string is cut off.")
    return data[at + 4 : end].decode("utf-16-le", "replace"), end


def rk(data: bytes) -> float:
    """A number in four bytes: an integer or the upper bits of a double, perhaps in hundredths."""
    (raw,) = struct.unpack_from("<I", data)
    if raw & 2:
        number = float(struct.unpack("<i", struct.pack("<I", raw))[0] >> 2)
    else:
        (number,) = struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))
    return number / 100 if raw & 1 else number


class Xlsb(Package):
    format = "xlsb"

    @cached_property
    def _book(self) -> dict:
        content = self.read(self.workbook_part)
        if content is None:
            raise MalformedWorkbook("The package has no workbook part.")
        out = {"date1904": False, "sheets": {}, "extern": [], "names": []}
        targets = self.relations(self.workbook_part)
        for kind, data in records(content):
            if kind == WORKBOOK and len(data) >= 4:
                out["date1904"] = bool(data[0] & 1)
            elif kind == SHEET:
                relation, at = wide_string(data, 8)
                name, _ = wide_string(data, at)
                out["sheets"][name] = targets.get(relation, ("", "", False))[1]
            elif kind == EXTERN and len(data) >= 4:
                (count,) = struct.unpack_from("<I", data)
                out["extern"] = [struct.unpack_from("<Iii", data, 4 + 12 * i) for i in range(min(count, (len(data) - 4) // 12))]
            elif kind == NAME and len(data) >= 13:
                scope = struct.unpack_from("<I", data, 5)[0]
                name, at = wide_string(data, 9)
                out["names"].append((name, None if scope == 0xFFFFFFFF else scope, data[at:]))
        return out

    def defined_names(self) -> list[tuple[str, str | None, str]]:
        """(name, the sheet of its scope or None, what it stands for as text, empty if that has no text here)."""
        sheets = list(self.sheets)
        return [(n, sheets[i] if i is not None and i < len(sheets) else None, self.formula(f)) for n, i, f in self._book["names"]]

    def external(self, part: str) -> tuple[list[str], list[str]]:
        """Sheets and defined names of a linked workbook."""
        sheets, names = [], []
        for kind, data in records(self.read(part) or b""):
            if kind == LINK_SHEETS and len(data) >= 4:
                at = 4
                for _ in range(struct.unpack_from("<I", data)[0]):
                    name, at = wide_string(data, at)
                    sheets.append(name)
            elif kind == LINK_NAME:
                names.append(wide_string(data, 0)[0])
        return sheets, names

    def comments(self, part: str) -> list[tuple[str, str]]:
        """(cell, text) of a part's comments."""
        out, at = [], None
        for kind, data in records(self.read(part) or b""):
            if kind == COMMENT and len(data) >= 20:
                row, _, column, _ = struct.unpack_from("<IIII", data, 4)
                at = f"{letters(column + 1)}{row + 1}"
            elif kind == COMMENT_TEXT and at:
                out.append((at, wide_string(data, 1)[0]))
                at = None
        return out

    @property
    def date1904(self) -> bool:
        return self._book["date1904"]

    @property
    def sheets(self) -> dict[str, str]:
        return self._book["sheets"]

    def part(self, sheet: str) -> str:
        for name, target in self.sheets.items():
            if name.lower() == sheet.lower():
                return target
        raise SheetNotFound(f"There is no sheet '{sheet}'.")

    def _related(self, kind: str) -> bytes:
        return next((self.read(t) or b"" for k, t, _ in self.relations(self.workbook_part).values() if k == kind), b"")

    @cached_property
    def strings(self) -> list[str]:
        return [wide_string(data, 1)[0] for kind, data in records(self._related("sharedStrings")) if kind == STRING_ITEM]

    @cached_property
    def style(self) -> Style:
        custom, dates, inside = {}, [], False
        for kind, data in records(self._related("styles")):
            if kind == FORMAT and len(data) >= 6:
                custom[struct.unpack_from("<H", data)[0]] = wide_string(data, 2)[0]
            elif kind in (CELL_FORMATS, END_CELL_FORMATS):
                inside = kind == CELL_FORMATS
            elif kind == XF and inside and len(data) >= 4:
                dates.append(struct.unpack_from("<H", data, 2)[0])
        return Style([is_date_id(i, custom) for i in dates])

    def cells(self, sheet: str, formulas: bool = False) -> Iterator[Cell]:
        content = self.read(self.part(sheet))
        if content is None:
            raise MalformedWorkbook(f"Sheet '{sheet}' has no part.")
        row, inside = 0, False
        for kind, data in records(content):
            if kind == SHEET_DATA:
                inside = True
            elif kind == END_SHEET_DATA:
                return
            elif not inside:
                continue
            elif kind == ROW and len(data) >= 4:
                row = struct.unpack_from("<I", data)[0] + 1
            elif BLANK <= kind <= F_ERROR and len(data) >= 8:
                column = struct.unpack_from("<I", data)[0] + 1
                if row <= MAX_ROWS and column <= MAX_COLUMNS:
                    yield self._cell(kind, data, row, column, formulas)

    def _cell(self, kind: int, data: bytes, row: int, column: int, formulas: bool) -> Cell:
        out, style, body = Cell(row, column), int.from_bytes(data[4:7], "little"), data[8:]
        after = len(body)
        if kind == RK and len(body) >= 4:
            out.kind, out.value = numeric(rk(body), self.style.is_date(style), self.date1904)
        elif kind in (REAL, F_NUMBER) and len(body) >= 8:
            out.kind, out.value = numeric(struct.unpack_from("<d", body)[0], self.style.is_date(style), self.date1904)
            after = 8
        elif kind in (BOOL, F_BOOL) and body:
            out.kind, out.value, after = BOOLEAN, body[0] != 0, 1
        elif kind in (ERR, F_ERROR) and body:
            out.kind, out.value, after = ERROR, ERRORS.get(body[0], "#UNKNOWN!"), 1
        elif kind in (STRING, F_STRING):
            value, after = wide_string(body, 0)
            out.kind, out.value = TEXT, value
        elif kind == SHARED and len(body) >= 4:
            (index,) = struct.unpack_from("<I", body)
            out.kind, out.value = (TEXT, self.strings[index]) if index < len(self.strings) else (EMPTY, None)
        if kind >= F_STRING:
            out.has_formula = True
            out.formula = self.formula(body[after + 2 :])
            if formulas and out.formula:
                out.kind, out.value = FORMULA, out.formula
        return out

    def formula(self, data: bytes) -> str:
        """The text of a parsed formula; empty if any token is beyond operators, scalars and references."""
        if len(data) < 4:
            return ""
        (size,) = struct.unpack_from("<I", data)
        tokens, at, stack = data[4 : 4 + size], 0, []
        try:
            while at < len(tokens):
                token = tokens[at]
                if token in BINARY:
                    right, left = stack.pop(), stack.pop()
                    stack.append(f"{left}{BINARY[token]}{right}")
                    at += 1
                elif token in UNARY:
                    stack.append(UNARY[token].format(stack.pop()))
                    at += 1
                else:
                    text, at = self._operand(tokens, at)
                    stack.append(text)
        except (IndexError, KeyError, struct.error, MalformedWorkbook):
            return ""
        return stack[0] if len(stack) == 1 else ""

    def _operand(self, t: bytes, at: int) -> tuple[str, int]:
        kind = t[at]
        if kind == 0x17:
            text, end = wide_string(t, at + 1)
            return '"' + text.replace('"', '""') + '"', end
        if kind == 0x1C:
            return ERRORS.get(t[at + 1], "#UNKNOWN!"), at + 2
        if kind == 0x1D:
            return ("TRUE" if t[at + 1] else "FALSE"), at + 2
        if kind == 0x1E:
            return str(struct.unpack_from("<H", t, at + 1)[0]), at + 3
        if kind == 0x1F:
            return number_text(struct.unpack_from("<d", t, at + 1)[0]), at + 9
        base = kind & 0x1F | 0x20
        sizes = {0x24: 7, 0x25: 13, 0x2A: 7, 0x2B: 13, 0x3A: 9, 0x3B: 15, 0x3C: 7, 0x3D: 7}
        size = sizes[base]
        if at + size > len(t):
            raise IndexError(at)
        body = t[at + 1 : at + size]
        if base in (0x2A, 0x2B):
            return "#REF!", at + size
        if base == 0x24:
            return reference(*struct.unpack_from("<IH", body)), at + size
        if base == 0x25:
            return area(body), at + size
        prefix = self._prefix(struct.unpack_from("<H", body)[0])
        if prefix is None:
            return "#REF!", at + size
        inner = {0x3A: lambda: reference(*struct.unpack_from("<IH", body, 2)), 0x3B: lambda: area(body[2:])}.get(base, lambda: "#REF!")()
        return f"{prefix}!{inner}", at + size

    def _prefix(self, index: int) -> str | None:
        extern, names = self._book["extern"], list(self.sheets)
        if index >= len(extern):
            return None
        _, first, last = extern[index]
        if not 0 <= first <= last < len(names):
            return None
        name = names[first] if first == last else f"{names[first]}:{names[last]}"
        return name if name.replace("_", "").replace(":", "").replace(".", "").isalnum() and not name[0].isdigit() else "'" + name.replace("'", "''") + "'"

    def tail(self, sheet: str) -> dict[str, list]:
        out: dict[str, list] = {"dimension": [], "merge": [], "validation": [], "hyperlink": [], "conditional": []}
        for kind, data in records(self.read(self.part(sheet)) or b""):
            found = {DIMENSION: "dimension", MERGE: "merge", LINK: "hyperlink"}.get(kind)
            if found and len(data) >= 16:
                top, bottom, left, right = struct.unpack_from("<IIII", data)
                start, end = f"{letters(left + 1)}{top + 1}", f"{letters(right + 1)}{bottom + 1}"
                out[found].append({"ref": start if start == end else f"{start}:{end}"})
            elif kind in (CONDITIONAL, VALIDATION):
                out["conditional" if kind == CONDITIONAL else "validation"].append({"ref": None})
        return out


def reference(row: int, column: int) -> str:
    fixed = lambda bit: "" if column & bit else "$"
    return f"{fixed(0x4000)}{letters((column & 0x3FFF) + 1)}{fixed(0x8000)}{row + 1}"


def area(body: bytes) -> str:
    top, bottom, left, right = struct.unpack_from("<IIHH", body)
    return f"{reference(top, left)}:{reference(bottom, right)}"
