"""Decoding of xlsx and xlsm packages, from bytes to cells and metadata. No Spark here."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from html import unescape as html_unescape
from xml.etree import ElementTree

from ..errors import InvalidAddress, MalformedWorkbook, SheetNotFound
from ..functions.kinds import BOOLEAN, DATE, EMPTY, ERROR, FORMULA, NUMBER, TEXT
from ..plans.address import MAX_COLUMNS, MAX_ROWS, column_number, parse_cell
from .formats import is_date_id, to_date

_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_PARTS = re.compile(rb"<(?:row\b([^>]*)>|c(\s[^>]*?|)(?:/>|>(.*?)</c>))", re.S)
_PAIRS = re.compile(rb"([\w:]+)\s*=\s*(['\"])(.*?)\2", re.S)
_USUAL = re.compile(rb' r="([A-Z]{1,3})[0-9]+"(?: s="([0-9]+)")?(?: t="(\w+)")?')
_ROW_NUMBER = re.compile(rb"(?:^|\s)r\s*=\s*['\"](\d+)['\"]")
_FORMULA = re.compile(rb"<f(\s[^>]*?|)(?:/>|>(.*?)</f>)", re.S)
_VALUE = re.compile(rb"<v\s[^>]*>(.*?)</v>", re.S)
_TEXTS = re.compile(rb"<t(?:\s[^>]*)?>(.*?)</t>", re.S)


@cache
def column_of(name: bytes) -> int:
    """The number of column letters; 0 if they are none."""
    try:
        return column_number(name.decode())
    except InvalidAddress:
        return 0


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(node, name: str, default=None):
    """An attribute by local name, whatever its namespace."""
    for k, v in node.attrib.items():
        if local(k) == name:
            return v
    return default


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def rich_text(node) -> str:
    """All runs of a string item, in order; phonetic guides have runs too."""
    return unescape("".join(t.text or "" for t in node.iter() if local(t.tag) == "t"))


@dataclass(slots=True)
class Cell:
    row: int
    column: int
    kind: int = EMPTY
    value: object = None
    formula: str | None = None
    array: bool = False
    has_formula: bool = False


@dataclass
class Style:
    dates: list[bool] = field(default_factory=list)

    def is_date(self, index: int) -> bool:
        return 0 <= index < len(self.dates) and self.dates[index]


class Package:
    """A workbook's parts. Subclasses decode the parts of their format."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise MalformedWorkbook(f"Not a workbook: {e}") from None
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def read(self, part: str) -> bytes | None:
        found = self.names.get(part.lower().lstrip("/"))
        return None if found is None else self.zip.read(found)

    def tree(self, part: str):
        content = self.read(part)
        if content is None:
            return None
        try:
            return ElementTree.fromstring(content)
        except ElementTree.ParseError as e:
            raise MalformedWorkbook(f"{part}: {e}") from None

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """By id: type's last word, target part, and whether it is external."""
        folder, name = posixpath.split(part)
        tree = self.tree(f"{folder}/_rels/{name}.rels".lstrip("/"))
        out = {}
        for r in tree if tree is not None else ():
            external = attribute(r, "TargetMode") == "External"
            target = attribute(r, "Target", "")
            if not external:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[attribute(r, "Id")] = (attribute(r, "Type", "").rpartition("/")[2], target, external)
        return out

    @cached_property
    def workbook_part(self) -> str:
        for kind, target, _ in self.relations("").values():
            if kind == "officeDocument":
                return target
        return "xl/workbook.xml" if "xl/workbook.xml" in self.names else "xl/workbook.bin"

    @property
    def has_macros(self) -> bool:
        return "xl/vbaproject.bin" in self.names


class Xlsx(Package):
    @property
    def format(self) -> str:
        return "xlsm" if self.has_macros else "xlsx"

    @cached_property
    def workbook(self):
        tree = self.tree(self.workbook_part)
        if tree is None:
            raise MalformedWorkbook("The package has no workbook part.")
        return tree

    def _all(self, node, name: str) -> list:
        return [x for x in node.iter() if local(x.tag) == name]

    @cached_property
    def date1904(self) -> bool:
        return any(attribute(p, "date1904") in ("1", "true") for p in self._all(self.workbook, "workbookPr"))

    @cached_property
    def sheets(self) -> dict[str, str]:
        """Part by sheet name, in order."""
        targets = self.relations(self.workbook_part)
        out = {}
        for s in self._all(self.workbook, "sheet"):
            kind, target, _ = targets.get(attribute(s, "id"), ("", "", False))
            if kind in ("worksheet", ""):
                out[attribute(s, "name")] = target
        return out

    def part(self, sheet: str) -> str:
        for name, target in self.sheets.items():
            if name.lower() == sheet.lower():
                return target
        raise SheetNotFound(f"There is no sheet '{sheet}'.")

    def _related(self, kind: str) -> str | None:
        return next((t for k, t, _ in self.relations(self.workbook_part).values() if k == kind), None)

    @cached_property
    def strings(self) -> list[str]:
        part = self._related("sharedStrings") or "xl/sharedStrings.xml"
        content = self.read(part)
        if content is None:
            return []
        out = []
        try:
            for _, node in ElementTree.iterparse(io.BytesIO(content)):
                if local(node.tag) == "si":
                    out.append(rich_text(node))
                    node.clear()
        except ElementTree.ParseError as e:
            raise MalformedWorkbook(f"{part}: {e}") from None
        return out

    @cached_property
    def style(self) -> Style:
        tree = self.tree(self._related("styles") or "xl/styles.xml")
        if tree is None:
            return Style()
        custom = {int(attribute(f, "numFmtId", 0)): attribute(f, "formatCode", "") for f in self._all(tree, "numFmt")}
        formats = next((x for x in tree if local(x.tag) == "cellXfs"), ())
        return Style([is_date_id(int(attribute(x, "numFmtId", 0) or 0), custom) for x in formats])

    @cached_property
    def string_array(self):
        import numpy as np

        out = np.empty(len(self.strings), object)
        out[:] = self.strings
        return out

    def scan_state(self, sheet: str, formulas: bool) -> Scan:
        part = self.names.get(self.part(sheet).lower().lstrip("/"))
        if part is None:
            raise MalformedWorkbook(f"Sheet '{sheet}' has no part.")
        return Scan(self, sheet, part, formulas)

    def cells(self, sheet: str, formulas: bool = False) -> Iterator[Cell]:
        """Every cell element in document order; missing references follow on from the one before."""
        scan = self.scan_state(sheet, formulas)
        for body in scan.bodies(4 << 20):
            yield from scan.cells(body)

    def _fill(self, out: Cell, inner: bytes, kind: bytes | None, style: bytes | None, formulas: bool, shared: dict[str, str]) -> None:
        formula = value = None
        kind = kind.decode() if kind else "n"
        if b"<f" in inner and (f := _FORMULA.search(inner)):
            out.has_formula = True
            formula = unescape(html_unescape(f[2].decode())) if f[2] else ""
            own = {k: v for k, _, v in _PAIRS.findall(f[1])}
            out.array, out.formula = own.get(b"t") == b"array", formula
            if own.get(b"t") == b"shared" and b"si" in own:
                index = own[b"si"].decode()
                if formula:
                    shared[index] = formula
                out.formula = formula or shared.get(index)
        if formulas and formula:
            out.kind, out.value = FORMULA, formula
        elif kind == "inlineStr":
            if b"<is" in inner:
                out.kind, out.value = TEXT, unescape(html_unescape("".join(t.decode() for t in _TEXTS.findall(inner))))
        else:
            at = inner.find(b"<v>")
            if at >= 0:
                value = inner[at + 3 : inner.find(b"</v>", at)].decode()
            elif b"<v " in inner and (v := _VALUE.search(inner)):
                value = v[1].decode()
            elif b"<v/>" in inner:
                value = ""
            if value is not None:
                out.kind, out.value = self._decode(kind, html_unescape(value) if "&" in value else value, int(style) if style and style.isdigit() else 0)

    def _cell(self, node, row: int, column: int, formulas: bool, shared: dict[str, str]) -> Cell:
        kind, style = attribute(node, "t", "n"), _number(attribute(node, "s"), 0)
        value = inline = formula = None
        out = Cell(row, column)
        for child in node:
            tag = local(child.tag)
            if tag == "v":
                value = child.text or ""
            elif tag == "is":
                inline = rich_text(child)
            elif tag == "f":
                out.has_formula = True
                formula = unescape(child.text or "")
                how, index = attribute(child, "t"), attribute(child, "si")
                out.array = how == "array"
                if how == "shared" and index is not None:
                    if formula:
                        shared[index] = formula
                    out.formula = formula or shared.get(index)
                else:
                    out.formula = formula
        if formulas and formula:
            out.kind, out.value = FORMULA, formula
        elif kind == "inlineStr":
            if inline is not None:
                out.kind, out.value = TEXT, inline
        elif value is not None:
            out.kind, out.value = self._decode(kind, value, style)
        return out

    def _decode(self, kind: str, value: str, style: int) -> tuple[int, object]:
        if kind == "s":
            index = _number(value.strip(), -1)
            return (TEXT, self.strings[index]) if 0 <= index < len(self.strings) else (EMPTY, None)
        if kind == "str":
            return TEXT, unescape(value)
        if kind == "e":
            return ERROR, value.strip()
        if kind == "b":
            if (flag := value.strip().lower()) not in ("0", "1", "true", "false"):
                raise MalformedWorkbook(f"Not a boolean: {value!r}")
            return BOOLEAN, flag in ("1", "true")
        if kind == "d":
            return TEXT, value
        return numeric(value, self.style.is_date(style), self.date1904)

    def tail(self, sheet: str) -> dict[str, list]:
        """What stands around the cells: dimension, merges, validations, hyperlinks, conditional formats, related parts."""
        tree = self.tree(self.part(sheet))
        out: dict[str, list] = {"dimension": [], "merge": [], "validation": [], "hyperlink": [], "conditional": []}
        for node in tree if tree is not None else ():
            tag = local(node.tag)
            if tag == "dimension":
                out["dimension"].append({"ref": attribute(node, "ref")})
            elif tag == "mergeCells":
                out["merge"] += [{"ref": attribute(m, "ref")} for m in node]
            elif tag == "dataValidations":
                out["validation"] += [{"ref": attribute(v, "sqref"), "type": attribute(v, "type", "none"), "formula": next((f.text for f in v if local(f.tag) == "formula1"), None)} for v in node]
            elif tag == "hyperlinks":
                out["hyperlink"] += [{"ref": attribute(h, "ref"), "target": attribute(h, "location")} for h in node]
            elif tag == "conditionalFormatting":
                out["conditional"].append({"ref": attribute(node, "sqref")})
        return out


class Scan:
    """A sheet's markup read piece by piece, with what one piece leaves for the next: the row and shared formulas."""

    def __init__(self, package: Xlsx, sheet: str, part: str, formulas: bool):
        self.package, self.sheet, self.part, self.formulas = package, sheet, part, formulas
        self.row, self.shared, self.head = 0, {}, b""

    def bodies(self, size: int) -> Iterator[bytes]:
        """Whole rows of markup, about `size` bytes at a time; of sheets in an unusual form, all at once from their first byte."""
        with self.package.zip.open(self.part) as stream:
            held = stream.read(1 << 16)
            start = held.find(b"<sheetData>")
            while start < 0 and b"<sheetData/>" not in held and len(held) < 1 << 22 and (more := stream.read(1 << 16)):
                held += more
                start = held.find(b"<sheetData>")
            if start < 0 or held[:200].find(b"UTF-16") >= 0 or any(x in held[:start] for x in (b"<!--", b"<!DOCTYPE", b"<![CDATA[")):
                self.head = b""
                yield held + stream.read()
                return
            self.head, held = held[: start + 11], held[start + 11 :]
            while (end := held.find(b"</sheetData>")) < 0:
                more = stream.read(size)
                if not more:
                    raise MalformedWorkbook(f"Sheet '{self.sheet}': its cells don't end.")
                held += more
                if (cut := held.rfind(b"</row>")) >= 0 and b"</sheetData>" not in held and held.rfind(b"<!--") <= held.rfind(b"-->") and held.rfind(b"<![CDATA[") <= held.rfind(b"]]>"):
                    yield held[: cut + 6]
                    held = held[cut + 6 :]
            if end:
                yield held[:end]

    def cells(self, body: bytes) -> Iterator[Cell]:
        """The cells of one of bodies()."""
        if not self.head:
            yield from self._walk(body)
        elif b"<![CDATA[" in body or b"<!--" in body:
            name = re.search(rb"<([\w:]*worksheet)\b", self.head)
            yield from self._walk(self.head + body + b"</sheetData></" + (name[1] if name else b"worksheet") + b">")
        else:
            yield from self._scan(body)

    def _scan(self, body: bytes) -> Iterator[Cell]:
        """Of plain markup, by one pattern for rows and cells; about five times as fast as a tree."""
        column = seen = 0
        for found in _PARTS.finditer(body):
            line, attributes, inner = found.groups()
            if line is not None:
                number = _ROW_NUMBER.search(line)
                self.row, column = int(number[1]) if number else self.row + 1, 0
                continue
            seen += 1
            column += 1
            if usual := _USUAL.fullmatch(attributes):
                name, style, kind = usual.groups()
                column = column_of(name)
            else:
                known = {k: v for k, _, v in _PAIRS.findall(attributes)}
                style, kind = known.get(b"s"), known.get(b"t")
                if reference := known.get(b"r"):
                    column = column_of(reference.rstrip(b"0123456789")) or column
            if not (1 <= self.row <= MAX_ROWS and column <= MAX_COLUMNS):
                continue
            out = Cell(self.row, column)
            if inner:
                self.package._fill(out, inner, kind, style, self.formulas, self.shared)
            yield out
        if seen != body.count(b"<c ") + body.count(b"<c>") + body.count(b"<c/"):
            raise MalformedWorkbook(f"Sheet '{self.sheet}' has cells that don't end.")

    def _walk(self, content: bytes) -> Iterator[Cell]:
        """The same of any markup, by its tree."""
        column = 0
        try:
            for event, node in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
                tag = local(node.tag)
                if event == "start":
                    if tag == "row":
                        self.row, column = _number(attribute(node, "r"), self.row + 1), 0
                    elif tag == "c":
                        column += 1
                        if reference := attribute(node, "r"):
                            try:
                                column = parse_cell(reference)[0]
                            except InvalidAddress:
                                letters = re.match(r"[A-Za-z]{1,3}", reference)
                                column = column_number(letters[0]) if letters else column
                    continue
                if tag == "c":
                    if 1 <= self.row <= MAX_ROWS and column <= MAX_COLUMNS:
                        yield self.package._cell(node, self.row, column, self.formulas, self.shared)
                    node.clear()
                elif tag == "row":
                    node.clear()
                elif tag == "sheetData":
                    return
        except ElementTree.ParseError as e:
            raise MalformedWorkbook(f"Sheet '{self.sheet}': {e}") from None


def _number(text: str | None, default: int) -> int:
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def numeric(value: str | float, date: bool, date1904: bool) -> tuple[int, object]:
    try:
        number = float(value)
    except ValueError:
        return EMPTY, None
    if not date:
        return NUMBER, number
    found = to_date(number, date1904)
    return (EMPTY, None) if found is None else (DATE, found)


def open_package(content: bytes) -> Package:
    """By what the package holds, whatever its name says."""
    package = Xlsx(content)
    if package.workbook_part.lower().endswith(".bin"):
        from .xlsb import Xlsb

        return Xlsb(content)
    return package
