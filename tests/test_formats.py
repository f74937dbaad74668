"""Decoding without Spark: addresses, dates, formats, display, packages, binary workbooks, macros."""

import datetime as dt
import io
import struct
import zipfile

import pytest

from gridlark.errors import InvalidAddress, MalformedWorkbook, QueryDslError
from gridlark.functions.display import number_text
from gridlark.functions.kinds import BOOLEAN, DATE, EMPTY, ERROR, FORMULA, NUMBER, TEXT
from gridlark.operators.metadata import items_of
from gridlark.plans.address import Range, column_number, letters, parse_cell, parse_range
from gridlark.plans.ast import QuerySpec
from gridlark.sources import vba
from gridlark.sources.formats import is_date_format, to_date
from gridlark.sources.xlsb import Xlsb, rk
from gridlark.sources.xlsx import Xlsx, open_package

from .books import HEAD, REL, book, sheet_xml


def test_addresses():
    assert [letters(n) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(column_number(letters(n)) == n for n in range(1, 16385, 7))
    assert parse_cell("xfd1048576") == (16384, 1048576)
    assert parse_range("A1:C5") == Range(1, 1, 3, 5) and str(parse_range("b2")) == "B2" and parse_range("A:C").height == 1048576
    assert parse_range("2:4").top == 2 and parse_range(":").unbounded
    for bad in ("", "A0", "XFE1", "A1:", "C5:A1", "1:A", "A1048577", "A1B"):
        with pytest.raises(InvalidAddress):
            parse_range(bad)


@pytest.mark.parametrize(("serial", "date"), [(0, dt.datetime(1, 1, 1)), (1, dt.datetime(1900, 1, 1)), (59, dt.datetime(1900, 2, 28)), (60, None), (61, dt.datetime(1900, 3, 1)), (45306.5, dt.datetime(2024, 1, 15, 12)), (-1, None), (3e6, None)])
def test_dates(serial, date):
    assert to_date(serial) == date
    assert to_date(0, True) == dt.datetime(1904, 1, 1)


@pytest.mark.parametrize(
    ("code", "date"),
    [("yyyy-mm-dd", True), ("0.00", False), ('"day" 0', False), ("[h]:mm", True), ("[Red]0.0", False), ("General", False), ("h:mm AM/PM", True), ("0.00E+00", False), ('0 "h"', False), ("#,##0;[Red]d", False), ("@", False), ("mmm\\-yy", True), ("[$-409]d mmm", True), ("0_d", False), ("ss.0", True)],
)
def test_formats(code, date):
    assert is_date_format(code) == date


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (-0.5, "-0.5"), (1e15, "1E+15"), (123456789012345.0, "123456789012345"), (0.0001, "0.0001"), (0.00001, "1E-05"), (1.5e-7, "1.5E-07"), (1e300, "1E+300"), (0.1 + 0.2, "0.30000000000000004"), (-0.0, "-0")])
def test_number_text(x, text):
    assert number_text(x) == text


def test_number_column(spark):
    from pyspark.sql import functions as F

    from gridlark.functions.display import number_column

    numbers = [1.0, 0.5, -0.5, 1e10, 1234567.25, 1e15, 0.0001, 0.00012, 1e-5, 1.5e-7, 1e300, 0.1 + 0.2, 12345678901.5, -2.5e-9]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", number_column(F.col("x"))).collect()
    assert {x: t for x, t in got} == {x: number_text(x) for x in numbers}


def cells(xml, **more):
    return [(c.row, c.column, c.kind, c.value) for c in Xlsx(book({"S": sheet_xml({}).replace("<sheetData>", f"<sheetData>{xml}")}, **more)).cells("S")]


def test_cells():
    xml = '<row><c><v>1</v></c><c t="s"><v>0</v></c><c t="s"><v>9</v></c></row><row r="5"><c r="C5" t="b"><v> true </v></c><c t="e"><v>#N/A</v></c><c s="1"><v>60</v></c><c s="1"><v>61</v></c><c><v>x</v></c><c t="str"><v>a_x000A_b</v></c><c/></row><row r="1048577"><c><v>1</v></c></row>'
    strings = ["<si><r><t>ri</t></r><r><t>ch &amp; x</t></r></si>"]
    assert cells(xml, strings=strings) == [
        (1, 1, NUMBER, 1.0), (1, 2, TEXT, "rich & x"), (1, 3, EMPTY, None), (5, 3, BOOLEAN, True), (5, 4, ERROR, "#N/A"), (5, 5, EMPTY, None),
        (5, 6, DATE, dt.datetime(1900, 3, 1)), (5, 7, EMPTY, None), (5, 8, TEXT, "a\nb"), (5, 9, EMPTY, None),
    ]
    with pytest.raises(MalformedWorkbook):
        cells('<row><c t="b"><v>maybe</v></c></row>')
    with pytest.raises(MalformedWorkbook):
        cells("<row><c>")
    with pytest.raises(MalformedWorkbook):
        open_package(b"no zip")
    assert [c.value for c in Xlsx(book({"S": sheet_xml({}).replace("<sheetData>", '<sheetData><row><c><f t="shared" si="0">A1</f><v>1</v></c><c><f t="shared" si="0"/><v>2</v></c></row>')})).cells("S", formulas=True)] == ["A1", 2.0]


def record(kind, data=b""):
    head = bytes([kind]) if kind < 128 else bytes([kind & 0x7F | 0x80, kind >> 7])
    size, out = len(data), b""
    while True:
        out += bytes([size & 0x7F | (0x80 if size > 127 else 0)])
        size >>= 7
        if not size:
            return head + out + data


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def binary_book(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'{HEAD}<Relationships><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.bin"/></Relationships>')
        links = f'<Relationship Id="rId1" Type="{REL}/worksheet" Target="worksheets/sheet1.bin"/><Relationship Id="s1" Type="{REL}/styles" Target="styles.bin"/><Relationship Id="s2" Type="{REL}/sharedStrings" Target="sharedStrings.bin"/>'
        z.writestr("xl/_rels/workbook.bin.rels", f"{HEAD}<Relationships>{links}</Relationships>")
        z.writestr("xl/workbook.bin", record(153, b"\0" * 8) + record(156, b"\0" * 8 + wide("rId1") + wide("My S")) + record(362, struct.pack("<IIii", 1, 0, 0, 0)))
        z.writestr("xl/styles.bin", record(617) + record(47, struct.pack("<HH", 0, 0)) + record(47, struct.pack("<HH", 0, 14)) + record(619))
        z.writestr("xl/sharedStrings.bin", record(19, b"\0" + wide("shared")))
        z.writestr("xl/worksheets/sheet1.bin", record(145) + b"".join(rows) + record(146) + record(176, struct.pack("<IIII", 0, 0, 0, 1)))
    return out.getvalue()


def cell(kind, column, body, style=0):
    return record(kind, struct.pack("<II", column, style) + body)


def test_binary_workbook(spark):
    def formula(tokens):
        return b"\0\0" + struct.pack("<I", len(tokens)) + tokens

    reference = b"\x44" + struct.pack("<IH", 0, 0xC000)
    outside = b"\x5a" + struct.pack("<HIH", 0, 1, 1)
    plus = reference + outside + b"\x03" + b"\x1e\x07\x00" + b"\x05"
    rows = [
        record(0, struct.pack("<I", 0)), cell(7, 0, struct.pack("<I", 0)), cell(6, 1, wide("text")), cell(2, 2, struct.pack("<I", 5 << 2 | 2)), cell(5, 3, struct.pack("<d", 45306.0), 1),
        record(0, struct.pack("<I", 1)), cell(1, 0, b""),
        record(0, struct.pack("<I", 2)), cell(4, 0, b"\1"), cell(3, 1, b"\x07"), cell(9, 2, struct.pack("<d", 2.5) + formula(plus)), cell(9, 3, struct.pack("<d", 3.0) + formula(b"\x22\1\4\0")),
    ]
    content = binary_book(rows)
    p = open_package(content)
    assert isinstance(p, Xlsb) and list(p.sheets) == ["My S"] and p.format == "xlsb"
    got = [(c.row, c.column, c.kind, c.value) for c in p.cells("my s")]
    assert got == [(1, 1, TEXT, "shared"), (1, 2, TEXT, "text"), (1, 3, NUMBER, 5.0), (1, 4, DATE, dt.datetime(2024, 1, 15)), (2, 1, EMPTY, None), (3, 1, BOOLEAN, True), (3, 2, ERROR, "#DIV/0!"), (3, 3, NUMBER, 2.5), (3, 4, NUMBER, 3.0)]
    assert [(c.kind, c.value) for c in p.cells("My S", formulas=True)][-2:] == [(FORMULA, "A1+'My S'!$B$2*7"), (NUMBER, 3.0)]
    assert p.tail("My S")["merge"] == [{"ref": "A1:B1"}]
    from gridlark.api import Workbook

    opened = Workbook.open(spark, content)
    assert opened.format == "xlsb" and [r for r, _ in opened.stream_rows("My S")] == [1, 3]


def test_binary_metadata():
    """Names of the book and of a sheet, comments, and a linked workbook."""
    def rewritten(content, parts):
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content)) as a, zipfile.ZipFile(out, "w") as b:
            for n in a.namelist():
                b.writestr(n, parts.pop(n)(a.read(n)) if n in parts else a.read(n))
            for n, made in parts.items():
                b.writestr(n, made(b""))
        return out.getvalue()

    tokens = b"\x44" + struct.pack("<IH", 2, 0)
    named = lambda name, scope: record(39, bytes(5) + struct.pack("<I", scope) + wide(name) + struct.pack("<I", len(tokens)) + tokens)
    comment = record(635, struct.pack("<IIIII", 0, 4, 4, 1, 1) + bytes(16)) + record(637, b"\0" + wide("a note")) + record(636)
    content = rewritten(binary_book([record(0, struct.pack("<I", 0)), cell(6, 0, wide("x"))]), {
        "xl/workbook.bin": lambda old: old + named("Total", 0xFFFFFFFF) + named("Own", 0),
        "xl/_rels/workbook.bin.rels": lambda old: old.replace(b"</Relationships>", f'<Relationship Id="e1" Type="{REL}/externalLink" Target="externalLinks/externalLink1.bin"/></Relationships>'.encode()),
        "xl/externalLinks/externalLink1.bin": lambda _: record(360, b"\0\0" + wide("rId1") + wide("")) + record(358, struct.pack("<I", 2) + wide("First") + wide("Second")) + record(577, wide("Rate")),
        "xl/externalLinks/_rels/externalLink1.bin.rels": lambda _: f'<Relationships><Relationship Id="rId1" Type="{REL}/externalLinkPath" Target="other.xlsx" TargetMode="External"/></Relationships>'.encode(),
        "xl/worksheets/_rels/sheet1.bin.rels": lambda _: f'<Relationships><Relationship Id="c" Type="{REL}/comments" Target="../comments1.bin"/></Relationships>'.encode(),
        "xl/comments1.bin": lambda _: comment,
    })
    found = [(x["kind"], x["sheet"], x["name"], x["ref"], x["parts"], x["detail"]) for x in items_of(content) if x["kind"] in ("name", "comment", "link")]
    assert sorted(found, key=str) == sorted([("name", None, "Total", "$A$3", [], None), ("name", "My S", "Own", "$A$3", [], None), ("comment", "My S", None, "B5", [], "a note"), ("link", None, "externalLink1.bin", "other.xlsx", ["First", "Second"], "Rate")], key=str)


@pytest.mark.parametrize(("raw", "number"), [(5 << 2 | 2, 5), (0xFFFFFFFE, -1), (12345 << 2 | 3, 123.45), (0x3FF00000, 1.0), (0x40590001, 1.0)])
def test_rk(raw, number):
    assert rk(struct.pack("<I", raw)) == number


def test_macro_sources():
    stored = b"Sub A()\r\nEnd Sub\r\n"
    raw = b"\1" + struct.pack("<H", 0x3000 | (4096 - 1)) + stored.ljust(4096, b" ")
    assert vba.decompress(raw).startswith(stored)
    # Literals a, b, then a copy of two from two back, three times over.
    packed = bytes([0b100]) + b"ab" + struct.pack("<H", (1 << 12) | 3)
    assert vba.decompress(b"\1" + struct.pack("<H", 0xB000 | (len(packed) - 1)) + packed) == b"ab" + b"ababab"
    with pytest.raises(MalformedWorkbook):
        vba.decompress(b"\2")
    with pytest.raises(MalformedWorkbook):
        vba.CompoundFile(b"x" * 600)


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("", "FROM"),
        ("FROM S!A1 HEADER ROW 1 SELECT *", "bounded"),
        ("FROM S!B2:A1 HEADER ROW 1 SELECT *", "bounded"),
        ("FROM S!A1:B2 HEADER ROW 0 SELECT *", "positive"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT a ORDER BY a", "LIMIT"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT SUM(a) ORDER BY a LIMIT 1", "global aggregate"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT a, SUM(b)", "mix"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT a, SUM(b) GROUP BY c", "GROUP BY"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT SUM(SUM(a))", "Nested"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT a WHERE SUM(a) > 1", "WHERE"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT a HAVING a > 1", "HAVING"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT COUNT(a)", "COUNT"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT a AS x, b AS X", "alias"),
        ("FROM S!A1:B2 HEADER ROW 1 SELECT UPPER(a)", "UPPER"),
        ("SELECT DATE_TRUNC('week', a) FROM S!A1:B2 HEADER ROW 1", "unit"),
        ("SELECT a FROM S!A1:B2 HEADER ROW 1 WHERE a < TRUE", "Boolean"),
        ("SELECT a FROM S!A1:B2 HEADER ROW 1 WHERE a IN ()", "IN"),
        ("SELECT a FROM S!A1:B2 HEADER ROW 1 LIMIT -1", "non-negative"),
        ("SELECT a FROM S!A1:B2 HEADER ROW 1 WHERE a = 'x", "Unterminated"),
        ("SELECT SUM(a) FROM S!A1:B2 HEADER ROW 1 GROUP BY b ORDER BY c", "Valid keys: b, Sum(a)"),
        ("SELECT " + "(" * 70 + "a" + ")" * 70 + " FROM S!A1:B2 HEADER ROW 1", "depth"),
    ],
)
def test_query_errors(query, message):
    with pytest.raises(QueryDslError) as e:
        QuerySpec.parse(query)
    assert message.lower() in str(e.value).lower()


def test_query_forms():
    simple = QuerySpec.parse('FROM [My Sheet]!A1:B2 HEADER ROW 1 SELECT AVG(x) WHERE "y z" = "v" GROUP BY [k]')
    assert simple.simple and simple.sheet == "My Sheet" and simple.where_expression == "(y z = 'v')" and simple.group_by_expressions == ["k"]
    full = QuerySpec.parse("SELECT a.b, [c d] AS e FROM 'S'!A1:B2 HEADER COLUMN AB WHERE NOT a.b = 1 OR e IS NOT EMPTY AND x IN (1, 'y', NULL)")
    assert not full.simple and full.header.column == "AB" and full.select_expressions == ["a.b", "c d"]
    assert full.where_expression == "(NOT((a.b = 1)) OR (e IS NOT EMPTY AND x IN (1, 'y', EMPTY)))"
    assert QuerySpec.parse("SELECT 1 - 2 - 3 * 4 % 5 FROM S!A1:B2 HEADER ROW 1").select_expressions == ["((1 - 2) - ((3 * 4) % 5))"]
