"""What a workbook holds besides cells: tables, pivots, charts, comments, names, links, validations, macros."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.xlsx import Package, Xlsx, attribute, local, open_package, rich_text

#: kind: dimension, merge, validation, hyperlink, conditional, table, pivot, chart, comment, drawing, name, link, vba_project, vba_module.
ITEMS = T.StructType([
    T.StructField("workbook", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("detail", T.StringType()),
])


def item(sheet, kind, name=None, ref=None, parts=(), detail=None) -> dict:
    return {"sheet": sheet, "kind": kind, "name": name, "ref": ref, "parts": list(parts), "detail": detail}


def texts(tree, name: str) -> list[str]:
    return [x.text or "" for x in tree.iter() if local(x.tag) == name]


def chart_items(p: Package, sheet: str, part: str) -> list[dict]:
    tree = p.tree(part)
    if tree is None:
        return []
    title = next((x for x in tree.iter() if local(x.tag) == "title"), None)
    words = "" if title is None else "".join(texts(title, "t"))
    return [item(sheet, "chart", words or None, part, dict.fromkeys(texts(tree, "f")))]


def related_items(p: Package, sheet: str, part: str) -> list[dict]:
    out = []
    for kind, target, external in p.relations(part).values():
        if kind == "comments" and target.endswith(".bin") and not external:
            out += [item(sheet, "comment", None, at, detail=words) for at, words in p.comments(target)]
            continue
        tree = None if external else p.tree(target) if target.endswith((".xml", ".vml")) and kind != "vmlDrawing" else None
        if tree is None:
            continue
        if kind == "table":
            columns = [attribute(c, "name") for c in tree.iter() if local(c.tag) == "tableColumn"]
            out.append(item(sheet, "table", attribute(tree, "displayName") or attribute(tree, "name"), attribute(tree, "ref"), columns))
        elif kind == "pivotTable":
            place = next((attribute(x, "ref") for x in tree if local(x.tag) == "location"), None)
            source = None
            for k, cache, _ in p.relations(target).values():
                if k == "pivotCacheDefinition" and (definition := p.tree(cache)) is not None:
                    for s in definition.iter():
                        if local(s.tag) == "worksheetSource":
                            area, on = attribute(s, "ref"), attribute(s, "sheet")
                            source = attribute(s, "name") or (f"{on}!{area}" if on else area)
            out.append(item(sheet, "pivot", attribute(tree, "name"), place, detail=source))
        elif kind == "comments":
            out += [item(sheet, "comment", None, attribute(c, "ref"), detail=rich_text(c)) for c in tree.iter() if local(c.tag) == "comment"]
        elif kind == "drawing":
            out.append(item(sheet, "drawing", None, target))
            for k, chart, _ in p.relations(target).values():
                if k == "chart":
                    out += chart_items(p, sheet, chart)
    return out


def workbook_items(p: Xlsx) -> list[dict]:
    out, names = [], list(p.sheets)
    for d in p.workbook.iter():
        if local(d.tag) == "definedName":
            scope = attribute(d, "localSheetId")
            sheet = names[int(scope)] if scope is not None and scope.isdigit() and int(scope) < len(names) else None
            out.append(item(sheet, "name", attribute(d, "name"), d.text))
    for kind, target, external in p.relations(p.workbook_part).values():
        if kind != "externalLink" or external or (tree := p.tree(target)) is None:
            continue
        place = next((t for _, t, outside in p.relations(target).values() if outside), None)
        sheets = [attribute(x, "val") for x in tree.iter() if local(x.tag) == "sheetName"]
        defined = [attribute(x, "name") for x in tree.iter() if local(x.tag) == "definedName"]
        out.append(item(None, "link", posixpath.basename(target), place, sheets, ",".join(filter(None, defined)) or None))
    return out


def binary_items(p: Package) -> list[dict]:
    out = [item(sheet, "name", name, shown or None) for name, sheet, shown in p.defined_names()]
    for kind, target, external in p.relations(p.workbook_part).values():
        if kind == "externalLink" and not external:
            place = next((t for _, t, outside in p.relations(target).values() if outside), None)
            sheets, names = p.external(target)
            out.append(item(None, "link", posixpath.basename(target), place, sheets, ",".join(names) or None))
    return out


def items_of(content: bytes) -> list[dict]:
    p = open_package(content)
    out = []
    for sheet, part in p.sheets.items():
        for kind, found in p.tail(sheet).items():
            out += [item(sheet, kind, x.get("type"), x.get("ref"), detail=x.get("target") or x.get("formula")) for x in found]
        out += related_items(p, sheet, part)
    out += workbook_items(p) if isinstance(p, Xlsx) else binary_items(p)
    if p.has_macros:
        from ..sources.vba import project

        out += project(p.read("xl/vbaProject.bin"))
    return out


def metadata(files: DataFrame) -> DataFrame:
    """All items of all workbooks, by kind."""
    arrow = to_arrow_schema(ITEMS)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"workbook": name} | x for x in items_of(content)], schema=arrow)

    return files.mapInArrow(run, ITEMS)
