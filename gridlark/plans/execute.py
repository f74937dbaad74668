"""Query specifications to DataFrames: header binding, filters, groups, order and limits."""

from __future__ import annotations

import asyncio
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError, TooManyGroups
from ..functions.compile import Compiler
from ..functions.kinds import DATE, NUMBER, Value
from ..sources.sheet import ROW, Sheet
from ..streaming.rows import plain
from .address import Range, letters
from .ast import Agg, Binary, Col, Expr, Lit, QuerySpec, aggregates, key, substitute, text

TOO_MANY = "TOO_MANY_GROUPS"
#: Marks of footnotes that end a header name.
FOOTNOTES = "*†‡§¹²³" + "".join(map(chr, range(0x2070, 0x207A)))


def clean(name: str) -> str:
    return name.strip().rstrip(FOOTNOTES).rstrip()


@dataclass
class Bound:
    """A sheet's area with its header: data rows, column numbers and names."""

    sheet: Sheet
    area: Range
    rows: DataFrame
    columns: list[int]
    names: list[str]
    top: int

    def position(self, name: str) -> int:
        """First exact match, else first one that differs in case."""
        for same in (lambda a: a == name, lambda a: a.lower() == name.lower()):
            for i, own in enumerate(self.names):
                if same(own):
                    return i
        raise QueryError(f"Column '{name}' was not found. Columns: {', '.join(self.names)}.")

    def value(self, name: str) -> Value:
        return self.sheet.value(self.columns[self.position(name)])


def bind(sheet: Sheet, area: Range, header_row: int, like: Bound | None = None) -> Bound | None:
    """None if the area is empty and no header row was named. like: of the same sheet, whose header is known."""
    if like is not None:
        rows = sheet.rows(replace(area, top=min(like.top, area.bottom + 1)))
        return replace(like, sheet=sheet, rows=rows if like.top <= area.bottom else empty_of(rows))
    if header_row > area.bottom:
        raise ValueError("The header row lies below the range.")
    found = sheet.header_cells(area, header_row)
    if found is None:
        if header_row:
            raise QueryError(f"Header row {header_row} has no cells.")
        return None
    row, cells = found
    right = min(area.right, max(sheet.width, area.left)) if area.right - area.left > 4 * max(sheet.width, 16) else area.right
    columns = list(range(area.left, right + 1))
    names = [clean(cells[i]) if i < len(cells) and cells[i] and clean(cells[i]) else letters(c) for i, c in enumerate(columns)]
    top = area.top if row < area.top else row + 1
    rows = sheet.rows(replace(area, top=min(top, area.bottom + 1)))
    if top > area.bottom:
        rows = empty_of(rows)
    if sheet.names is not None:  # a table has its own columns only
        columns, names = [c for c in columns if c <= sheet.width], [n for n, c in zip(names, columns) if c <= sheet.width]
    return Bound(sheet, area, rows, columns, names, top)


def narrowed(bound: Bound, spec: QuerySpec) -> Bound:
    """bound without the columns that the query doesn't name, where the source can leave them out."""
    if bound.sheet.narrow is None or spec.select_all:
        return bound
    aliases = {s.alias.lower() for s in spec.selections if s.alias}
    known = {n.lower() for n in bound.names}
    used = {c.name for e in (spec.where, spec.having, spec.order_by, *spec.group_by, *(s.expr for s in spec.selections)) for c in columns_in(e) if c.name.lower() in known or c.name.lower() not in aliases}
    sheet = bound.sheet.narrowed([bound.columns[bound.position(n)] for n in used])
    return bind(sheet, bound.area, 0, bound)


def columns_in(e) -> list[Col]:
    if isinstance(e, Col):
        return [e]
    if isinstance(e, (tuple, list)):
        return [c for x in e for c in columns_in(x)]
    return [c for f in fields(e) for c in columns_in(getattr(e, f.name))] if is_dataclass(e) else []


@dataclass
class Result:
    """columns: labels; df: one column per label, c1..cN, and for row results the sheet row under ROW."""

    columns: list[str]
    df: DataFrame | None
    spec: QuerySpec
    bound: Bound | None
    kinds: list[str]
    source_rows: bool = False
    #: The same rows in any order, of a plan that stops reading once it has enough; for rows().
    early: DataFrame | None = None

    def named(self) -> DataFrame:
        """df with the labels as names."""
        return self.df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(self.columns, 1)))

    def rows(self) -> list[tuple]:
        """Collected values in order: None, float, str, datetime, bool, or a cell's dict."""
        if self.df is None:
            return []
        try:
            names = [f"c{i}" for i in range(1, len(self.columns) + 1)]
            if self.early is not None:
                found = [r[1:] for r in sorted(self.early.select(ROW, *names).collect(), key=lambda r: r[0])]  # at most LIMIT rows
            else:
                found = self.df.select(*names).collect()
        except Exception as e:
            if TOO_MANY in str(e):
                raise TooManyGroups(f"The query has more than {self.spec.max_groups} groups.") from None
            raise
        return [tuple(plain(v) for v in r) for r in found]

    async def rows_async(self) -> list[tuple]:
        return await asyncio.to_thread(self.rows)

    def source_row_indices(self) -> list[int]:
        return [r[0] for r in self.df.select(ROW).collect()] if self.source_rows else []

    def stats(self) -> DataFrame:
        """One row: rows_scanned and rows_matched."""
        if self.bound is None:
            raise QueryError("No rows were bound.")
        q, rows = self.spec, self.bound.rows
        grouped = bool(q.group_by) or any(aggregates(s.expr) for s in q.selections)
        matched = rows if q.where is None else rows.where(Compiler(self.bound.value).condition(q.where))
        if q.limit == 0:
            rows = matched = rows.where(F.lit(False))
        elif q.limit is not None and not grouped and q.order_by is None:
            matched = matched.select(ROW).orderBy(ROW).limit(q.limit)
            last = matched.agg(F.max(ROW).alias("last"), F.count(F.lit(1)).alias("n"))
            rows = rows.crossJoin(F.broadcast(last)).where((F.col("n") < q.limit) | (F.col(ROW) <= F.col("last")))  # one row
        scanned = rows.agg(F.count(F.lit(1)).alias("rows_scanned"))
        return scanned.crossJoin(matched.agg(F.count(F.lit(1)).alias("rows_matched")))

    def diagnostics(self) -> DataFrame:
        """column, skipped_count and the first five sample_row_indices of values that an aggregate rejected."""
        return diagnose(self.bound, self.spec)


def aggregate(agg: Agg, at: int, compiler: Compiler) -> tuple[list[Column], Value]:
    """Spark aggregates named _a<at>*, and the value that follows from them."""
    a, b = f"_a{at}", f"_b{at}"
    only = None if agg.where is None else compiler.condition(agg.where)
    where = lambda x: x if only is None else F.when(only, x)
    if agg.kind == "Count":
        return [F.count(where(F.lit(1))).cast("double").alias(a)], Value("number", F.col(a), exact=True)
    arg = compiler.value(agg.arg)
    x = where(arg.finite)
    if agg.kind == "Sum":
        return [F.sum(x).alias(a)], Value("number", F.when(F.abs(F.col(a)) < float("inf"), F.col(a)), exact=True)
    if agg.kind == "Average":
        total = F.when(F.abs(F.col(a)) < float("inf"), F.col(a))
        return [F.sum(x).alias(a), F.count(x).alias(b)], Value("number", F.try_divide(total, F.col(b).cast("double")), exact=True)
    best = F.min if agg.kind == "Min" else F.max
    if arg.kind == "date":
        return [best(where(arg.col)).alias(a)], Value("date", F.col(a))
    if arg.kind != "cell":
        return [best(x).alias(a)], Value("number", F.col(a), exact=True)
    # The first accepted value's kind decides which kind the group keeps.
    kind = where(accepted_kind(arg))
    first = F.min_by(kind, F.when(kind.isNotNull(), F.col(ROW)))
    columns = [first.alias(f"_k{at}"), best(x).alias(a), best(where(arg.part("date"))).alias(b)]
    number, date = Value("number", F.col(a), exact=True).cell, Value("date", F.col(b)).cell
    return columns, Value("cell", F.when(F.col(f"_k{at}") == DATE, date).otherwise(number))


def accepted_kind(arg: Value) -> Column:
    return F.when(arg.finite.isNotNull(), F.lit(NUMBER)).when(arg.part("date").isNotNull(), F.lit(DATE))


def empty_of(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def execute(sheet: Sheet, spec: QuerySpec, header_row: int, ordered: bool = True) -> Result:
    """ordered False leaves results without ORDER BY and LIMIT in any order, which saves a sort."""
    if spec.stats and pruned(spec):
        return Result([], None, spec, None, [])
    bound = bind(sheet, spec.range, header_row)
    if bound is not None:
        bound = narrowed(bound, spec)
    globally = not spec.group_by and any(aggregates(s.expr) for s in spec.selections)
    if bound is None:
        if spec.simple and globally and spec.limit != 0:
            one = sheet.df.sparkSession.range(1)
            columns = [F.lit(0.0 if s.expr.kind == "Count" else None).cast("double").alias(f"c{i}") for i, s in enumerate(spec.selections, 1)]
            return Result([s.label for s in spec.selections], one.select(*columns), spec, None, ["number"] * len(columns))
        return Result([], None, spec, None, [])
    compiler = Compiler(bound.value)
    rows = bound.rows if spec.where is None else bound.rows.where(compiler.condition(spec.where))
    aliases = {s.alias.lower(): s.expr for s in spec.selections if s.alias}
    if globally or spec.group_by or spec.having is not None and aggregates(spec.having):
        return grouped_result(bound, rows, compiler, spec, aliases, ordered)
    return row_result(bound, rows, compiler, spec, aliases, ordered)


def row_result(bound: Bound, rows: DataFrame, compiler: Compiler, spec: QuerySpec, aliases: dict[str, Expr], ordered: bool) -> Result:
    if spec.select_all:
        labels, values = bound.names, [bound.sheet.value(c) for c in bound.columns]
    else:
        values = [compiler.value(s.expr) for s in spec.selections]
        labels = [bound.names[bound.position(s.expr.name)] if spec.simple else s.label for s in spec.selections]
    matched = rows
    if spec.order_by is not None:
        by = compiler.value(substitute(spec.order_by, aliases)).order_keys(spec.descending)
        rows = rows.orderBy(*by, F.col(ROW).asc())
    elif ordered or spec.limit is not None:
        rows = rows.orderBy(ROW)
    shown = [F.col(ROW), *(v.col.alias(f"c{i}") for i, v in enumerate(values, 1))]
    out, early = rows.select(*shown), None
    if spec.limit is not None:
        out = empty_of(out) if spec.limit == 0 else out.limit(spec.limit)
        if spec.limit and spec.order_by is None and bound.sheet.in_order:
            early = matched.select(*shown).limit(spec.limit)  # collected, it reads partitions in order
    return Result(list(labels), out, spec, bound, [v.kind for v in values], source_rows=True, early=early)


def grouped_result(bound: Bound, rows: DataFrame, compiler: Compiler, spec: QuerySpec, aliases: dict[str, Expr], ordered: bool) -> Result:
    having = None if spec.having is None else substitute(spec.having, aliases)
    order = None if spec.order_by is None else substitute(spec.order_by, aliases)
    wanted: dict[object, Agg] = {}
    for e in (*(s.expr for s in spec.selections), having, order):
        for a in aggregates(e) if e is not None else ():
            wanted.setdefault(key(a), a)
    columns, given = [], {}
    for i, (k, a) in enumerate(wanted.items()):
        found, value = aggregate(a, i, compiler)
        columns += found
        given[k] = value
    groups = [compiler.value(g) for g in spec.group_by]
    sort = bool(groups) and (ordered or spec.limit is not None or order is not None)
    if sort:
        columns.append(F.min(ROW).alias("_first"))
    if groups:
        keys = [v.col.alias(f"_g{i}") for i, v in enumerate(groups)]
        made = rows.groupBy(*keys).agg(*columns) if columns else rows.select(*keys).distinct()
        made = checked(made, spec.max_groups)
        given |= {key(g): Value(v.kind, F.col(f"_g{i}"), v.exact) for i, (g, v) in enumerate(zip(spec.group_by, groups))}
    else:
        made = rows.agg(*columns)
    after = Compiler(bound.value, given)
    if having is not None:
        made = made.where(after.condition(having))
    if order is not None:
        made = made.orderBy(*after.value(order).order_keys(spec.descending), F.col("_first").asc())
    elif sort:
        made = made.orderBy("_first")
    shown: list[tuple[str, Expr]] = [(s.label, s.expr) for s in spec.selections]
    if groups and all(aggregates(s.expr) for s in spec.selections):
        named = [(bound.names[bound.position(g.name)] if spec.simple and isinstance(g, Col) else text(g), g) for g in spec.group_by]
        shown = named + shown
    values = [after.value(e) for _, e in shown]
    out = made.select(*(v.col.alias(f"c{i}") for i, v in enumerate(values, 1)))
    if spec.limit == 0:
        out = empty_of(out)
    elif spec.limit is not None and groups:
        out = out.limit(spec.limit)
    return Result([n for n, _ in shown], out, spec, bound, [v.kind for v in values])


def checked(made: DataFrame, most: int | None) -> DataFrame:
    """made, which fails at run time if it has more than `most` rows (None: any number); they stay where they are.

    The count reads all columns, so that it shares made's shuffle; the verdict must not move below it.
    """
    if most is None:
        return made
    count = made.agg(F.count(F.when(F.xxhash64(*(F.col(c) for c in made.columns)) != 0, 1)).alias("n")).scalar()
    return made.where(F.when(count > most, F.raise_error(F.lit(TOO_MANY)).cast("boolean")).otherwise(F.monotonically_increasing_id() >= 0))


def pruned(spec: QuerySpec) -> bool:
    """Whether profiled minima and maxima show that no row can match the numeric filters."""
    bounds = {p["inferred_header"].lower(): (p["min_numeric"], p["max_numeric"]) for p in spec.stats if p.get("inferred_header")}

    def impossible(e: Expr | None) -> bool:
        if isinstance(e, Binary) and e.op == "AND":
            return impossible(e.left) or impossible(e.right)
        if not (isinstance(e, Binary) and isinstance(e.left, Col) and isinstance(e.right, Lit) and e.right.kind == "number"):
            return False
        low, high = bounds.get(e.left.name.lower(), (None, None))
        if low is None or high is None:
            return False
        x = e.right.value
        return {"=": x < low or x > high, "<": low >= x, "<=": low > x, ">": high <= x, ">=": high < x}.get(e.op, False)

    return impossible(spec.where)


def diagnose(bound: Bound | None, spec: QuerySpec) -> DataFrame:
    if bound is None:
        raise QueryError("No rows were bound.")
    compiler = Compiler(bound.value)
    rows = bound.rows if spec.where is None else bound.rows.where(compiler.condition(spec.where))
    inside = [e for e in (*(s.expr for s in spec.selections), spec.having, spec.order_by) if e is not None]
    labels: dict[str, Column] = {}
    firsts: list[tuple[str, Column]] = []
    names: dict[str, str] = {}
    for a in {key(a): a for e in inside for a in aggregates(e) if a.arg is not None}.values():
        arg = compiler.value(a.arg)
        only = F.lit(True) if a.where is None else F.coalesce(compiler.condition(a.where), F.lit(False))
        if a.kind in ("Sum", "Average"):
            good = arg.finite.isNotNull()
        elif arg.kind == "cell":
            kind = F.when(only, accepted_kind(arg))
            name = f"_latch{len(firsts)}"
            firsts.append((name, F.min_by(kind, F.when(kind.isNotNull(), F.col(ROW)))))
            good = F.coalesce(accepted_kind(arg) == F.col(name), F.lit(False))
        else:
            good = (arg.part("date") if arg.kind == "date" else arg.finite).isNotNull()
        bad = only & ~arg.missing & ~good
        same = text(a.arg).lower()
        names.setdefault(same, text(a.arg))
        labels[same] = bad if same not in labels else labels[same] | bad
    if firsts:
        groups = [compiler.value(g).col for g in spec.group_by]
        rows = rows.select("*", *(g.alias(f"_g{i}") for i, g in enumerate(groups)))
        kinds = rows.groupBy(*(F.col(f"_g{i}").alias(f"_h{i}") for i in range(len(groups)))).agg(*(c.alias(n) for n, c in firsts))
        same_group = [F.col(f"_g{i}").eqNullSafe(F.col(f"_h{i}")) for i in range(len(groups))]
        rows = rows.join(kinds, same_group, "left") if groups else rows.crossJoin(F.broadcast(kinds))  # one row
    nothing = rows.sparkSession.createDataFrame([], "column string, skipped_count long, sample_row_indices array<long>")
    if not labels:
        return nothing
    # One scan counts for all columns, one finds the first rows of all: the window keeps five a column and task.
    entries = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(names[same]).alias("column"), F.count(F.when(bad, 1)).alias("skipped_count")) for i, (same, bad) in enumerate(labels.items())))
    counted = rows.agg(entries.alias("entries")).select(F.inline("entries")).where("skipped_count > 0")
    each = rows.select(ROW, F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(i)) for i, bad in enumerate(labels.values()))))).alias("at"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("at").orderBy(ROW))).where("n <= 5")
    first = first.groupBy("at").agg(F.sort_array(F.collect_list(ROW)).alias("sample_row_indices"))
    return counted.join(first, "at").select("column", "skipped_count", "sample_row_indices").union(nothing)


def distinct_values(sheet: Sheet, spec: QuerySpec, header_row: int, column: str, top: int = 100) -> DataFrame:
    """value and count of the most frequent display strings, ties by value."""
    bound = bind(sheet, spec.range, header_row)
    if bound is None:
        return sheet.df.sparkSession.createDataFrame([], "value string, count long")
    compiler = Compiler(bound.value)
    rows = bound.rows if spec.where is None else bound.rows.where(compiler.condition(spec.where))
    shown = rows.select(compiler.value(Col(column)).display.alias("value")).where("value is not null")
    counted = checked(shown.groupBy("value").agg(F.count(F.lit(1)).alias("count")), spec.max_groups)
    return counted.orderBy(F.desc("count"), F.asc("value")).limit(top)

