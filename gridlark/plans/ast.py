"""Expressions and query specifications."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

from ..functions.display import number_text
from .address import Range


class Expr:
    """Base of all expressions; `parts` are the operands."""

    @property
    def parts(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for p in self.parts:
            yield from p.walk()


@dataclass(frozen=True)
class Col(Expr):
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    """kind: empty, number, text, date or boolean."""

    kind: str
    value: object = None


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr

    @property
    def parts(self):
        return (self.operand,)


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    @property
    def parts(self):
        return (self.left, self.right)


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    @property
    def parts(self):
        return self.args


@dataclass(frozen=True)
class Agg(Expr):
    """kind: Sum, Count, Average, Min or Max."""

    kind: str
    arg: Expr | None = None
    where: Expr | None = None

    @property
    def parts(self):
        return tuple(x for x in (self.arg, self.where) if x is not None)


@dataclass(frozen=True)
class In(Expr):
    operand: Expr
    values: tuple[Lit, ...]
    negated: bool = False

    @property
    def parts(self):
        return (self.operand, *self.values)


@dataclass(frozen=True)
class IsEmpty(Expr):
    operand: Expr
    negated: bool = False

    @property
    def parts(self):
        return (self.operand,)


def aggregates(e: Expr) -> list[Agg]:
    return [x for x in e.walk() if isinstance(x, Agg)]


def key(e: Expr) -> object:
    """Equal for expressions that are the same up to the case of column names."""
    if isinstance(e, Col):
        return ("col", e.name.lower())
    if isinstance(e, Lit):
        return ("lit", e.kind, e.value)
    own = tuple(getattr(e, n) for n in ("op", "name", "kind", "negated") if hasattr(e, n))
    shape = (e.arg is not None, e.where is not None) if isinstance(e, Agg) else ()
    return (type(e).__name__, own, shape, tuple(map(key, e.parts)))


def substitute(e: Expr, names: Mapping[str, Expr]) -> Expr:
    """Columns that are aliases (lower-case keys) replaced, once."""
    go = lambda x: None if x is None else substitute(x, names)
    match e:
        case Col():
            return names.get(e.name.lower(), e)
        case Unary():
            return replace(e, operand=go(e.operand))
        case Binary():
            return replace(e, left=go(e.left), right=go(e.right))
        case Call():
            return replace(e, args=tuple(map(go, e.args)))
        case Agg():
            return replace(e, arg=go(e.arg), where=go(e.where))
        case In() | IsEmpty():
            return replace(e, operand=go(e.operand))
    return e


def text(e: Expr) -> str:
    """The label of an expression."""
    match e:
        case Col():
            return e.name
        case Lit(kind="text"):
            return "'" + str(e.value).replace("'", "''") + "'"
        case Lit(kind="number"):
            return number_text(e.value)
        case Lit(kind="date"):
            return f"DATE '{e.value:%Y-%m-%d}'" if isinstance(e.value, dt.date) else str(e.value)
        case Lit(kind="boolean"):
            return "TRUE" if e.value else "FALSE"
        case Lit():
            return "EMPTY"
        case Unary():
            return f"{e.op}({text(e.operand)})"
        case Binary():
            return f"({text(e.left)} {e.op} {text(e.right)})"
        case Call():
            return f"{e.name}({', '.join(map(text, e.args))})"
        case Agg():
            inner = "" if e.arg is None else text(e.arg)
            return f"{e.kind}({inner})" + ("" if e.where is None else f" FILTER (WHERE {text(e.where)})")
        case In():
            return f"{text(e.operand)} {'NOT ' * e.negated}IN ({', '.join(map(text, e.values))})"
        case IsEmpty():
            return f"{text(e.operand)} IS {'NOT ' * e.negated}EMPTY"
    raise TypeError(e)


@dataclass(frozen=True)
class Selection:
    expr: Expr
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or text(self.expr)


@dataclass(frozen=True)
class Header:
    """kind: auto, row (0: the first present row) or column."""

    kind: str = "row"
    row: int = 0
    column: str | None = None


@dataclass(frozen=True)
class QuerySpec:
    """A parsed query. simple: it has the restricted form, whose labels and keys follow their own rules."""

    sheet: str
    range: Range
    header: Header
    select_all: bool = False
    selections: tuple[Selection, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: Expr | None = None
    descending: bool = False
    limit: int | None = None
    simple: bool = False
    #: None: any number of groups.
    max_groups: int | None = 10_000
    stats: tuple = field(default=())

    @classmethod
    def parse(cls, query: str) -> QuerySpec:
        from .parser import parse

        return parse(query)

    def with_group_limit(self, n: int | None) -> QuerySpec:
        """None: no limit, for results that stay where they are."""
        if n is not None and n < 1:
            raise ValueError("A group limit is at least 1.")
        return replace(self, max_groups=n)

    @property
    def where_expression(self) -> str | None:
        return None if self.where is None else text(self.where)

    @property
    def having_expression(self) -> str | None:
        return None if self.having is None else text(self.having)

    @property
    def select_expressions(self) -> list[str]:
        return [text(s.expr) for s in self.selections]

    @property
    def group_by_expressions(self) -> list[str]:
        return list(map(text, self.group_by))
