"""Expressions to Spark columns. Every node is total under ANSI mode: bad input gives null, never an error."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import Binary, Call, Col, Expr, In, IsEmpty, Lit, Unary, key
from .kinds import TYPES, Value, finite, null

Resolve = Callable[[str], Value]
_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: Numbers of at least this size have no fraction.
_WHOLE = 1e16


class Compiler:
    """Compiles expressions; given maps keys of expressions that are columns already (group keys, aggregates)."""

    def __init__(self, resolve: Resolve, given: dict | None = None):
        self.resolve, self.given = resolve, given or {}

    def value(self, e: Expr) -> Value:
        if (found := self.given.get(key(e))) is not None:
            return found
        match e:
            case Col():
                return self.resolve(e.name)
            case Lit():
                return literal(e)
            case Unary(op="NOT"):
                return Value("boolean", ~self.truth(e.operand))
            case Unary():
                x = self.value(e.operand)
                number = x.part("number")
                return Value("number", -number if e.op == "-" else number, x.exact)
            case Binary(op="AND"):
                return Value("boolean", self.truth(e.left) & self.truth(e.right))
            case Binary(op="OR"):
                return Value("boolean", self.truth(e.left) | self.truth(e.right))
            case Binary() if e.op in _COMPARE:
                return Value("boolean", compare(e.op, self.value(e.left), self.value(e.right)))
            case Binary():
                return arithmetic(e.op, self.value(e.left), self.value(e.right))
            case In():
                found = membership(self.value(e.operand), e.values)
                return Value("boolean", ~found if e.negated else found)
            case IsEmpty():
                missing = self.value(e.operand).missing
                return Value("boolean", ~missing if e.negated else missing)
            case Call():
                return function(e.name, [self.value(a) for a in e.args], e.args)
        raise TypeError(e)

    def truth(self, e: Expr) -> Column:
        """As a three-valued condition; what isn't boolean is unknown."""
        return self.value(e).part("boolean")

    def condition(self, e: Expr) -> Column:
        """The same where only TRUE counts, as in a filter: plain comparisons that a scan can take over."""
        match e:
            case Binary(op="AND"):
                return self.condition(e.left) & self.condition(e.right)
            case Binary(op="OR"):
                return self.condition(e.left) | self.condition(e.right)
            case Binary() if e.op in _COMPARE and key(e) not in self.given:
                a, b = self.value(e.left), self.value(e.right)
                if a.kind == b.kind == "number":
                    out = _COMPARE[e.op](a.col, b.col)
                    for x, side in ((a, e.left), (b, e.right)):
                        if not x.exact and not isinstance(side, Lit):
                            out = out & (x.col > float("-inf")) & (x.col < float("inf"))
                    return out
        return self.truth(e)


def literal(e: Lit) -> Value:
    if e.kind == "empty":
        return Value("empty", F.lit(None))
    return Value(e.kind, F.lit(e.value).cast(TYPES[e.kind]), exact=e.kind == "number")


def compare(op: str, a: Value, b: Value) -> Column:
    """Unknown unless both have the same kind and are no errors; numbers must be finite; booleans are only equal or not."""
    tests = []
    for kind in ("number", "text", "date", "boolean"):
        if a.may_be(kind) and b.may_be(kind) and (kind != "boolean" or op in ("=", "!=")):
            x, y = (a.finite, b.finite) if kind == "number" else (a.part(kind), b.part(kind))
            tests.append(_COMPARE[op](x, y))
    return (F.coalesce(*tests) if len(tests) > 1 else tests[0]) if tests else null("boolean")


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if not (a.may_be("number") and b.may_be("number")):
        return Value("number", null("number"))
    x, y = a.part("number"), b.part("number")
    if op == "/":
        out = F.try_divide(x, y)
    elif op == "%":
        out = F.when(y != 0, F.try_mod(x, y))
    else:
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
    return Value("number", finite(out), exact=True)


def membership(x: Value, literals: Sequence[Lit]) -> Column:
    """True if found; else unknown if any literal is empty or of another kind; unknown for empty, error and non-finite operands."""
    out = []
    for kind in ("number", "text", "date", "boolean"):
        if not x.may_be(kind):
            continue
        own = [v.value for v in literals if v.kind == kind]
        mixed = len(own) < len(literals)
        operand = x.finite if kind == "number" else x.part(kind)
        found = operand.isin([F.lit(v).cast(TYPES[kind]) for v in own]) if own else F.when(operand.isNotNull(), F.lit(False))
        out.append(F.when(found, F.lit(True)) if mixed else found)
    return (F.coalesce(*out) if len(out) > 1 else out[0]) if out else null("boolean")


def rounded(x: Column, digits: Column) -> Column:
    """Half away from zero after scaling by 10^digits; numbers too large to have a fraction stay."""
    scale = F.pow(F.lit(10.0), digits)
    y = x * scale
    rest = F.try_mod(y, F.lit(1.0))
    whole = y - rest
    out = (whole + F.when(F.abs(rest) >= 0.5, F.signum(rest)).otherwise(0.0)) / scale
    return F.when(F.abs(x) >= _WHOLE, x).otherwise(finite(out))


def function(name: str, args: list[Value], written: Sequence[Expr]) -> Value:
    first = args[0]
    if name == "ABS":
        return Value("number", F.abs(first.part("number")), first.exact)
    if name == "ROUND":
        if len(args) == 1:
            return Value("number", rounded(first.part("number"), F.lit(0.0)))
        digits = args[1].part("number")
        good = (digits >= 0) & (digits <= 15) & (digits == F.floor(digits))
        return Value("number", F.when(good, rounded(first.part("number"), digits)))
    if name in ("YEAR", "MONTH", "DAY"):
        part = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}[name](first.part("date"))
        return Value("number", part.cast("double"), exact=True)
    if name == "DATE_TRUNC":
        unit = written[0].value  # a literal, as the parser saw to
        return Value("date", F.date_trunc(unit, args[1].part("date")).cast("timestamp_ntz"))
    if name == "COALESCE":
        known = [a for a in args if a.kind != "empty"]
        if not known:
            return Value("empty", F.lit(None))
        if len({a.kind for a in known}) == 1 and known[0].kind != "cell":
            return Value(known[0].kind, F.coalesce(*(a.col for a in known)), all(a.exact for a in known))
        return Value("cell", F.coalesce(*(F.when(~a.missing, a.cell) for a in known), Value("empty", F.lit(None)).cell))
    raise TypeError(name)
