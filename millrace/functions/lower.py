"""From syntax to Spark columns, with types: all in Catalyst, none in Python.

The lowered expression gives the same result with ANSI mode on and off: integers wrap, divisions by zero give NULL
(integers) or what IEEE says (floats), and nothing is coerced between text and numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExpressionError, SchemaError
from ..types import FLOATS, INTS, NUMERIC, SPARK, kind_of, parse_date, parse_timestamp
from .syntax import Binary, Call, Col, Is, Lit, Unary, parse

#: 2**63 and 2**64 as decimals, for wrapping.
HALF, FULL = "9223372036854775808BD", "18446744073709551616BD"
NOTHING = ("null", "other")


class Typed:
    """A column and its canonical type; ``finite``: whether it is a number written out, so neither NULL nor NaN."""

    def __init__(self, column: Column, kind: str, finite: bool = False) -> None:
        self.column, self.kind, self.finite = column, kind, finite


def null(kind: str = "null") -> Typed:
    return Typed(F.lit(None).cast(SPARK[kind]) if kind in SPARK else F.lit(None), kind)


def either_null(a: Typed, b: Typed) -> Column:
    return a.column.isNull() | b.column.isNull()


def constant(a: Typed, b: Typed, value: bool) -> Typed:
    """``value``, or NULL where a side is."""
    return Typed(F.when(either_null(a, b), F.lit(None).cast("boolean")).otherwise(F.lit(value)), "bool")


def _nan(x: Typed) -> Column:
    return F.isnan(x.column) if x.kind in FLOATS else F.lit(False)


def compare(op: str, a: Typed, b: Typed) -> Typed:
    if "null" in (a.kind, b.kind):
        return null("bool")
    kinds = {a.kind, b.kind}
    unlike = constant(a, b, op == "!=")
    if a.kind in NUMERIC and b.kind in NUMERIC:
        left, right = (a.column, b.column) if kinds <= set(INTS) else (a.column.cast("double"), b.column.cast("double"))
        plain = _compare(op, left, right)
        if kinds <= set(INTS):
            return Typed(plain, "bool")
        if a.finite != b.finite:
            # NaN is above all numbers to Spark; only a comparison that this makes true needs a guard. What is left is
            # a plain comparison, which a scan can be given.
            x, above = (a, op in (">", ">=")) if b.finite else (b, op in ("<", "<="))
            return Typed(plain & ~F.isnan(x.column) if above and x.kind in FLOATS else plain, "bool")
        return Typed(F.when(either_null(a, b), F.lit(None).cast("boolean")).when(_nan(a) | _nan(b), F.lit(op == "!=")).otherwise(plain), "bool")
    if a.kind == b.kind and a.kind in ("utf8", "bool", "date", "timestamp"):
        return Typed(_compare(op, a.column, b.column), "bool")
    for text, other in ((a, b), (b, a)):
        if text.kind == "utf8" and other.kind in ("date", "timestamp"):
            read = (parse_date if other.kind == "date" else parse_timestamp)(text.column)
            left, right = (read, b.column) if text is a else (a.column, read)
            return Typed(F.when(either_null(a, b), F.lit(None).cast("boolean")).when(read.isNull(), F.lit(op == "!=")).otherwise(_compare(op, left, right)), "bool")
    return unlike


def _compare(op: str, a: Column, b: Column) -> Column:
    match op:
        case "==":
            return a == b
        case "!=":
            return a != b
        case "<":
            return a < b
        case "<=":
            return a <= b
        case ">":
            return a > b
    return a >= b


def _wrapped(exact: Column) -> Column:
    """A decimal without fraction, modulo 2**64, as a signed long."""
    return (F.pmod(exact + F.expr(HALF), F.expr(FULL)) - F.expr(HALF)).cast("bigint")


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if op == "+" and a.kind == b.kind == "utf8":
        return Typed(F.concat(a.column, b.column), "utf8")
    if a.kind not in NUMERIC or b.kind not in NUMERIC:
        both = {a.kind, b.kind} - {"null"}
        return null("utf8" if op == "+" and both == {"utf8"} else "float64" if both & set(FLOATS) else "int64")
    if a.kind in INTS and b.kind in INTS:
        return Typed(_integers(op, a.column.cast("bigint"), b.column.cast("bigint")), "int64")
    return Typed(_floats(op, a.column.cast("double"), b.column.cast("double")), "float64")


def _integers(op: str, x: Column, y: Column) -> Column:
    exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
    if op in exact:
        wide_x, wide_y = x.cast("decimal(20,0)"), y.cast("decimal(20,0)")
        wide = {"+": wide_x + wide_y, "-": wide_x - wide_y, "*": (wide_x * wide_y).cast("decimal(38,0)")}[op]
        return F.coalesce(exact[op](x, y), F.when(x.isNotNull() & y.isNotNull(), _wrapped(wide)))
    if op == "/":
        # -1 apart, since the least long has no opposite
        return F.when(y == -1, F.coalesce(F.try_subtract(F.lit(0).cast("bigint"), x), x)).when(y != 0, _quotient(x, y))
    return F.when(y == -1, F.when(x.isNotNull(), F.lit(0).cast("bigint"))).when(y != 0, _remainder(x, y))


def _remainder(x: Column, y: Column) -> Column:
    return x % F.when(y != 0, y)


def _quotient(x: Column, y: Column) -> Column:
    return F.call_function("div", x, F.when(y != 0, y))


def _floats(op: str, x: Column, y: Column) -> Column:
    match op:
        case "+":
            return x + y
        case "-":
            return x - y
        case "*":
            return x * y
    known = x.isNotNull() & y.isNotNull()
    nan = F.lit(float("nan"))
    if op == "%":
        return F.when(known & (y == 0), nan).otherwise(x % F.when(y != 0, y))
    minus = (x < 0) != (y.cast("string") == "-0.0")
    over = F.when(F.isnan(x) | (x == 0), nan).when(minus, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(known & (y == 0), over).otherwise(x / F.when(y != 0, y))


def negative(x: Typed) -> Typed:
    if x.kind in INTS:
        zero = F.lit(0).cast(SPARK[x.kind])
        return Typed(F.coalesce(F.try_subtract(zero, x.column), x.column).cast(SPARK[x.kind]), x.kind, x.finite)
    return Typed(-x.column, x.kind, x.finite) if x.kind in FLOATS else null("int64")


def truth(x: Typed) -> Column:
    """A boolean operand of and, or: NULL stays, anything else counts as false."""
    if x.kind == "bool":
        return x.column
    if x.kind == "null":
        return F.lit(None).cast("boolean")
    return F.when(x.column.isNotNull(), F.lit(False))


def unify(values: list[Typed], what: str) -> tuple[list[Column], str]:
    """Columns of one type: equal types stay, integers widen to int64, with a float to float64; NULL fits any."""
    kinds = {v.kind for v in values} - {"null"}
    if not kinds:
        return [v.column for v in values], "null"
    if len(kinds) == 1:
        kind = kinds.pop()
    elif kinds <= set(INTS):
        kind = "int64"
    elif kinds <= set(NUMERIC):
        kind = "float64"
    else:
        raise SchemaError(f"{what}: types {', '.join(sorted(kinds))} don't go together")
    return [v.column if v.kind == kind == "other" else v.column.cast(SPARK[kind]) if v.kind != kind else v.column for v in values], kind


def _extreme(op: str, args: list[Typed]) -> Typed:
    """Left fold: NULL if the first is NULL; later NULLs and what can't be compared with the first are passed over."""
    first = args[0]
    if first.kind in NOTHING:
        return null()
    like = [a for a in args[1:] if a.kind == first.kind or (a.kind in NUMERIC and first.kind in NUMERIC)]
    columns, kind = unify([first, *like], op)
    best = Typed(columns[0], kind)
    for c in columns[1:]:
        wins = compare("<" if op == "min" else ">", Typed(c, kind), best).column
        best = Typed(F.when(first.column.isNotNull() & F.coalesce(wins, F.lit(False)), c).otherwise(best.column), kind)
    return best


def _length(x: Typed) -> Typed:
    c = x.column
    match x.kind:
        case "utf8":
            return Typed(F.length(c), "int32")
        case "int32":
            return Typed(c.cast("int"), "int32")
        case "int64":
            low = F.pmod(c, F.lit(1 << 32))
            return Typed((low - F.when(low >= 1 << 31, F.lit(1 << 32)).otherwise(F.lit(0))).cast("int"), "int32")
        case "float32" | "float64":
            held = F.least(F.greatest(c.cast("double"), F.lit(float(-(1 << 31)))), F.lit(float((1 << 31) - 1)))
            return Typed(F.when(F.isnan(c), F.lit(0)).otherwise(F.when(c.isNotNull(), F.when(~F.isnan(c), held)).cast("int")), "int32")
    return null("int32")


def call(name: str, args: list[Typed]) -> Typed:
    one = args[0] if args else null()
    match name:
        case "coalesce":
            if not args:
                return null()
            columns, kind = unify(args, "coalesce")
            return Typed(F.coalesce(*columns), kind)
        case "abs":
            if one.kind in FLOATS:
                return Typed(F.abs(one.column), one.kind)
            return Typed(F.when(one.column < 0, negative(one).column).otherwise(one.column), one.kind) if one.kind in INTS else null("int64")
        case "sqrt":
            return Typed(F.sqrt(one.column.cast("double")), "float64") if one.kind in NUMERIC else null("float64")
        case "min" | "max":
            return _extreme(name, args) if args else null()
        case "upper" | "lower":
            return Typed(getattr(F, name)(one.column), "utf8") if one.kind == "utf8" else null("utf8")
        case "length":
            return _length(one)
        case "trim":
            return Typed(F.regexp_replace(one.column, r"(?U)^\s+|\s+$", ""), "utf8") if one.kind == "utf8" else null("utf8")
        case "if":
            if len(args) != 3:
                return null()
            (then, other), kind = unify(args[1:], "if")
            return Typed(F.when(F.coalesce(truth(one), F.lit(False)), then).otherwise(other), kind)
    raise ExpressionError(f"expression: unknown function {name!r}")


def literal(value: object) -> Typed:
    match value:
        case None:
            return null()
        case bool():
            return Typed(F.lit(value), "bool")
        case int():
            return Typed(F.lit(value).cast("bigint"), "int64", True)
        case float():
            return Typed(F.lit(value), "float64", True)
    return Typed(F.lit(value), "utf8")


def lower(x: object, schema: T.StructType, strict: bool = False) -> Typed:
    """``x`` over columns of ``schema``. A column that isn't there is NULL, or an error if ``strict``."""
    match x:
        case Lit(value):
            return literal(value)
        case Col(name):
            if name not in schema.names:
                if strict:
                    raise SchemaError(f"expression: column {name!r} not found; available: {', '.join(schema.names)}")
                return null()
            kind = kind_of(schema[name].dataType)
            column = F.col("`" + name.replace("`", "``") + "`")
            if isinstance(schema[name].dataType, T.DecimalType):
                column = column.cast("double")
            elif isinstance(schema[name].dataType, T.TimestampNTZType):
                column = column.cast("timestamp")
            return Typed(column, kind)
        case Unary("-", a):
            return negative(lower(a, schema, strict))
        case Unary(_, a):
            inner = lower(a, schema, strict)
            return Typed(~inner.column, "bool") if inner.kind == "bool" else null("bool")
        case Binary("and" | "or" as op, a, b):
            left, right = truth(lower(a, schema, strict)), truth(lower(b, schema, strict))
            return Typed(left & right if op == "and" else left | right, "bool")
        case Binary("+" | "-" | "*" | "/" | "%" as op, a, b):
            return arithmetic(op, lower(a, schema, strict), lower(b, schema, strict))
        case Binary(op, a, b):
            return compare(op, lower(a, schema, strict), lower(b, schema, strict))
        case Is(a, None, negated):
            inner = lower(a, schema, strict).column
            return Typed(inner.isNotNull() if negated else inner.isNull(), "bool")
        case Is(a, value, negated):
            same = F.coalesce(truth(lower(a, schema, strict)).eqNullSafe(F.lit(value)), F.lit(False))
            return Typed(~same if negated else same, "bool")
        case Call(name, args):
            return call(name, [lower(a, schema, strict) for a in args])
    raise ExpressionError(f"expression: can't lower {x!r}")


def column(text: str, schema: T.StructType, strict: bool = False) -> Column:
    """The Spark column of expression text in the pipeline dialect."""
    return lower(parse(text), schema, strict).column


def predicate(x: Typed) -> Column:
    """Keeps a row only if ``x`` is exactly true."""
    return x.column if x.kind == "bool" else F.lit(False)


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)
