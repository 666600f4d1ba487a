"""The expression language over plain Python rows: an oracle for the lowering, written from its rules alone."""

import math
from datetime import date, datetime

from millrace.functions.syntax import Binary, Call, Col, Is, Lit, Unary


def wrap(n):
    return (n + 2**63) % 2**64 - 2**63


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def compare(op, a, b):
    if a is None or b is None:
        return None
    if isinstance(a, str) and isinstance(b, date):
        a = read(a, b)
    elif isinstance(b, str) and isinstance(a, date):
        b = read(b, a)
    like = (number(a) and number(b)) or (type(a) is type(b) and a is not None)
    if not like or a != a or b != b:
        return op == "!="
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def read(text, other):
    try:
        if isinstance(other, datetime):
            return datetime.fromisoformat(text)
        return date.fromisoformat(text) if len(text) == 10 and text[4] == "-" else None
    except ValueError:
        return None


def arithmetic(op, a, b):
    if a is None or b is None:
        return None
    if op == "+" and isinstance(a, str) and isinstance(b, str):
        return a + b
    if not number(a) or not number(b):
        return None
    if isinstance(a, int) and isinstance(b, int):
        if op in "+-*":
            return wrap({"+": a + b, "-": a - b, "*": a * b}[op])
        if b == 0:
            return None
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return wrap(q) if op == "/" else a - q * b
    a, b = float(a), float(b)
    if op == "/":
        if b == 0:
            return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) else math.fmod(a, b)
    try:
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    except OverflowError:
        return math.inf


def truth(x):
    return None if x is None else x is True


def run(x, row):
    match x:
        case Lit(v):
            return v
        case Col(n):
            return row.get(n)
        case Unary("-", a):
            v = run(a, row)
            return None if not number(v) else wrap(-v) if isinstance(v, int) else -v
        case Unary(_, a):
            v = run(a, row)
            return not v if isinstance(v, bool) else None
        case Binary("and", a, b):
            p, q = truth(run(a, row)), truth(run(b, row))
            return False if p is False or q is False else None if p is None or q is None else True
        case Binary("or", a, b):
            p, q = truth(run(a, row)), truth(run(b, row))
            return True if p or q else None if p is None or q is None else False
        case Binary("+" | "-" | "*" | "/" | "%" as op, a, b):
            return arithmetic(op, run(a, row), run(b, row))
        case Binary(op, a, b):
            return compare(op, run(a, row), run(b, row))
        case Is(a, None, neg):
            return (run(a, row) is None) != neg
        case Call("coalesce", args):
            return next((v for v in (run(a, row) for a in args) if v is not None), None)
        case Call("if", (c, a, b)):
            return run(a if run(c, row) is True else b, row)
        case Call("min" | "max" as f, args):
            vs = [run(a, row) for a in args]
            best = vs[0]
            for v in vs[1:]:
                if best is not None and v is not None and compare("<" if f == "min" else ">", v, best):
                    best = v
            return best
        case Call("abs", (a,)):
            v = run(a, row)
            return None if not number(v) else wrap(abs(v)) if isinstance(v, int) else abs(v)
        case Call("upper", (a,)):
            v = run(a, row)
            return v.upper() if isinstance(v, str) else None
        case Call("length", (a,)):
            v = run(a, row)
            return len(v) if isinstance(v, str) else None
    raise AssertionError(x)
