"""Lexer and parser of the expression language, in two dialects.

``pipeline``: keywords in lower case only, ``==``, and ``not`` binds tighter than a comparison.
``sql``: keywords in any case, ``=`` and ``<>`` too, ``NOT`` binds looser than a comparison, ``IS [NOT] NULL`` and
``IS TRUE/FALSE``, doubled quotes in strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ExpressionError, TooComplex

MAX_DEPTH, MAX_TOKENS = 64, 4096
I64_MAX = 2**63 - 1


@dataclass(frozen=True)
class Lit:
    value: object  # None, bool, int, float or str


@dataclass(frozen=True)
class Col:
    name: str


@dataclass(frozen=True)
class Unary:
    op: str  # - not
    x: object


@dataclass(frozen=True)
class Binary:
    op: str  # or and == != < <= > >= + - * / %
    a: object
    b: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Is:
    x: object
    value: object  # None, True or False
    negated: bool


@dataclass(frozen=True)
class Token:
    kind: str  # num str name op end
    text: str
    value: object = None
    at: int = 0


_NUMBER = re.compile(r"\d[\d.]*")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_OPS = {"pipeline": ("==", "!=", "<=", ">=", *"<>+-*/%(),!"), "sql": ("==", "!=", "<>", "<=", ">=", *"=<>+-*/%(),;")}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _string(text: str, i: int, dialect: str) -> tuple[str, int]:
    quote, out = text[i], []
    i += 1
    while i < len(text):
        c = text[i]
        if c == quote:
            if dialect == "sql" and text[i + 1 : i + 2] == quote:
                out.append(quote)
                i += 2
                continue
            return "".join(out), i + 1
        if c == "\\" and dialect == "pipeline":
            if i + 1 >= len(text):
                break
            out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
            i += 2
            continue
        out.append(c)
        i += 1
    raise ExpressionError(f"expression: unterminated string in {text!r}")


def tokens(text: str, dialect: str = "pipeline") -> list[Token]:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
            continue
        if len(out) >= MAX_TOKENS:
            raise TooComplex(f"expression: more than {MAX_TOKENS} tokens")
        if c in "'\"":
            value, end = _string(text, i, dialect)
            out.append(Token("str", text[i:end], value, i))
            i = end
        elif m := _NUMBER.match(text, i):
            number = m[0]
            if number.count(".") > 1:
                raise ExpressionError(f"expression: bad number {number!r}")
            value = float(number) if "." in number else int(number)
            if isinstance(value, int) and value > I64_MAX:
                raise ExpressionError(f"expression: number {number} is out of range")
            out.append(Token("num", number, value, i))
            i = m.end()
        elif m := _NAME.match(text, i):
            out.append(Token("name", m[0], None, i))
            i = m.end()
        else:
            op = next((o for o in _OPS[dialect] if text.startswith(o, i)), None)
            if op is None:
                raise ExpressionError(f"expression: unexpected character {c!r} at {i} in {text!r}")
            out.append(Token("op", op, None, i))
            i += len(op)
    return [*out, Token("end", "", None, len(text))]


class Parser:
    """Recursive descent; ``expression()`` leaves ``self.at`` behind what it has read."""

    def __init__(self, text: str, dialect: str = "pipeline") -> None:
        self.text, self.dialect = text, dialect
        self.tokens, self.at, self.depth = tokens(text, dialect), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, why: str) -> ExpressionError:
        return ExpressionError(f"expression: {why} at {self.now.at} in {self.text!r}")

    def take(self, *ops: str) -> str | None:
        if self.now.kind == "op" and self.now.text in ops:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def word(self, *words: str) -> str | None:
        """A keyword, if it is next."""
        if self.now.kind == "name":
            text = self.now.text.lower() if self.dialect == "sql" else self.now.text
            if text in words:
                self.at += 1
                return text
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise self.fail(f"expected {op!r}")

    def expression(self) -> object:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TooComplex(f"expression: nested deeper than {MAX_DEPTH}")
        x = self._and()
        while self.word("or"):
            x = Binary("or", x, self._and())
        self.depth -= 1
        return x

    def _and(self) -> object:
        side = self._sql_not if self.dialect == "sql" else self._comparison
        x = side()
        while self.word("and"):
            x = Binary("and", x, side())
        return x

    def _sql_not(self) -> object:
        n = 0
        while self.word("not"):
            n += 1
            if n > MAX_DEPTH:
                raise TooComplex(f"expression: nested deeper than {MAX_DEPTH}")
        x = self._comparison()
        for _ in range(n):
            x = Unary("not", x)
        return x

    def _comparison(self) -> object:
        x = self._sum()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "=", "<>"):
            x = Binary({"=": "==", "<>": "!="}.get(op, op), x, self._sum())
            if self.dialect == "sql":
                break
        if self.dialect == "sql" and self.word("is"):
            negated = bool(self.word("not"))
            word = self.word("null", "true", "false")
            if not word:
                raise self.fail("expected NULL, TRUE or FALSE")
            x = Is(x, {"null": None, "true": True, "false": False}[word], negated)
        return x

    def _sum(self) -> object:
        x = self._product()
        while op := self.take("+", "-"):
            x = Binary(op, x, self._product())
        return x

    def _product(self) -> object:
        x = self._unary()
        while op := self.take("*", "/", "%"):
            x = Binary(op, x, self._unary())
        return x

    def _unary(self) -> object:
        ops = []
        while True:
            if op := self.take("-", "!") or (self.dialect == "sql" and self.take("+")):
                ops.append(op)
            elif self.dialect == "pipeline" and self.word("not"):
                ops.append("!")
            else:
                break
            if len(ops) > MAX_DEPTH:
                raise TooComplex(f"expression: nested deeper than {MAX_DEPTH}")
        x = self._primary()
        for op in reversed(ops):
            if op != "+":
                x = Unary("-" if op == "-" else "not", x)
        return x

    def _primary(self) -> object:
        t = self.now
        if t.kind in ("num", "str"):
            self.at += 1
            return Lit(t.value)
        if self.take("("):
            x = self.expression()
            self.need(")")
            return x
        if t.kind != "name":
            raise self.fail("expected a value")
        if word := self.word("true", "false", "null", "nil"):
            return Lit({"true": True, "false": False}.get(word))
        if t.text.lower() in ("and", "or", "not") and (self.dialect == "sql" or t.text.islower()):
            raise self.fail(f"unexpected {t.text!r}")
        self.at += 1
        if self.take("("):
            args = []
            if not self.take(")"):
                args.append(self.argument())
                while self.take(","):
                    args.append(self.argument())
                self.need(")")
            return Call(t.text.lower() if self.dialect == "sql" else t.text, tuple(args))
        return Col(t.text)

    def argument(self) -> object:
        return self.expression()


def parse(text: str, dialect: str = "pipeline") -> object:
    p = Parser(text, dialect)
    x = p.expression()
    if p.now.kind != "end":
        raise p.fail(f"unexpected {p.now.text!r}")
    return x


def columns_of(x: object) -> set[str]:
    """Names of the columns that an expression reads."""
    match x:
        case Col(name):
            return {name}
        case Unary(_, a) | Is(a, _, _):
            return columns_of(a)
        case Binary(_, a, b):
            return columns_of(a) | columns_of(b)
        case Call(_, args):
            return set().union(*map(columns_of, args)) if args else set()
    return set()
