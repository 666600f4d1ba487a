"""``sql("SELECT ...")``: SELECT over one table, compiled to the stages of a pipeline."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError, ExpressionError, SchemaError
from ..functions.syntax import Call, Col, Parser
from ..operators.stages import AGGREGATES, Aggregate, AggSpec, Dedup, Filter, Limit, Map, Sort
from .pipeline import Pipeline

#: Words that begin what this dialect doesn't have.
REJECTED = ("join", "inner", "left", "right", "full", "cross", "union", "intersect", "except", "having", "offset", "between", "in", "like", "case", "with", "window", "qualify")
CLAUSES = ("from", "where", "group", "order", "limit", "as", "asc", "desc", "distinct", "by", *REJECTED)


@dataclass
class Item:
    """An output column: an expression, or an aggregate."""

    name: str | None
    x: object = None
    star: bool = False
    function: str | None = None
    column: str | None = None


@dataclass
class Query:
    items: list[Item] = field(default_factory=list)
    distinct: bool = False
    table: str = ""
    quoted_table: bool = False
    where: object = None
    keys: list[str] | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


class _Select(Parser):
    def __init__(self, text: str) -> None:
        super().__init__(text, "sql")

    def reject(self) -> None:
        if self.now.kind == "name" and self.now.text.lower() in REJECTED:
            raise self.fail(f"{self.now.text.upper()} is not supported")

    def name(self, what: str) -> str:
        t = self.now
        if t.kind != "name" or t.text.lower() in CLAUSES:
            raise self.fail(f"expected {what}")
        self.at += 1
        return t.text

    def query(self) -> Query:
        q = Query()
        if not self.word("select"):
            raise self.fail("only SELECT is supported; expected it")
        q.distinct = bool(self.word("distinct"))
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        self.reject()
        if not self.word("from"):
            raise self.fail("expected FROM")
        t = self.now
        if t.kind == "str":
            q.table, q.quoted_table = t.value, True
            self.at += 1
        else:
            q.table = self.name("a table")
        self.reject()
        if self.word("where"):
            q.where = self.expression()
        self.reject()
        if self.word("group"):
            self.by()
            q.keys = [self.name("a column")]
            while self.take(","):
                q.keys.append(self.name("a column"))
        self.reject()
        if self.word("order"):
            self.by()
            q.order.append(self.sort_key())
            while self.take(","):
                q.order.append(self.sort_key())
        self.reject()
        if self.word("limit"):
            t = self.now
            if t.kind != "num" or not isinstance(t.value, int):
                raise self.fail("LIMIT needs a whole number")
            q.limit = t.value
            self.at += 1
        self.reject()
        self.take(";")
        if self.now.kind != "end":
            raise self.fail(f"unexpected {self.now.text!r} after the query")
        return q

    def by(self) -> None:
        if not self.word("by"):
            raise self.fail("expected BY")

    def sort_key(self) -> tuple[str, bool]:
        name = self.name("an output column")
        return name, self.word("asc", "desc") == "desc"

    def item(self) -> Item:
        if self.take("*"):
            return Item(None, star=True)
        t, after = self.now, self.tokens[min(self.at + 1, len(self.tokens) - 1)]
        item = None
        if t.kind == "name" and t.text.lower() in AGGREGATES and after.text == "(":
            inside = self.tokens[self.at + 2 : self.at + 4]
            if len(inside) == 2 and inside[1].text == ")" and (inside[0].text == "*" or inside[0].kind == "name"):
                function, column = t.text.lower(), inside[0].text
                if column == "*" and function != "count":
                    raise self.fail(f"{function.upper()}(*) is not supported")
                self.at += 4
                default = "count_all" if column == "*" else f"{function}_{column}"
                item = Item(default, function="count_all" if column == "*" else function, column=None if column == "*" else column)
            elif t.text.lower() not in ("min", "max"):
                raise self.fail(f"{t.text.upper()} takes a column or *")
        if item is None:
            x = self.expression()
            self.reject()
            if isinstance(x, Call) and x.name in AGGREGATES:
                raise self.fail(f"{x.name.upper()} takes a bare column here")
            if isinstance(x, Call) or _calls(x):
                raise self.fail("functions of a row are not supported")
            item = Item(x.name if isinstance(x, Col) else None, x)
        if self.word("as"):
            item.name = self.name("an alias")
        elif item.name is None:
            raise self.fail("a computed column needs AS and a name")
        return item


def _calls(x: object) -> bool:
    if isinstance(x, Call):
        return True
    return any(_calls(getattr(x, a)) for a in ("x", "a", "b") if hasattr(x, a))


def parse_select(text: str) -> Query:
    return _Select(text).query()


def stages_of(q: Query) -> list:
    """In the fixed order filter, aggregate or map, distinct, sort, limit."""
    out: list = []
    if q.where is not None:
        if _calls(q.where):
            raise ExpressionError("expression: functions are not supported in WHERE")
        out.append(Filter(q.where))
    aggregates = [i for i in q.items if i.function]
    if q.keys is not None or aggregates:
        keys = q.keys or []
        for i in q.items:
            if i.star:
                raise SchemaError("SELECT * does not go with GROUP BY")
            if not i.function and not (isinstance(i.x, Col) and i.x.name in keys):
                raise SchemaError(f"{i.name!r} is neither grouped by nor aggregated")
        specs = [AggSpec(i.function, i.column, f"a{n}_{i.name}") for n, i in enumerate(aggregates)]
        out.append(Aggregate(tuple(keys), tuple(specs)))
        inner = {id(i): s.output for i, s in zip(aggregates, specs, strict=True)}
        out.append(Map(tuple((i.name, Col(inner[id(i)]) if i.function else i.x) for i in q.items)))
    elif [i.star for i in q.items] != [True]:
        if any(i.star for i in q.items[1:]):
            raise SchemaError("* goes first")
        keep = q.items[0].star
        out.append(Map(tuple((i.name, i.x) for i in q.items if not i.star), keep=keep))
    if q.distinct:
        out.append(Dedup())
    if q.order:
        out.append(Sort(tuple(c for c, _ in q.order), tuple(d for _, d in q.order)))
    if q.limit is not None:
        out.append(Limit(q.limit))
    return out


def sql_pipeline(text: str, spark: SparkSession | None = None, tables: Mapping[str, DataFrame | str] | None = None, on_error: str = "strict") -> Pipeline:
    """A pipeline for a SELECT. FROM names one of ``tables``, a view of the session, or a file (``.csv`` if it has no dot).

    Names that the query reads must be there.
    """
    q = parse_select(text)
    p = Pipeline(spark, strict_columns=True).on_error(on_error)
    found = (tables or {}).get(q.table)
    if isinstance(found, DataFrame):
        p.from_df(found)
    elif found is not None:
        p.read(found)
    elif not q.quoted_table and p.spark.catalog.tableExists(q.table):
        p.from_df(p.spark.table(q.table))
    else:
        p.read(q.table if "." in q.table else f"{q.table}.csv")
    for s in stages_of(q):
        p.stage(s)
    return p


def sql(text: str, spark: SparkSession | None = None, tables: Mapping[str, DataFrame | str] | None = None, on_error: str = "strict") -> DataFrame:
    if not text.strip():
        raise ConfigError("an empty query")
    return sql_pipeline(text, spark, tables, on_error).to_df()
