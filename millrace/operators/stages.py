"""Stages: each turns a flow into a flow, as part of one lazy plan.

A flow is a DataFrame and, where a later stage needs it, the order of its rows in hidden columns. ``sort`` only adds to
that order; rows are sorted once, at the end, or taken by a limit as top-n.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, SchemaError, missing_column
from ..functions.hashing import position
from ..functions.lower import lower, predicate
from ..functions.syntax import parse
from ..types import FLOATS, INTS, NUMERIC, kind_of
from .quality import Check, NoNulls, run_checks

HIDDEN = "__mr_"


@dataclass(frozen=True)
class Order:
    name: str
    descending: bool = False
    nulls_last: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    order: tuple[Order, ...] = ()
    #: Whether the order was asked for, so that the result must have it.
    sorted: bool = False
    strict_columns: bool = False

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [o.name for o in self.order]

    def visible(self) -> DataFrame:
        return self.df.select(*map(quoted, self.columns))

    def result(self) -> DataFrame:
        df = self.df.orderBy(*[o.column() for o in self.order]) if self.sorted else self.df
        return df.select(*map(quoted, self.columns))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require(what: str, names: list[str], flow: Flow) -> None:
    for n in names:
        if n not in flow.columns:
            raise missing_column(what, n, flow.columns)


class Stage:
    #: As in explain().
    name = "stage"
    #: What the stage needs of, and does to, the order of rows: it reads it, ends it, or lets it be.
    reads_order = False
    ends_order = False

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        """``ordered``: whether a later stage reads the order of this one's rows."""
        raise NotImplementedError


@dataclass(frozen=True)
class Filter(Stage):
    condition: object  # expression text, syntax, Column or function of the DataFrame
    name = "filter"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        c = self.condition
        if isinstance(c, str):
            c = parse(c)
        if callable(c) and not isinstance(c, Column):
            c = c(flow.visible())
        if not isinstance(c, Column):
            c = predicate(lower(c, flow.visible().schema, flow.strict_columns))
        return replace(flow, df=flow.df.where(c))  # NULL drops too


@dataclass(frozen=True)
class Map(Stage):
    """The output has exactly these columns; ``keep`` keeps the input's columns before them."""

    columns: tuple[tuple[str, object], ...]
    keep: bool = False
    name = "map"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        schema, out = flow.visible().schema, []
        new = [n for n, _ in self.columns]
        if len(set(new)) < len(new):
            raise SchemaError(f"map: a column is named twice: {', '.join(new)}")
        for name, x in self.columns:
            c = x if isinstance(x, Column) else lower(parse(x) if isinstance(x, str) else x, schema, flow.strict_columns)
            if not isinstance(c, Column):
                c = c.column.cast("string") if c.kind == "null" else c.column
            out.append(c.alias(name))
        kept = [quoted(c) for c in flow.columns if c not in new] if self.keep else []
        return replace(flow, df=flow.df.select(*kept, *out, *flow.hidden))


@dataclass(frozen=True)
class Select(Stage):
    columns: tuple[str, ...]
    name = "select"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        require("select", list(self.columns), flow)
        return replace(flow, df=flow.df.select(*map(quoted, self.columns), *flow.hidden))


@dataclass(frozen=True)
class Drop(Stage):
    columns: tuple[str, ...]
    name = "select"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        left = [c for c in flow.columns if c not in self.columns]
        return replace(flow, df=flow.df.select(*map(quoted, left), *flow.hidden))


@dataclass(frozen=True)
class Limit(Stage):
    """The first n rows in the flow's order (a top-n of each partition, then of those); after an aggregate, any n."""

    n: int
    name = "limit"
    reads_order = True

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        if self.n < 0:
            raise ConfigError("limit: n must not be negative")
        df = flow.df.orderBy(*[o.column() for o in flow.order]) if flow.order else flow.df
        return replace(flow, df=df.limit(self.n))


@dataclass(frozen=True)
class Sort(Stage):
    """NULL comes first ascending and last descending. Equal rows keep their order where a later stage can tell."""

    columns: tuple[str, ...]
    descending: tuple[bool, ...]
    name = "Sort"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        require("sort", list(self.columns), flow)
        n = sum(c.startswith(f"{HIDDEN}s") for c in flow.df.columns)
        keys = [Order(f"{HIDDEN}s{n + i}", d) for i, d in enumerate(self.descending)]
        df = flow.df.select("*", *[quoted(c).alias(k.name) for c, k in zip(self.columns, keys, strict=True)])
        return replace(flow, df=df, order=(*keys, *flow.order), sorted=True)


@dataclass(frozen=True)
class Dedup(Stage):
    """The first row of each key, by a minimum that is taken in every partition before anything is shuffled.

    Without columns whole rows are distinct. NULL equals NULL.
    """

    columns: tuple[str, ...] = ()
    name = "Deduplicate"

    @property
    def reads_order(self) -> bool:  # type: ignore[override]
        return bool(self.columns)

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        require("dedup", list(self.columns), flow)
        keys = list(self.columns) or flow.columns
        if not self.columns and not (ordered or flow.sorted):
            return Flow(flow.visible().distinct(), strict_columns=flow.strict_columns)
        if not flow.order:  # after an aggregate there is no first row
            return replace(flow, df=flow.df.dropDuplicates(keys))
        if any(o.descending or o.nulls_last for o in flow.order):
            w = Window.partitionBy(*map(quoted, keys)).orderBy(*[o.column() for o in flow.order])
            n = f"{HIDDEN}n"
            return replace(flow, df=flow.df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n))
        row = F.struct(*map(quoted, flow.df.columns))
        first = F.min_by(row, F.struct(*flow.hidden)).alias("first")
        grouped = flow.df.groupBy(*[quoted(k).alias(f"{HIDDEN}k{i}") for i, k in enumerate(keys)]).agg(first)
        return replace(flow, df=grouped.select("first.*"))


#: Aggregate functions and the prefix of their default output names.
AGGREGATES = ("sum", "avg", "count", "min", "max")


@dataclass(frozen=True)
class AggSpec:
    function: str  # one of AGGREGATES, or count_all
    column: str | None = None
    output: str | None = None

    @property
    def name(self) -> str:
        return self.output or ("count_all" if self.function == "count_all" else f"{self.function}_{self.column}")


@dataclass(frozen=True)
class Aggregate(Stage):
    """Keys, then one column for each spec. NULL keys form a group. Without keys there is one row, also for no input."""

    keys: tuple[str, ...]
    specs: tuple[AggSpec, ...]
    name = "GroupByAgg"
    ends_order = True

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        require("group_by", list(self.keys), flow)
        df = flow.visible()
        out = [self._spec(s, flow, df) for s in self.specs]
        names = [*self.keys, *[s.name for s in self.specs]]
        if len(set(names)) < len(names):
            raise SchemaError(f"aggregate: a column is named twice: {', '.join(names)}")
        if not out:
            return Flow(df.select(*map(quoted, self.keys)).distinct(), strict_columns=flow.strict_columns)
        grouped = df.groupBy(*map(quoted, self.keys)).agg(*out) if self.keys else df.agg(*out)
        return Flow(grouped, strict_columns=flow.strict_columns)

    def _spec(self, s: AggSpec, flow: Flow, df: DataFrame) -> Column:
        if s.function == "count_all":
            return F.count(F.lit(1)).alias(s.name)
        if s.function not in AGGREGATES:
            raise ConfigError(f"aggregate: unknown function {s.function!r}; known: {', '.join(AGGREGATES)}, count_all")
        require("aggregate", [s.column], flow)
        kind, c = kind_of(df.schema[s.column].dataType), quoted(s.column)
        if s.function in ("sum", "avg") and kind not in NUMERIC:
            raise SchemaError(f"aggregate: {s.function} needs numbers; {s.column!r} is {kind}")
        if s.function in ("min", "max") and kind == "bool":
            raise SchemaError(f"aggregate: {s.function} can't order {s.column!r}, a bool")
        if s.function == "sum":
            return F.sum(c.cast("long") if kind in INTS else c.cast("double") if kind in FLOATS else c).alias(s.name)
        return {"avg": F.avg, "count": F.count, "min": F.min, "max": F.max}[s.function](c).alias(s.name)


JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


@dataclass(frozen=True)
class Join(Stage):
    """Equi-join; NULL keys match nothing. Left columns, then all right ones; a right name that is taken gets ``_r``.

    Spark picks the strategy: a side is broadcast only if its size is known to be below the session's threshold, large
    sides are shuffled, and skewed keys are split at run time.
    """

    right: Callable[[], DataFrame]
    left_keys: tuple[str, ...]
    right_keys: tuple[str, ...]
    how: str = "inner"
    strict_nulls: bool = False
    name = "HashJoin"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        if self.how not in JOINS:
            raise ConfigError(f"join: unknown type {self.how!r}; known: {', '.join(JOINS)}")
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise ConfigError("join: as many right keys as left keys, and at least one")
        right = self.right()
        require("join (left)", list(self.left_keys), flow)
        for k in self.right_keys:
            if k not in right.columns:
                raise missing_column("join (right)", k, right.columns)
        if self.strict_nulls:
            run_checks(right, [NoNulls(k) for k in self.right_keys])
        taken, names = set(flow.columns), []
        for c in right.columns:
            new = f"{c}_r" if c in taken else c
            if new in taken or new in names:
                raise SchemaError(f"join: column {new!r} would be there twice")
            names.append(new)
        inner = [f"{HIDDEN}j{i}" for i in range(len(names))]
        order = flow.order
        renamed = right.toDF(*inner)
        if ordered and order:
            n = sum(c.startswith(f"{HIDDEN}m") for c in flow.df.columns)
            renamed = renamed.withColumn(f"{HIDDEN}m{n}", F.monotonically_increasing_id())
            order = (*[replace(o, nulls_last=not o.descending) for o in order], Order(f"{HIDDEN}m{n}"))
        on = [quoted(a) == F.col(inner[right.columns.index(b)]) for a, b in zip(self.left_keys, self.right_keys, strict=True)]
        joined = flow.df.join(renamed, on, JOINS[self.how])
        columns = [*map(quoted, flow.columns), *[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)]]
        return replace(flow, df=joined.select(*columns, *[o.name for o in order]), order=order)


@dataclass(frozen=True)
class Sample(Stage):
    """Rows whose key's position lies below ``fraction``: the same keys on every run and in every layout."""

    fraction: float
    keys: tuple[str, ...]
    seed: int = 0
    name = "sample"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        if not 0 <= self.fraction <= 1:
            raise ConfigError("sample: fraction must lie between 0 and 1")
        if not self.keys:
            raise ConfigError("sample: at least one key column")
        require("sample", list(self.keys), flow)
        if self.fraction == 1:
            return flow
        return replace(flow, df=flow.df.where(position(flow.df, list(self.keys), self.seed) < self.fraction))


@dataclass(frozen=True)
class Expect(Stage):
    """Rows pass as they are. The checks run when the plan is compiled for a result, before any sink writes."""

    checks: tuple[Check, ...]
    name = "expect"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        run_checks(flow.visible(), list(self.checks))
        return flow


@dataclass(frozen=True)
class Custom(Stage):
    """Any function of the DataFrame; the order of rows is lost."""

    function: Callable[[DataFrame], DataFrame]
    name = "custom"
    ends_order = True

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        return Flow(self.function(flow.visible()), strict_columns=flow.strict_columns)

