"""Data-quality checks: all checks of a stage in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataQualityError
from ..types import FLOATS, NUMERIC, canonical, kind_of


@dataclass(frozen=True)
class RowsAtLeast:
    n: int

    def describe(self) -> str:
        return f"rows >= {self.n}"


@dataclass(frozen=True)
class RowsAtMost:
    n: int

    def describe(self) -> str:
        return f"rows <= {self.n}"


@dataclass(frozen=True)
class NoNulls:
    column: str

    def describe(self) -> str:
        return f'no nulls "{self.column}"'


@dataclass(frozen=True)
class Unique:
    column: str

    def describe(self) -> str:
        return f'unique "{self.column}"'


@dataclass(frozen=True)
class Range:
    column: str
    min: float | None = None
    max: float | None = None

    def describe(self) -> str:
        return f'range "{self.column}" [{"" if self.min is None else self.min}, {"" if self.max is None else self.max}]'


@dataclass(frozen=True)
class OneOf:
    column: str
    allowed: tuple = field(default_factory=tuple)

    def describe(self) -> str:
        return f'one of "{self.column}" {list(self.allowed)}'


@dataclass(frozen=True)
class HasType:
    column: str
    expected: str

    def describe(self) -> str:
        return f'type "{self.column}" {canonical(self.expected)}'


Check = RowsAtLeast | RowsAtMost | NoNulls | Unique | Range | OneOf | HasType


def _outside(check: Range, df: DataFrame) -> Column:
    kind = kind_of(df.schema[check.column].dataType)
    c = F.col(f"`{check.column}`")
    if kind == "date":
        c = F.unix_date(c)
    elif kind == "timestamp":
        c = F.unix_micros(c.cast("timestamp"))
    elif kind not in NUMERIC:
        return c.isNotNull()
    bad = F.lit(False)
    if check.min is not None:
        bad = bad | (c < check.min)
    if check.max is not None:
        bad = bad | (c > check.max)
    return (bad | F.isnan(c)) if kind in FLOATS else bad


def _not_allowed(check: OneOf, df: DataFrame) -> Column:
    """NULL passes. Integers compare across widths; any other value must have the column's type."""
    kind, c = kind_of(df.schema[check.column].dataType), F.col(f"`{check.column}`")
    fits = {"bool": bool, "utf8": str, "float32": float, "float64": float, "int32": int, "int64": int, "date": object, "timestamp": object}.get(kind)
    like = [v for v in check.allowed if fits and (isinstance(v, fits) and not (fits is int and isinstance(v, bool)))]
    return ~c.isin(like) if like else c.isNotNull()


def run_checks(df: DataFrame, checks: list[Check]) -> None:
    """Raise DataQualityError for the first check that fails. One pass over ``df`` at most."""
    wants: list[Column] = []
    for i, check in enumerate(checks):
        name = getattr(check, "column", None)
        if name is not None and name not in df.columns:
            raise DataQualityError(f"check {check.describe()}: column {name!r} not found; available: {', '.join(df.columns)}")
        match check:
            case RowsAtLeast() | RowsAtMost():
                value = F.count(F.lit(1))
            case NoNulls(column):
                value = F.count_if(F.col(f"`{column}`").isNull())
            case Unique(column):
                c = F.col(f"`{column}`")
                value = F.count(c) - F.count_distinct(c)
            case Range():
                value = F.count_if(_outside(check, df))
            case OneOf():
                value = F.count_if(_not_allowed(check, df))
            case HasType(column, expected):
                found = kind_of(df.schema[column].dataType)
                if found != canonical(expected):
                    raise DataQualityError(f"check failed: {check.describe()}: it is {found}")
                continue
        wants.append(value.alias(f"c{i}"))
    if not wants:
        return
    row = df.agg(*wants).first()
    for i, check in enumerate(checks):
        if isinstance(check, HasType):
            continue
        n = row[f"c{i}"] or 0
        failed = n < check.n if isinstance(check, RowsAtLeast) else n > check.n if isinstance(check, RowsAtMost) else n > 0
        if failed:
            raise DataQualityError(f"check failed: {check.describe()}: {n} row(s)")
