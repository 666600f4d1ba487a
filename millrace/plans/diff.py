"""Keyed diff of two tables: one full outer join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, SchemaError
from ..types import NUMERIC, kind_of


@dataclass
class Diff:
    """``rows``: ``_diff`` (``-`` or ``+``), then the columns that both sides have, in the order of the first; a changed
    row is there twice."""

    rows: DataFrame
    marked: DataFrame
    notes: list[str] = field(default_factory=list)

    def summary(self) -> dict[str, int]:
        found = {r.kind: r.n for r in self.marked.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {k: found.get(k, 0) for k in ("added", "removed", "changed", "unchanged")}

    def text(self) -> str:
        s = self.summary()
        return "".join(f"note: {n}\n" for n in self.notes) + ", ".join(f"{n} {k}" for k, n in s.items())


def _same(a: Column, b: Column, ka: str, kb: str) -> Column:
    """Equal by value, or alike as text. NULL equals NULL."""
    if ka == kb or (ka in NUMERIC and kb in NUMERIC):
        return a.eqNullSafe(b)
    return a.cast("string").eqNullSafe(b.cast("string"))


def diff(a: DataFrame, b: DataFrame, keys: list[str]) -> Diff:
    """``a`` is before, ``b`` after. Keys must be on both sides, of one type, and single on each side (checked by a count
    that is summed in every partition first)."""
    if not keys:
        raise ConfigError("diff: at least one key column")
    for k in keys:
        for side, df in (("first", a), ("second", b)):
            if k not in df.columns:
                raise SchemaError(f"diff: key column {k!r} not found in the {side} input; available: {', '.join(df.columns)}")
        if kind_of(a.schema[k].dataType) != kind_of(b.schema[k].dataType):
            raise SchemaError(f"diff: key column {k!r} is {kind_of(a.schema[k].dataType)} on one side and {kind_of(b.schema[k].dataType)} on the other")
    for side, df in (("first", a), ("second", b)):
        twice = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").first()
        if twice is not None:
            raise SchemaError(f"diff: key {', '.join(str(x) for x in twice[: len(keys)])} occurs {twice['__n']} times in the {side} input")
    common = [c for c in a.columns if c in b.columns]
    notes = [f"column {c!r} is only in the first input" for c in a.columns if c not in b.columns] + [f"column {c!r} is only in the second input" for c in b.columns if c not in a.columns]
    left = a.select(F.struct(*[F.col(f"`{c}`") for c in common]).alias("a"))
    right = b.select(F.struct(*[F.col(f"`{c}`") for c in common]).alias("b"))
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    equal = F.lit(True)
    for c in common:
        equal = equal & _same(F.col(f"a.`{c}`"), F.col(f"b.`{c}`"), kind_of(a.schema[c].dataType), kind_of(b.schema[c].dataType))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(equal, "unchanged").otherwise("changed")
    marked = left.join(right, on, "full").withColumn("kind", kind)

    def side(name: str, mark: str) -> Column:
        fields = [F.col(f"{name}.`{c}`").cast(a.schema[c].dataType if kind_of(a.schema[c].dataType) == kind_of(b.schema[c].dataType) else "string").alias(c) for c in common]
        return F.when(F.col(name).isNotNull(), F.struct(F.lit(mark).alias("_diff"), *fields))

    both = marked.where("kind <> 'unchanged'").select(F.explode(F.array_compact(F.array(side("a", "-"), side("b", "+")))).alias("r"))
    rows = both.select("r.*")
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    return Diff(rows.orderBy(*order, F.when(F.col("_diff") == "-", 0).otherwise(1)), marked, notes)
