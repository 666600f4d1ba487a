"""Stages made of Python functions of a row: the slow path, in Arrow batches, with failing rows set apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import SchemaError
from ..types import SPARK, canonical
from .stages import HIDDEN, Flow, Stage, quoted

ERROR, KEEP = f"{HIDDEN}error", f"{HIDDEN}keep"


@dataclass
class DeadLetters:
    """Rows on which a closure failed: (stage, rows with their error) for each closure."""

    frames: list[tuple[str, DataFrame]] = field(default_factory=list)
    #: What is kept until the dead letters are written.
    held: list[DataFrame] = field(default_factory=list)


def _each(df: DataFrame, schema: T.StructType, function: Callable[[dict], dict], caught: bool) -> DataFrame:
    """``function`` of every row as a dict gives the row of ``schema``; what it raises goes to the column ERROR."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append(row | function({k: v for k, v in row.items() if not k.startswith(HIDDEN)}) | {ERROR: None})
                except Exception as e:
                    if not caught:
                        raise
                    out.append(row | {ERROR: f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _apart(flow: Flow, name: str, df: DataFrame, dead: DeadLetters | None) -> DataFrame:
    if dead is None:
        return df
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    dead.held.append(df)
    failed = df.where(F.col(ERROR).isNotNull())
    dead.frames.append((name, failed.select(F.lit(name).alias("_dead_letter_stage"), F.col(ERROR).alias("_error"), *map(quoted, flow.columns))))
    return df.where(F.col(ERROR).isNull())


@dataclass(frozen=True)
class FilterRows(Stage):
    function: Callable[[dict], bool]
    dead: DeadLetters | None = None
    name = "filter"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        f = self.function
        schema = T.StructType([*flow.df.schema.fields, T.StructField(KEEP, T.BooleanType()), T.StructField(ERROR, T.StringType())])
        df = _each(flow.df, schema, lambda row: {KEEP: bool(f(row))}, self.dead is not None)
        df = _apart(flow, self.name, df, self.dead).where(F.col(KEEP))
        return replace(flow, df=df.drop(KEEP, ERROR))


@dataclass(frozen=True)
class MapRows(Stage):
    """``columns`` are (name, type name) of what ``function`` returns for a row: a sequence, or a dict."""

    columns: tuple[tuple[str, str], ...]
    function: Callable[[dict], object]
    dead: DeadLetters | None = None
    name = "map"

    def apply(self, flow: Flow, ordered: bool) -> Flow:
        f, names = self.function, [n for n, _ in self.columns]
        inner = [f"{HIDDEN}v{i}" for i in range(len(names))]
        fields = [T.StructField(i, SPARK[canonical(k)]) for i, (_, k) in zip(inner, self.columns, strict=True)]
        schema = T.StructType([*flow.df.schema.fields, *fields, T.StructField(ERROR, T.StringType())])

        def values(row: dict) -> dict:
            got = f(row)
            got = [got.get(n) for n in names] if isinstance(got, dict) else list(got)
            if len(got) != len(names):
                raise SchemaError(f"map: {len(got)} values for {len(names)} columns")
            return dict(zip(inner, got, strict=True))

        df = _apart(flow, self.name, _each(flow.df, schema, values, self.dead is not None), self.dead)
        return replace(flow, df=df.select(*[F.col(i).alias(n) for i, n in zip(inner, names, strict=True)], *flow.hidden))
