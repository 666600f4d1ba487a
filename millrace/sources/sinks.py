"""Sinks. Text sinks write one file by default, as small results want it, or a folder that scales (``single=False``)."""

from __future__ import annotations

import os
import uuid
from typing import TextIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import kind_of, show_timestamp


@F.pandas_udf(T.StringType())
def _positional(values: pd.Series) -> pd.Series:
    def show(v: float) -> str | None:
        if v is None or v != v:
            return None if v is None else "NaN"
        return {float("inf"): "inf", float("-inf"): "-inf"}.get(v) or np.format_float_positional(v, trim="-")

    return values.map(show, na_action=None)


def shown(df: DataFrame, plain_floats: bool = True) -> list[Column]:
    """Columns as text: floats in positional form without a trailing ``.0``, dates and timestamps in ISO form."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        if kind in ("float32", "float64") and plain_floats:
            c = F.when(c.isNotNull(), _positional(c.cast("double") if kind == "float64" else c))
        elif kind == "timestamp":
            c = show_timestamp(c)
        else:
            c = c.cast("string")
        out.append(c.alias(f.name))
    return out


def _joined(df: DataFrame, path: str, write, first: bytes = b"", last: bytes = b"", between: bytes = b"", empty: bytes = b"") -> int:
    """The parts that ``write(folder)`` makes, in order, as one file in place of ``path``; its size.

    Executors write the parts to ``spark.checkpoint.dir``, which they share with the driver, or beside the target where
    that is unset. The driver copies them as streams. With ``between`` each row of a part ends so, and the last such end
    is cut; without rows the file is ``empty``.
    """
    local = os.path.abspath(path.removeprefix("file://"))
    beside = os.path.dirname(local)
    if not os.path.isdir(beside):
        raise FileNotFoundError(f"{beside}: no such folder")
    context, name = df.sparkSession.sparkContext, f".millrace-{uuid.uuid4().hex}"
    jvm, whole = context._jvm, os.path.join(beside, name)
    hadoop = jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{df.sparkSession.conf.get('spark.checkpoint.dir', None) or f'file://{beside}'}/{name}-parts")
    system = folder.getFileSystem(context._jsc.hadoopConfiguration())
    try:
        write(f"{folder.toString()}/parts")
        found = [(s.getPath().getName(), s.getLen(), s.getPath()) for s in system.listStatus(hadoop(folder, "parts"))]
        found = sorted((n, size, p) for n, size, p in found if n.startswith("part-") and size)
        left = sum(size for _, size, _ in found) - (len(between) if found else 0)
        out = jvm.java.io.FileOutputStream(whole)
        try:
            if between and not found:
                first, last = empty, b""
            out.write(first)
            for _, size, part in found:
                source = system.open(part)
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, min(size, left))
                finally:
                    source.close()
                left -= min(size, left)
            out.write(last)
            out.getFD().sync()
        finally:
            out.close()
        os.replace(whole, local)
        return os.path.getsize(local)
    finally:
        system.delete(folder, True)
        if os.path.exists(whole):
            os.remove(whole)


def _csv_writer(df: DataFrame):
    return df.write.mode("overwrite").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\r\n') else name


def write_csv(df: DataFrame, path: str, single: bool = True) -> int:
    """NULL and empty text are both empty cells."""
    text = df.select(*shown(df))
    if not single:
        _csv_writer(text).option("header", True).csv(path)
        return 0
    header = ",".join(map(_quoted, df.columns)) + "\n"
    return _joined(text, path, lambda folder: _csv_writer(text).option("header", False).csv(folder), header.encode())


def json_line(df: DataFrame) -> Column:
    """A row as a JSON object: all keys, in alphabetical order; empty text, NaN and infinities are null."""
    fields = []
    for name in sorted(df.columns):
        c, kind = F.col(f"`{name}`"), kind_of(df.schema[name].dataType)
        if kind == "utf8":
            c = F.nullif(c, F.lit(""))
        elif kind in ("float32", "float64"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif kind == "timestamp":
            c = show_timestamp(c)
        fields.append(c.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")


def write_jsonl(df: DataFrame, path: str, single: bool = True) -> int:
    text = df.select(json_line(df))
    if not single:
        text.write.mode("overwrite").text(path)
        return 0
    return _joined(text, path, lambda folder: text.write.mode("overwrite").text(folder))


def write_json(df: DataFrame, path: str, pretty: bool = False) -> int:
    """One array of objects; ``pretty`` gives each row a line of its own, two spaces in."""
    text = df.select(json_line(df))  # a line for each row, since JSON escapes line breaks
    first, between, last = (b"[\n  ", b",\n  ", b"\n]\n") if pretty else (b"[", b",", b"]")
    return _joined(text, path, lambda folder: text.write.option("lineSep", between.decode()).text(folder), first, last, between, b"[]")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def to_csv_text(df: DataFrame) -> str:
    """The CSV of a small result."""
    rows = df.select(*shown(df)).collect()
    lines = [",".join(map(_quoted, df.columns))]
    lines += [",".join("" if v is None else _quoted(v) for v in r) for r in rows]
    return "\n".join(lines) + "\n"


def stream_csv(df: DataFrame, out: TextIO) -> int:
    """Append the rows as CSV, with a header if there are any; their number. The driver holds a partition at a time."""
    n = 0
    for row in df.select(*shown(df)).toLocalIterator():
        if not n:
            out.write(",".join(map(_quoted, df.columns)) + "\n")
        out.write(",".join("" if v is None else _quoted(v) for v in row) + "\n")
        n += 1
    return n
