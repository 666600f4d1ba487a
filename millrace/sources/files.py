"""CSV, JSON lines and JSON arrays, with inferred types and a policy for malformed rows."""

from __future__ import annotations

import csv
import gzip
import os
import re
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, CsvError, IoError, JsonError, SchemaError
from ..types import SPARK, TIMESTAMP_TEXT, parse_date, parse_timestamp

CORRUPT = "__mr_corrupt"
MAX_RECORD = 16 * 1024 * 1024

INT = r"^[+-]?\d+$"
FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def _bool(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def _float(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"^\+", "")
    word = F.when(plain.rlike("^-(inf|infinity)$"), F.lit("-Infinity")).when(plain.rlike("^(inf|infinity)$"), F.lit("Infinity")).when(plain.rlike("^[+-]?nan$"), F.lit("NaN"))
    return F.when(c.rlike(FLOAT), F.coalesce(word, plain).try_cast("double"))


def _quick_float(c: Column) -> Column:
    """The same value without patterns for all ordinary cells; a last letter d or f would be a suffix to Spark's cast."""
    return F.coalesce(F.when(~F.substring(c, -1, 1).isin("d", "D", "f", "F"), c.try_cast("double")), _float(c))


#: Types in the order in which a column of text climbs; a column takes the first that all its cells fit, else utf8.
LADDER = {
    "bool": _bool,
    "int32": lambda c: F.when(c.rlike(INT), F.regexp_replace(c, r"^\+", "").try_cast("int")),
    "int64": lambda c: F.when(c.rlike(INT), F.regexp_replace(c, r"^\+", "").try_cast("bigint")),
    "float64": _float,
    "date": parse_date,
    "timestamp": parse_timestamp,
}


@dataclass(frozen=True)
class Policy:
    """strict: the first malformed row is an error; skip: such rows go; quarantine: they go to ``path``."""

    kind: str = "strict"
    path: str | None = None

    @staticmethod
    def parse(text: str) -> Policy:
        kind, _, path = text.partition(":")
        if kind in ("strict", "skip") and not path:
            return Policy(kind)
        if kind == "quarantine" and path:
            return Policy(kind, path)
        raise ConfigError(f"unknown error policy {text!r}; known: strict, skip, quarantine:<path>")


def detect(path: str) -> str:
    """Format by name: http, jsonl, json, columnar, parquet, or csv for all else."""
    low = path.lower()
    if low.startswith(("http://", "https://")):
        return "http"
    low = low.removesuffix(".gz")
    if low.endswith((".jsonl", ".ndjson")):
        return "jsonl"
    if low.endswith(".json"):
        return "json"
    if low.endswith(".tptcol"):  # fixed value: the extension of native chunk files
        return "columnar"
    return "parquet" if low.endswith(".parquet") else "csv"


def _exists(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
        raise IoError(f"{path}: no such file")


def _sound(raw: DataFrame, path: str, policy: Policy) -> DataFrame:
    """Rows that were read well; under ``strict`` any other is an error when the plan meets it.

    The condition takes in a column of the file, since Spark refuses to read for the corrupt column alone.
    """
    other = F.coalesce(F.col(f"`{raw.columns[0]}`").cast("string"), F.lit(""))
    if policy.kind != "strict":
        return raw.where(F.when(F.col(CORRUPT).isNull(), F.length(other) >= 0).otherwise(F.lit(False)))
    failing = F.raise_error(F.concat(F.lit(f"{path}: malformed row: "), F.col(CORRUPT))).cast("boolean")
    return raw.where(F.when(F.col(CORRUPT).isNotNull(), failing).otherwise(F.length(other) >= 0))


def _broken(raw: DataFrame) -> DataFrame:
    other = F.coalesce(F.col(f"`{raw.columns[0]}`").cast("string"), F.lit(""))
    return raw.where(F.when(F.col(CORRUPT).isNotNull(), F.length(other) >= 0).otherwise(F.lit(False))).select(CORRUPT)


def _quarantine(policy: Policy, bad: DataFrame, header: str | None) -> None:
    """The file is made, readable by its owner only, before any row is read; rows stream through the driver."""
    try:
        handle = os.open(policy.path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    except OSError as e:
        raise IoError(f"quarantine file {policy.path}: {e}") from e
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        wrote = False
        for row in bad.toLocalIterator():
            if header is not None and not wrote:
                out.write(header + "\n")
            wrote = True
            out.write(row[0].rstrip("\r\n") + "\n")


def read_csv(spark: SparkSession, path: str, policy: Policy = Policy(), multi_line: bool | None = None, infer_rows: int | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV file (or folder, or glob) with a header row.

    Cells are trimmed, empty ones NULL. Types come from one aggregate over all rows (or the first ``infer_rows``), unless
    ``types`` gives them; a column without any cell is bool. A file is split among tasks unless a quoted line break
    forbids it; ``multi_line=None`` looks for those first.
    """
    _exists(spark, path)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    names = reader.csv(path).columns
    if not names:
        raise CsvError(f"{path}: no header row")
    if multi_line is None:
        odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
        multi_line = not spark.read.text(path).where(odd).isEmpty()
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(CORRUPT, T.StringType())])
    raw = (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multi_line)
        .option("columnPruning", False)  # else a row is only checked as far as it is used
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("nullValue", "")
        .option("maxCharsPerColumn", MAX_RECORD)
        .csv(path)
    )
    good = _sound(raw, path, policy)
    if policy.kind == "quarantine":
        _quarantine(policy, _broken(raw), ",".join(names))
    cell = {n: F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names}
    try:
        kinds = _climb(good, cell, types or {}) if infer_rows is None else _climb_first(good, cell, types or {}, infer_rows)
    except Exception as e:
        raise malformed_csv(path, e) from e
    cells = good.select(*[cell[n].alias(n) for n in names])
    whole = infer_rows is None and not types  # then every cell is known to fit
    return cells.select(*[(_fitting(n, kinds[n]) if whole else _checked(n, kinds[n], path)).alias(n) for n in names])


def _fitting(name: str, kind: str) -> Column:
    """A cell that fits its column's type, as a value of it."""
    c = F.col(f"`{name}`")
    match kind:
        case "utf8":
            return c
        case "int32" | "int64":
            return c.cast(SPARK[kind])
        case "bool":
            return F.lower(c) == "true"
        case "float64":
            return _quick_float(c)
    return LADDER[kind](c).cast(SPARK[kind])


def _checked(name: str, kind: str, path: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "utf8":
        return c
    bad = F.raise_error(F.concat(F.lit(f"{path}: column {name}: not {kind}: "), c)).cast(SPARK[kind])
    return F.when(c.isNotNull(), F.coalesce(c.try_cast(SPARK[kind]) if kind in ("int32", "int64") else _quick_float(c) if kind == "float64" else LADDER[kind](c).cast(SPARK[kind]), bad))




#: Masks of rungs (1 for bool, 2 for int32, ...) whose cells a column of the type may have.
_ROOM = {"bool": 1, "int32": 2, "int64": 2 | 4, "float64": 2 | 4 | 8, "date": 16, "timestamp": 32}


def _rung(c: Column) -> Column:
    """The mask of the first rung that a cell fits; 64 if it fits none, 0 if it is empty."""
    number = F.when(LADDER["int32"](c).isNotNull(), 2).when(LADDER["int64"](c).isNotNull(), 4).otherwise(8)
    when = F.when(c.isNull(), 0).when(F.lower(c).isin("true", "false"), 1).when(c.rlike(INT), number)
    when = when.when(c.rlike(FLOAT), 8).when(parse_date(c).isNotNull(), 16)
    return when.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]") & parse_timestamp(c).isNotNull(), 32).otherwise(64)


def _climb(good: DataFrame, cell: dict[str, Column], given: dict[str, str]) -> dict[str, str]:
    asked = [n for n in cell if n not in given]
    kinds = dict(given)
    if asked:
        # A lambda's variable stands for a cell, where a plain column would be expanded at each of its many uses.
        rungs = good.select(F.transform(F.array(*[cell[n] for n in asked]), _rung).alias("r"))
        row = rungs.agg(*[F.bit_or(F.get("r", F.lit(i))).alias(f"c{i}") for i in range(len(asked))]).first()
        for i, n in enumerate(asked):
            mask = row[f"c{i}"] or 0
            kinds[n] = next((k for k, room in _ROOM.items() if not mask & ~room), "utf8")
    return kinds


def _is_date(x: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", x)) and bool(date.fromisoformat(x))
    except ValueError:
        return False


def rung_of(x: str) -> int:
    """The mask of the first rung that a cell fits, as :func:`_rung` has it, for the few rows that the driver looks at."""
    if x.lower() in ("true", "false"):
        return 1
    if re.fullmatch(r"[+-]?[0-9]+", x):
        n = int(x)
        return 2 if -(2**31) <= n < 2**31 else 4 if -(2**63) <= n < 2**63 else 8
    if re.search(FLOAT, x):
        return 8
    if _is_date(x):
        return 16
    return 32 if re.search(TIMESTAMP_TEXT, x) and _is_date(x[:10]) else 64


def _rungs(cells: pa.Array) -> int:
    """The masks of all cells together: whole columns at a time, but for what looks like a time."""
    mask = 0
    for pattern, bits in ((r"(?i)^(true|false)$", 1), (INT, None), (FLOAT, 8), (r"^\d{4}-\d{2}-\d{2}", None)):
        fits = pc.match_substring_regex(cells, pattern)
        hit, cells = cells.filter(fits), cells.filter(pc.invert(fits))
        if bits is not None:
            mask |= bits if len(hit) else 0
        elif pattern == INT and len(hit) and pc.max(pc.binary_length(hit)).as_py() < 19:
            ends = pc.min_max(pc.cast(pc.utf8_ltrim(hit, "+"), pa.int64())).as_py()
            mask |= rung_of(str(ends["min"])) | rung_of(str(ends["max"]))
        else:
            for x in hit.unique().to_pylist():
                mask |= rung_of(x)
    return mask | (64 if len(cells) else 0)


def _climb_first(good: DataFrame, cell: dict[str, Column], given: dict[str, str], rows: int) -> dict[str, str]:
    kinds = dict(given)
    asked = [n for n in cell if n not in given]
    found = good.select(*[cell[n].alias(f"c{i}") for i, n in enumerate(asked)]).limit(rows).toArrow()
    for i, n in enumerate(asked):
        mask = _rungs(found.column(i).combine_chunks().drop_null())
        kinds[n] = next((k for k, room in _ROOM.items() if not mask & ~room), "utf8")
    return kinds


def malformed_csv(path: str, error: Exception) -> Exception:
    """The same failure with the record's number (header = 1), found by reading the file again up to it."""
    if "malformed row" not in str(error):
        return error
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        with (gzip.open if local.endswith(".gz") else open)(local, "rt", encoding="utf-8", newline="") as f:
            width = None
            for i, row in enumerate(csv.reader(f), 1):
                width = width or len(row)
                if row and len(row) != width:
                    return CsvError(f"{path}: line {i}: {len(row)} fields, the header has {width}")
    return CsvError(f"{path}: malformed row")


def _narrow(df: DataFrame) -> DataFrame:
    """Long columns whose values all fit are int; nested ones are JSON text. One aggregate if there are long columns."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    small: set[str] = set()
    if longs:
        row = df.agg(*[F.max(F.when(F.col(f"`{n}`").between(-(2**31), 2**31 - 1), 0).when(F.col(f"`{n}`").isNotNull(), 1)).alias(str(i)) for i, n in enumerate(longs)]).first()
        small = {n for i, n in enumerate(longs) if row[str(i)] == 0}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in small:
            c = c.cast("int")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_jsonl(spark: SparkSession, path: str, policy: Policy = Policy()) -> DataFrame:
    """A JSON object on each line; blank lines are passed over. Dates stay text.

    A line of over ``MAX_RECORD`` bytes is a malformed row, and isn't parsed.
    """
    _exists(spark, path)
    found = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    schema = T.StructType([*(f for f in found.schema if f.name != CORRUPT), T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    within = F.octet_length("value") <= MAX_RECORD
    row = F.from_json(F.when(within, F.col("value")).otherwise("{}"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    long = F.col("value") if policy.kind == "quarantine" else F.concat(F.lit(f"a record of over {MAX_RECORD} bytes: "), F.substring("value", 1, 80))
    raw = lines.select(row.alias("row"), F.when(~within, long).alias("long")).select("row.*", "long")
    raw = raw.withColumn(CORRUPT, F.coalesce("long", CORRUPT)).drop("long")
    good = _sound(raw, path, policy)
    if policy.kind == "quarantine":
        _quarantine(policy, _broken(raw), None)
    try:
        return _narrow(good.drop(CORRUPT))
    except Exception as e:
        raise (JsonError(f"{path}: malformed row") if "malformed row" in str(e) else e) from e


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array of objects."""
    _exists(spark, path)
    try:
        return _narrow(spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path))
    except SchemaError:
        raise
    except Exception as e:
        raise JsonError(f"{path}: {str(e).splitlines()[0]}") from e


def read(spark: SparkSession, path: str, policy: Policy = Policy()) -> DataFrame:
    """Any file by its name."""
    match detect(path):
        case "jsonl":
            return read_jsonl(spark, path, policy)
        case "json":
            return read_json(spark, path)
        case "parquet":
            return spark.read.parquet(path)
        case "columnar":
            from .columnar import read_columnar

            return read_columnar(spark, path)
        case "http":
            from .external import read_http

            return read_http(spark, path, policy)
    return read_csv(spark, path, policy)
