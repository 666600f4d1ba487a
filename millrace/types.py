"""The eight canonical type names, and the text forms of dates and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

#: Canonical name -> Spark type.
SPARK = {
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "utf8": T.StringType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}
ALIASES = {"int": "int64", "float": "float64", "str": "utf8", "string": "utf8", "boolean": "bool"}
INTS, FLOATS = ("int32", "int64"), ("float32", "float64")
NUMERIC = INTS + FLOATS

DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?(Z+|[+-]\d{2}(:?\d{2})?)?$"


def canonical(name: str) -> str:
    """The canonical form of a type name or alias."""
    low = name.lower()
    low = ALIASES.get(low, low)
    if low not in SPARK:
        raise SchemaError(f"unknown type {name!r}; known: {', '.join([*SPARK, *ALIASES])}")
    return low


def kind_of(dtype: T.DataType) -> str:
    """Canonical name of a Spark type; ``null`` for untyped NULL, ``other`` for what expressions can't handle."""
    match dtype:
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return "int32"
        case T.LongType():
            return "int64"
        case T.FloatType():
            return "float32"
        case T.DoubleType() | T.DecimalType():
            return "float64"
        case T.StringType() | T.VarcharType() | T.CharType():
            return "utf8"
        case T.BooleanType():
            return "bool"
        case T.DateType():
            return "date"
        case T.TimestampType() | T.TimestampNTZType():
            return "timestamp"
        case T.NullType():
            return "null"
    return "other"


def parse_date(text: Column) -> Column:
    """Date of strict ``YYYY-MM-DD`` text, else NULL."""
    return F.when(text.rlike(DATE_TEXT), text.try_cast("date"))


def parse_timestamp(text: Column) -> Column:
    """Timestamp of ISO text, else NULL. Without an offset it is UTC; digits of the fraction beyond six are cut."""
    ok = text.rlike(TIMESTAMP_TEXT)
    body = F.regexp_extract(text, r"^(.{10})[T ](.*?)(Z+|[+-]\d{2}:?\d{2}|[+-]\d{2})?$", 2)
    padded = F.when(body.rlike(r"^\d{2}$"), F.concat(body, F.lit(":00:00"))).when(body.rlike(r"^\d{2}:\d{2}$"), F.concat(body, F.lit(":00"))).otherwise(body)
    clock = F.regexp_replace(padded, r"(\.\d{6})\d+$", "$1")
    offset = F.regexp_replace(F.regexp_extract(text, r"(Z+|[+-]\d{2}:?\d{2}|[+-]\d{2})$", 1), r"^Z*$", "+00:00")
    offset = F.regexp_replace(F.regexp_replace(offset, r"^([+-]\d{2})$", "$1:00"), r"^([+-]\d{2})(\d{2})$", "$1:$2")
    # The date's own "-DD" isn't an offset: the pattern above needs a clock before it.
    return F.when(ok, F.concat(F.substring(text, 1, 10), F.lit(" "), clock, offset).try_cast("timestamp"))


def show_timestamp(ts: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.ffffff]Z``: no fraction if it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))
