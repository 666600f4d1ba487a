"""Exceptions. ``code`` is a stable name that callers can switch on."""

from __future__ import annotations


class MillraceError(Exception):
    code = "other"


class IoError(MillraceError):
    code = "io"


class CsvError(MillraceError):
    code = "csv"


class JsonError(MillraceError):
    code = "json"


class SchemaError(MillraceError):
    code = "schema"


class ColumnarError(MillraceError):
    code = "columnar"


class ConfigError(MillraceError):
    code = "config"


class DatabaseError(MillraceError):
    code = "database"


class CloudError(MillraceError):
    code = "cloud"


class DataQualityError(MillraceError):
    code = "data_quality"


class ExpressionError(ConfigError):
    """An expression that can't be read or makes no sense for the columns at hand."""

    code = "expression"


class TooComplex(ExpressionError):
    code = "too_complex"


class UnsupportedStreaming(ConfigError):
    code = "unsupported_streaming"


def missing_column(what: str, name: str, columns: list[str]) -> SchemaError:
    return SchemaError(f"{what}: column {name!r} not found; available: {', '.join(columns)}")
