"""Pipelines as TOML: one table of rules reads, checks, explains and documents them."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import ConfigError, ExpressionError, MillraceError
from ..functions.syntax import columns_of, parse
from ..operators.stages import AGGREGATES, JOINS, AggSpec
from ..sources.files import Policy
from ..types import canonical
from .pipeline import Pipeline

TEXT, WHOLE, NUMBER, FLAG, TEXTS, TABLE = "string", "integer", "number", "boolean", "array of strings", "table"


@dataclass(frozen=True)
class Kind:
    """Fields of a single-key table: name -> (type, required). ``short``: the field that a bare value stands for."""

    fields: dict[str, tuple[str, bool]] = field(default_factory=dict)
    short: str | None = None


def _fields(required: str, optional: str = "") -> dict[str, tuple[str, bool]]:
    return {n: (t, need) for text, need in ((required, True), (optional, False)) for n, t in (x.split(":") for x in text.split())}


def _kind(required: str, optional: str = "", short: str | None = None) -> Kind:
    names = {"s": TEXT, "i": WHOLE, "n": NUMBER, "b": FLAG, "l": TEXTS, "t": TABLE}
    return Kind({n: (names[t], need) for n, (t, need) in _fields(required, optional).items()}, short)


SOURCES = {
    "csv": _kind("path:s", "chunk_rows:i"),
    "jsonl": _kind("path:s", "chunk_rows:i"),
    "json": _kind("path:s", "chunk_rows:i"),
    "columnar": _kind("path:s", "chunk_rows:i", "path"),
    "parquet": _kind("path:s", "", "path"),
    "http": _kind("path:s", "chunk_rows:i", "path"),
    "sqlite": _kind("path:s query:s", "chunk_rows:i"),
    "postgres": _kind("connection:s query:s"),
    "s3": _kind("bucket_url:s key:s"),
    "gcs": _kind("bucket:s key:s"),
    "azure": _kind("account_url:s container:s key:s"),
}
SINKS = {
    "csv": _kind("path:s", "chunk_rows:i", "path"),
    "jsonl": _kind("path:s", "chunk_rows:i", "path"),
    "json": _kind("path:s", "pretty:b"),
    "columnar": _kind("path:s", "use_zstd:b"),
    "parquet": _kind("path:s", "", "path"),
    "sqlite": _kind("path:s table:s"),
    "postgres": _kind("connection:s table:s"),
    "s3": SOURCES["s3"],
    "gcs": SOURCES["gcs"],
    "azure": SOURCES["azure"],
}
STAGES = {
    "filter": Kind({"expr": (TEXT, True)}, "expr"),
    "map": Kind({"columns": (TABLE, True)}, "columns"),
    "select": Kind({"columns": (TEXTS, True)}, "columns"),
    "limit": Kind({"n": (WHOLE, True)}, "n"),
    "dedup": Kind({"columns": (TEXTS, True)}, "columns"),
    "aggregate": _kind("group_by:l", "aggs:t"),
    "sort": _kind("columns:l", "descending:b"),
    "join": _kind("right:s left_keys:l right_keys:l type:s"),
    "expect": _kind("", "rows_at_least:i rows_at_most:i no_nulls:l unique:l ranges:t one_of:t types:t"),
    "sample": _kind("fraction:n key:l", "seed:i"),
}
TOP = ("source", "stages", "error_policy", "dead_letter", "sink")
STATEFUL = ("aggregate", "sort", "dedup", "join", "expect")
#: Stages whose field is the value itself.
BARE = ("filter", "map", "select", "limit", "dedup")


@dataclass
class Spec:
    text: str
    source: tuple[str, dict]
    stages: list[tuple[str, object]]
    sink: tuple[str, dict] | None
    error_policy: str | None = None
    dead_letter: str | None = None


def substitute(value, env: Mapping[str, str]):
    """``${NAME}`` and ``${NAME:-default}`` in texts, ``$${`` for ``${``; keys are left alone."""
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[0] == "$${":
            return "${"
        name, has, default = m[1], m[2], m[3]
        if name in env:
            return env[name]
        if has:
            return default
        raise ConfigError(f"environment variable {name} is not set")

    return re.sub(r"\$\$\{|\$\{([A-Za-z_][A-Za-z0-9_]*)(:-)?((?<=:-)[^}]*)?\}", one, value)


def distance(a: str, b: str) -> int:
    """Edits, a swap of neighbours being one, from ``a`` to ``b``."""
    rows: list[list[int]] = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def hint(name: str, known) -> str:
    near = sorted((distance(name, k), k) for k in known)
    return f"; did you mean {near[0][1]!r}?" if near and near[0][0] <= max(1, min(3, len(name) // 3)) else ""


class _Reader:
    def __init__(self, text: str) -> None:
        self.text = text

    def where(self, name: str, stage: int | None = None) -> str:
        """``line L, column C: `` of a key, searched from its stage's header on."""
        start = 0
        if stage is not None:
            heads = [m.start() for m in re.finditer(r"^\s*\[\[\s*stages\s*\]\]", self.text, re.M)]
            start = heads[stage] if stage < len(heads) else 0
        m = re.compile(rf"(?<![\w-]){re.escape(name)}(?![\w-])").search(self.text, start)
        at = m.start() if m else start
        line, column = self.text.count("\n", 0, at) + 1, at - (self.text.rfind("\n", 0, at) + 1) + 1
        return f"line {line}, column {column}: " + (f"stage #{stage + 1}: " if stage is not None else "")

    def fail(self, why: str, name: str, stage: int | None = None) -> ConfigError:
        return ConfigError(self.where(name, stage) + why)

    def single(self, what: str, value, kinds: dict[str, Kind], stage: int | None = None) -> tuple[str, object]:
        if not isinstance(value, dict) or len(value) != 1:
            raise self.fail(f"{what} is a table with one key, one of {', '.join(kinds)}", what if stage is None else "stages", stage)
        (name, inner), *_ = value.items()
        if name not in kinds:
            raise self.fail(f"unknown {what} {name!r}{hint(name, kinds)}; known: {', '.join(kinds)}", name, stage)
        kind = kinds[name]
        if kind.short and (name in BARE or not isinstance(inner, dict)):
            inner = {kind.short: inner}
        if not isinstance(inner, dict):
            raise self.fail(f"{what} {name}: expected a table", name, stage)
        for k, v in inner.items():
            if k not in kind.fields:
                raise self.fail(f"{what} {name}: unknown field {k!r}{hint(k, kind.fields)}", k, stage)
            if not _fits(v, kind.fields[k][0]):
                raise self.fail(f"{what} {name}: {k} must be {kind.fields[k][0]}", k, stage)
        for k, (_, need) in kind.fields.items():
            if need and k not in inner:
                raise self.fail(f"{what} {name}: field {k!r} is missing", name, stage)
        return name, inner[kind.short] if name in BARE and kinds is STAGES else inner


def _fits(v, kind: str) -> bool:
    match kind:
        case "string":
            return isinstance(v, str)
        case "integer":
            return isinstance(v, int) and not isinstance(v, bool) and v >= 0
        case "number":
            return isinstance(v, (int, float)) and not isinstance(v, bool)
        case "boolean":
            return isinstance(v, bool)
        case "table":
            return isinstance(v, dict)
    return isinstance(v, list) and all(isinstance(x, str) for x in v)


def read_spec(text: str, env: Mapping[str, str] | None = None) -> Spec:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"\(at line (\d+), column (\d+)\)", str(e))
        raise ConfigError(f"line {m[1]}, column {m[2]}: {str(e)[: m.start()].strip()}" if m else str(e)) from e
    reader = _Reader(text)
    for k in raw:
        if k not in TOP:
            raise reader.fail(f"unknown key {k!r}{hint(k, TOP)}", k)
    if "source" not in raw:
        raise ConfigError("line 1, column 1: source is missing")
    raw = substitute(raw, os.environ if env is None else env)
    source = reader.single("source", raw["source"], SOURCES)
    if not isinstance(raw.get("stages", []), list):
        raise reader.fail("stages is an array of tables", "stages")
    found = [reader.single("stage", s, STAGES, i) for i, s in enumerate(raw.get("stages", []))]
    sink = reader.single("sink", raw["sink"], SINKS) if "sink" in raw else None
    for k in ("error_policy", "dead_letter"):
        if k in raw and not isinstance(raw[k], str):
            raise reader.fail(f"{k} must be string", k)
    spec = Spec(text, source, found, sink, raw.get("error_policy"), raw.get("dead_letter"))
    check_spec(spec, reader)
    return spec


def check_spec(spec: Spec, reader: _Reader | None = None) -> None:
    """What can be known without data."""
    reader = reader or _Reader(spec.text)
    if spec.error_policy is not None:
        try:
            Policy.parse(spec.error_policy)
        except ConfigError as e:
            raise reader.fail(str(e), "error_policy") from e
    for i, (name, v) in enumerate(spec.stages):

        def bad(why: str, at: str = name, stage: int = i) -> ConfigError:
            return reader.fail(f"{at}: {why}", at, stage)

        if spec.dead_letter is not None and name in STATEFUL:
            raise bad("can't be combined with dead_letter, since it keeps state across rows")
        try:
            for x in [v] if name == "filter" else v.values() if name == "map" else []:
                if not isinstance(x, str):
                    raise bad("expressions are strings")
                parse(x)
        except ExpressionError as e:
            raise bad(str(e)) from e
        match name:
            case "map" if not v:
                raise bad("at least one column")
            case "select" | "sort" if not (v if name == "select" else v["columns"]):
                raise bad("at least one column")
            case "aggregate":
                for c, f in v.get("aggs", {}).items():
                    if f not in (*AGGREGATES, "count_all"):
                        raise bad(f"unknown aggregate function {f!r}{hint(str(f), (*AGGREGATES, 'count_all'))} for {c!r}")
                if not v["group_by"] and not v.get("aggs"):
                    raise bad("neither keys nor aggregates")
            case "join":
                if v["type"] not in JOINS:
                    raise bad(f"unknown type {v['type']!r}{hint(v['type'], JOINS)}; known: {', '.join(JOINS)}")
                if not v["left_keys"] or len(v["left_keys"]) != len(v["right_keys"]):
                    raise bad("as many right_keys as left_keys, and at least one")
            case "sample":
                if not 0 <= v["fraction"] <= 1:
                    raise bad("fraction must lie between 0 and 1")
                if not v["key"]:
                    raise bad("at least one key column")
            case "expect":
                if not v:
                    raise bad("at least one check")
                for t in v.get("types", {}).values():
                    try:
                        canonical(str(t))
                    except MillraceError as e:
                        raise bad(str(e)) from e
                for c, r in v.get("ranges", {}).items():
                    if not isinstance(r, dict) or set(r) - {"min", "max"}:
                        raise bad(f"range of {c!r} has min and max only")


def agg_specs(aggs: Mapping[str, str]) -> list[AggSpec]:
    """Sorted by column, as the spec's tables are. ``"*" = "count_all"`` is ``count_all``, ``x = "count_all"`` is ``count_x``."""
    return [AggSpec("count_all", None, "count_all" if c in ("*", "") else f"count_{c}") if f == "count_all" else AggSpec(f, c) for c, f in sorted(aggs.items())]


def build(spec: Spec, spark: SparkSession | None = None) -> Pipeline:
    p = Pipeline(spark)
    if spec.error_policy:
        p.on_error(spec.error_policy)
    if spec.dead_letter:
        p.dead_letter(spec.dead_letter)
    name, s = spec.source
    match name:
        case "sqlite":
            p.read_sqlite(s["path"], s["query"])
        case "postgres":
            p.read_postgres(s["connection"], s["query"])
        case "s3":
            p.read_s3(s["bucket_url"], s["key"])
        case "gcs":
            p.read_gcs(s["bucket"], s["key"])
        case "azure":
            p.read_azure(_azure(s), s["key"])
        case _:
            getattr(p, f"read_{name}")(s["path"])
    for name, v in spec.stages:
        match name:
            case "map":
                p.map(dict(sorted(v.items())))
            case "aggregate":
                p.aggregate(v["group_by"], agg_specs(v.get("aggs", {})))
            case "sort":
                p.sort(v["columns"], v.get("descending", False))
            case "join":
                p.join(v["right"], v["left_keys"], v["right_keys"], v["type"])
            case "expect":
                ranges = {c: (r.get("min"), r.get("max")) for c, r in v.get("ranges", {}).items()}
                p.expect(**(v | ({"ranges": ranges} if ranges else {})))
            case "sample":
                p.sample(v["fraction"], v["key"], v.get("seed", 0))
            case _:
                getattr(p, name)(v)
    if spec.sink:
        name, s = spec.sink
        match name:
            case "json":
                p.write_json(s["path"], s.get("pretty", False))
            case "columnar":
                p.write_columnar(s["path"], s.get("use_zstd", False))
            case "sqlite":
                p.write_sqlite(s["path"], s["table"])
            case "postgres":
                p.write_postgres(s["connection"], s["table"])
            case "s3":
                p.write_s3(s["bucket_url"], s["key"])
            case "gcs":
                p.write_gcs(s["bucket"], s["key"])
            case "azure":
                p.write_azure(_azure(s), s["key"])
            case _:
                getattr(p, f"write_{name}")(s["path"])
    return p


def _azure(s: dict) -> str:
    account = re.sub(r"^https?://", "", s["account_url"]).split(".")[0].strip("/")
    return f"{account}/{s['container']}"


def explain_spec(spec: Spec) -> str:
    """A numbered plan."""

    def show(v) -> str:
        return v if isinstance(v, str) else json.dumps(v, sort_keys=True)

    lines = [f"source: {spec.source[0]} {show({k: v for k, v in spec.source[1].items() if k != 'connection'})}"]
    for i, (name, v) in enumerate(spec.stages, 1):
        reads = ""
        if name in ("filter", "map"):
            columns = set().union(*(columns_of(parse(x)) for x in ([v] if name == "filter" else v.values())))
            reads = f"  (reads {', '.join(sorted(columns))})" if columns else ""
        lines.append(f"{i}. {name}: {show(v)}{reads}")
    lines.append(f"sink: {spec.sink[0]} {show({k: v for k, v in spec.sink[1].items() if k != 'connection'})}" if spec.sink else "sink: none")
    if spec.error_policy:
        lines.append(f"error policy: {spec.error_policy}")
    if spec.dead_letter:
        lines.append(f"dead letters: {spec.dead_letter}")
    return "\n".join(lines)


def json_schema() -> dict:
    """JSON Schema of the spec, from the same rules."""
    types = {
        TEXT: {"type": "string"}, WHOLE: {"type": "integer", "minimum": 0}, NUMBER: {"type": "number"}, FLAG: {"type": "boolean"},
        TEXTS: {"type": "array", "items": {"type": "string"}}, TABLE: {"type": "object"},
    }

    def one(name: str, kind: Kind, bare: bool) -> dict:
        if bare:
            inner = types[kind.fields[kind.short][0]]
        else:
            inner = {"type": "object", "additionalProperties": False, "properties": {n: types[t] for n, (t, _) in kind.fields.items()}, "required": [n for n, (_, need) in kind.fields.items() if need]}
            inner = {"anyOf": [types[kind.fields[kind.short][0]], inner]} if kind.short else inner
        return {"type": "object", "additionalProperties": False, "properties": {name: inner}, "required": [name]}

    def any_of(kinds: dict[str, Kind], stages: bool = False) -> dict:
        return {"oneOf": [one(n, k, stages and n in BARE) for n, k in kinds.items()]}

    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "title": "millrace pipeline",
        "type": "object",
        "additionalProperties": False,
        "required": ["source"],
        "properties": {"source": any_of(SOURCES), "stages": {"type": "array", "items": any_of(STAGES, True)}, "sink": any_of(SINKS), "error_policy": types[TEXT], "dead_letter": types[TEXT]},
    }

