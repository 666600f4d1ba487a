"""``python -m millrace``: run, validate, explain, schema-json, init, doctor, convert, diff, sql, schema, preview."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import tools
from .errors import MillraceError
from .plans import spec as specs
from .plans.diff import diff
from .plans.pipeline import Pipeline
from .plans.sql import sql_pipeline
from .sources import files, sinks
from .streaming.telemetry import Metrics


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("millrace", description="Linear pipelines over tables, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline")
    run.add_argument("pipeline")
    run.add_argument("--quiet", action="store_true")
    run.add_argument("--metrics")
    run.add_argument("--metrics-name", default="millrace")
    run.add_argument("--metrics-allow-remote", action="store_true")
    run.add_argument("--manifest")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--watch", action="store_true")
    for name, what in (("validate", "check a pipeline"), ("explain", "show a pipeline's plan")):
        sub.add_parser(name, help=what).add_argument("pipeline")
    sub.add_parser("schema-json", help="JSON Schema of pipelines")
    init = sub.add_parser("init", help="a starter pipeline for a file")
    init.add_argument("input")
    init.add_argument("--out")
    init.add_argument("--rows", type=int, default=1000)
    sub.add_parser("doctor", help="check this machine")
    convert = sub.add_parser("convert", help="convert a file by the names' formats")
    convert.add_argument("input")
    convert.add_argument("output")
    d = sub.add_parser("diff", help="compare two files by key; exit 1 if they differ")
    d.add_argument("before")
    d.add_argument("after")
    d.add_argument("--key", action="append", required=True)
    d.add_argument("--out")
    q = sub.add_parser("sql", help="a SELECT over one file")
    q.add_argument("query")
    q.add_argument("--out")
    q.add_argument("--on-error", default="strict")
    s = sub.add_parser("schema", help="a file's schema; --against: exit 2 if it has drifted")
    s.add_argument("input")
    s.add_argument("--save")
    s.add_argument("--against")
    v = sub.add_parser("preview", help="a file's first rows")
    v.add_argument("input")
    v.add_argument("--rows", type=int, default=10)
    return p


def _load(path: str) -> specs.Spec:
    try:
        return specs.read_spec(Path(path).read_text())
    except OSError as e:
        raise MillraceError(f"{path}: {e}") from e


def _run(a: argparse.Namespace) -> int:
    spec = _load(a.pipeline)
    if a.dry_run:
        print(specs.explain_spec(spec))
        return 0
    metrics = Metrics(a.metrics, a.metrics_name, a.metrics_allow_remote) if a.metrics else None

    def once() -> None:
        stats = tools.run_spec(_load(a.pipeline), a.pipeline, specs.build, a.manifest, metrics)
        if not a.quiet:
            rows = "?" if stats["rows"] is None else stats["rows"]
            print(f"{rows} rows in {stats['batches']} batch(es), {stats['bytes_out']} bytes out, in {stats['elapsed']:.2f}s")

    try:
        if a.watch:
            tools.watch([a.pipeline, *tools.paths(spec)[0]], once)
        else:
            once()
    finally:
        if metrics:
            metrics.close()
    return 0


def _command(a: argparse.Namespace) -> int:
    spark = Pipeline().spark if a.command in ("init", "convert", "diff", "sql", "schema", "preview") else None
    match a.command:
        case "run":
            return _run(a)
        case "validate":
            _load(a.pipeline)
            print("ok")
        case "explain":
            print(specs.explain_spec(_load(a.pipeline)))
        case "schema-json":
            print(json.dumps(specs.json_schema(), indent=2))
        case "init":
            text = tools.starter(spark, a.input, rows=a.rows)
            Path(a.out).write_text(text) if a.out else print(text, end="")
        case "doctor":
            found = tools.doctor()
            for what, well, detail in found:
                print(f"{'ok' if well else 'FAIL'}\t{what}\t{detail}")
            return int(not all(well for _, well, _ in found))
        case "convert":
            tools.convert(spark, a.input, a.output)
        case "diff":
            found = diff(files.read(spark, a.before), files.read(spark, a.after), a.key)
            if a.out:
                sinks.write_csv(found.rows, a.out)
            else:
                print(sinks.to_csv_text(found.rows), end="")
            print(found.text(), file=sys.stderr)
            s = found.summary()
            return int(s["added"] + s["removed"] + s["changed"] > 0)
        case "sql":
            p = sql_pipeline(a.query, spark, on_error=a.on_error)
            if a.out:
                p.write_csv(a.out).execute()
            else:
                print(sinks.to_csv_text(p.to_df()), end="")
        case "schema":
            df = files.read(spark, a.input)
            if a.save:
                print(tools.schema_save(df, a.save))
            elif a.against:
                lines = tools.schema_drift(tools.schema_load(a.against), tools.schema_of(df))
                print("\n".join(lines) or "no drift")
                return 2 if lines else 0
            else:
                print(tools.schema_text(df), end="")
        case "preview":
            print(sinks.to_csv_text(Pipeline(spark).read(a.input).limit(a.rows).to_df()), end="")
    return 0


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return _command(a)
    except MillraceError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
