"""Schema files and drift, conversion, starter specs, provenance manifests, checks of the machine, watching."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, MillraceError
from .plans.pipeline import Pipeline
from .plans.spec import Spec
from .sources import files
from .types import kind_of

SCHEMA_VERSION = MANIFEST_VERSION = 1


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) with ``string`` for utf8, as people write it."""
    kinds = [(f.name, kind_of(f.dataType)) for f in df.schema]
    return [(n, "string" if k == "utf8" else k) for n, k in kinds]


def schema_text(df: DataFrame) -> str:
    return "".join(f"{n}\t{t}\n" for n, t in schema_of(df))


def schema_save(df: DataFrame, path: str) -> str:
    columns = schema_of(df)
    Path(path).write_text(json.dumps({"version": SCHEMA_VERSION, "columns": [{"name": n, "type": t} for n, t in columns]}, indent=2) + "\n")
    return f"saved {len(columns)} column(s) to {path}"


def schema_load(path: str) -> list[tuple[str, str]]:
    try:
        raw = json.loads(Path(path).read_text())
        if raw["version"] != SCHEMA_VERSION:
            raise ConfigError(f"{path}: version {raw['version']} is unknown")
        return [(c["name"], c["type"]) for c in raw["columns"]]
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise ConfigError(f"{path}: not a schema file: {e}") from e


def schema_drift(saved: list[tuple[str, str]], now: list[tuple[str, str]]) -> list[str]:
    """Lines: removed, added, type changed, order changed; none if nothing has."""
    before, after = dict(saved), dict(now)
    lines = [f"removed column: {n} ({t})" for n, t in saved if n not in after]
    lines += [f"added column: {n} ({t})" for n, t in now if n not in before]
    lines += [f"type changed: {n}: {t} -> {after[n]}" for n, t in saved if n in after and after[n] != t]
    common_before, common_after = [n for n, _ in saved if n in after], [n for n, _ in now if n in before]
    if common_before != common_after:
        lines.append(f"order changed: {', '.join(common_before)} -> {', '.join(common_after)}")
    return lines


def convert(spark: SparkSession, source: str, target: str) -> dict:
    return Pipeline(spark).read(source).write(target).execute()


def starter(spark: SparkSession, source: str, sink: str = "out.csv", rows: int = 1000) -> str:
    """A spec for a file: its columns, and checks that its first ``rows`` rows pass."""
    df = files.read(spark, source).limit(rows)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)],
        *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)],
    ).first()
    full = [c for i, c in enumerate(df.columns) if row["n"] and row[f"c{i}"] == row["n"]]
    unique = [c for i, c in enumerate(df.columns) if c in full and row[f"d{i}"] == row["n"]]
    kind = files.detect(source)
    lines = [f"# {n}: {t}" for n, t in schema_of(df)]
    lines += ["", f"[source.{kind}]", f"path = {json.dumps(source)}", "", "[[stages]]", f"select = {json.dumps(df.columns)}", "", "[[stages]]"]
    checks = ["rows_at_least = 1"] + ([f"no_nulls = {json.dumps(full)}"] if full else []) + ([f"unique = {json.dumps(unique)}"] if unique else [])
    return "\n".join([*lines, f"expect = {{ {', '.join(checks)} }}", "", "[sink.csv]", f"path = {json.dumps(sink)}", ""])


def doctor() -> list[tuple[str, bool, str]]:
    """(what, whether it is well, detail)."""
    import platform

    import pyarrow
    import pyspark

    java = shutil.which("java") or (os.path.join(os.environ["JAVA_HOME"], "bin", "java") if "JAVA_HOME" in os.environ else None)
    found = [("python", True, platform.python_version()), ("pyspark", True, pyspark.__version__), ("pyarrow", True, pyarrow.__version__), ("java", java is not None, java or "not found")]
    try:
        with tempfile.NamedTemporaryFile():
            found.append(("temporary folder", True, tempfile.gettempdir()))
    except OSError as e:
        found.append(("temporary folder", False, str(e)))
    free = shutil.disk_usage(tempfile.gettempdir()).free
    return [*found, ("free disk", free > 1 << 30, f"{free >> 20} MB")]


def digest(path: str) -> dict:
    """Path, bytes and SHA-256 of a file (of all files of a folder, by name); nulls for what isn't a local file."""
    local = path.removeprefix("file://")
    h, size = hashlib.sha256(), 0
    if not os.path.exists(local):
        return {"path": path, "bytes": None, "sha256": None}
    every = sorted(str(p) for p in Path(local).rglob("*") if p.is_file()) if os.path.isdir(local) else [local]
    for p in every:
        with open(p, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
                size += len(block)
    return {"path": path, "bytes": size, "sha256": h.hexdigest()}


def paths(spec: Spec) -> tuple[list[str], list[str]]:
    """Files that a spec reads and writes."""
    reads = [spec.source[1]["path"]] if "path" in spec.source[1] else []
    reads += [v["right"] for n, v in spec.stages if n == "join"]
    return reads, [spec.sink[1]["path"]] if spec.sink and "path" in spec.sink[1] else []


def manifest(path: str, spec: Spec, begun: float, inputs: list[dict], stats: dict | None, stages: list, dead_rows: int, error: str | None) -> dict:
    when = lambda t: datetime.fromtimestamp(int(t), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    from . import __version__

    return {
        "manifest_version": MANIFEST_VERSION,
        "tool": "millrace",
        "tool_version": __version__,
        "status": "failed" if error else "ok",
        "error": error,
        "started_at": when(begun),
        "finished_at": when(time.time()),
        "pipeline": path,
        "spec_sha256": hashlib.sha256(spec.text.encode()).hexdigest(),
        "inputs": inputs,
        "outputs": [] if error else [digest(p) for p in paths(spec)[1]],
        "stats": stats and {k: stats[k] for k in ("rows", "batches", "bytes_in", "bytes_out")} | {"elapsed_ms": int(stats["elapsed"] * 1000)},
        "stages": [{"index": i, "name": s.name, "rows_in": s.rows_in, "rows_out": s.rows_out, "batches": s.batches, "elapsed_ms": int(s.elapsed * 1000)} for i, s in enumerate(stages, 1)],
        "dead_letter_rows": dead_rows,
    }


def run_spec(spec: Spec, path: str, build: Callable[[Spec], Pipeline], manifest_path: str | None = None, metrics=None) -> dict:
    """Run, and leave a manifest also if the run fails."""
    begun, inputs = time.time(), [digest(p) for p in paths(spec)[0]] if manifest_path else []
    p, stats, error = None, None, None
    try:
        p = build(spec)
        if manifest_path or metrics:
            p.telemetry()
        if metrics:
            p.on_progress(metrics)
        stats = p.execute()
        return stats
    except Exception as e:
        error = str(e)
        raise
    finally:
        dead = p.dead_letter_rows() if p else 0
        if metrics:
            metrics.finish(dead)
        if manifest_path:
            made = manifest(path, spec, begun, inputs, stats, p.stage_stats() if p else [], dead, error)
            Path(manifest_path).write_text(json.dumps(made, indent=2) + "\n")


def watch(paths_: list[str], action: Callable[[], object], every: float = 0.5, rounds: int | None = None) -> int:
    """Call ``action`` now, and again whenever a file's time or size changes; how often it was called."""

    def state() -> list:
        return [(p, os.stat(p).st_mtime_ns, os.stat(p).st_size) if os.path.exists(p) else (p, None, None) for p in paths_]

    calls, last = 0, None
    while rounds is None or rounds > 0:
        now = state()
        if now != last:
            last, calls = now, calls + 1
            try:
                action()
            except MillraceError as e:
                print(f"error: {e}")
        time.sleep(every)
        rounds = None if rounds is None else rounds - 1
    return calls
