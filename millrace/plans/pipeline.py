"""The fluent pipeline: a source, stages and a sink, compiled to one DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, DataQualityError, IoError, JsonError, MillraceError
from ..operators import closures, stages
from ..operators.quality import Check, HasType, NoNulls, OneOf, Range, RowsAtLeast, RowsAtMost, Unique
from ..sources import columnar, external, files, sinks
from ..streaming.telemetry import Event, StageStats, notify


def default_session() -> SparkSession:
    found = SparkSession.getActiveSession()
    return found or SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def with_row_ids(df: DataFrame, text: bool) -> stages.Flow:
    """``df`` with hidden columns that say where in the source each row stands."""
    h = stages.HIDDEN
    if text:
        where = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    else:
        where = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    for columns in (where, [F.monotonically_increasing_id()]):
        named = [c.alias(f"{h}r{i}") for i, c in enumerate(columns)]
        try:
            found = df.select("*", *named)
            found.schema  # noqa: B018  analysed here
        except Exception:
            continue
        return stages.Flow(found, tuple(stages.Order(f"{h}r{i}") for i in range(len(named))))
    raise MillraceError("rows can't be numbered")


class Pipeline:
    """``Pipeline().read_csv(p).filter("a > 1").group_by(["k"]).agg({"a": "sum"}).write_csv(q).execute()``.

    Methods add to the pipeline and return it. Nothing is read before a result is asked for, but for what a schema needs
    and the passes that ``expect`` makes. A pipeline can be run again.
    """

    def __init__(self, spark: SparkSession | None = None, strict_columns: bool = False) -> None:
        self._session, self._strict_columns = spark, strict_columns
        self._source: tuple[str, Callable[[], DataFrame], bool] | None = None
        self._stages: list[stages.Stage] = []
        self._sink: tuple[str, Callable[[DataFrame], int | None]] | None = None
        self._policy, self._retry = files.Policy(), external.RetryPolicy()
        self._dead_path: str | None = None
        self._dead_rows = 0
        self._progress: Callable[[Event], None] | None = None
        self._telemetry: bool | None = None
        self._stats: list[StageStats] = []
        self._keys: list[str] | None = None

    @property
    def spark(self) -> SparkSession:
        self._session = self._session or default_session()
        return self._session

    # Sources. ``text`` marks those without a row index of their own.

    def _from(self, name: str, read: Callable[[], DataFrame], text: bool = True) -> Pipeline:
        self._source = (name, read, text)
        return self

    def read_csv(self, path: str, chunk_size: int | None = None, multi_line: bool | None = None, infer_rows: int | None = None, types: Mapping[str, str] | None = None) -> Pipeline:
        """``chunk_size`` is taken for the sake of callers that give it; Spark sizes its own tasks. ``infer_rows``: types
        come from so many first rows, and a later cell that doesn't fit is an error; ``types`` gives them outright."""
        policy = self._policy
        return self._from("csv", lambda: files.read_csv(self.spark, path, policy, multi_line, infer_rows, dict(types or {})))

    def read_jsonl(self, path: str) -> Pipeline:
        policy = self._policy
        return self._from("jsonl", lambda: files.read_jsonl(self.spark, path, policy))

    def read_json(self, path: str) -> Pipeline:
        return self._from("json", lambda: files.read_json(self.spark, path))

    def read_columnar(self, path: str) -> Pipeline:
        return self._from("columnar", lambda: columnar.read_columnar(self.spark, path))

    def read_parquet(self, path: str) -> Pipeline:
        return self._from("parquet", lambda: self.spark.read.parquet(path), text=False)

    def read_sqlite(self, path: str, query: str) -> Pipeline:
        return self._from("sqlite", lambda: external.read_sqlite(self.spark, path, query))

    def read_postgres(self, conn: str, query: str) -> Pipeline:
        return self._from("postgres", lambda: external.read_postgres(self.spark, conn, query))

    def read_http(self, url: str) -> Pipeline:
        policy = self._policy
        return self._from("http", lambda: external.read_http(self.spark, url, policy, self._retry))

    def _store(self, store: str, container: str, key: str) -> Pipeline:
        uri, policy = external.object_uri(store, container, key), self._policy
        return self._from(store, lambda: files.read(self.spark, uri, policy))

    def read_s3(self, bucket: str, key: str) -> Pipeline:
        return self._store("s3", bucket, key)

    def read_gcs(self, bucket: str, key: str) -> Pipeline:
        return self._store("gcs", bucket, key)

    def read_azure(self, container: str, key: str) -> Pipeline:
        return self._store("azure", container, key)

    def read(self, path: str) -> Pipeline:
        """Any file, by its name's format."""
        policy = self._policy
        return self._from(files.detect(path), lambda: files.read(self.spark, path, policy), files.detect(path) != "parquet")

    def from_df(self, df: DataFrame) -> Pipeline:
        self._session = self._session or df.sparkSession
        return self._from("memory", lambda: df, text=False)

    source = from_df

    def from_rows(self, rows: Sequence, schema: str) -> Pipeline:
        return self._from("memory", lambda: self.spark.createDataFrame(rows, schema))

    # Stages.

    def stage(self, stage: stages.Stage) -> Pipeline:
        if self._keys is not None:
            raise ConfigError("group_by: agg must follow")
        self._stages.append(stage)
        return self

    def filter(self, condition: str | Column | Callable[[DataFrame], Column]) -> Pipeline:
        if isinstance(condition, str):
            stages.parse(condition)
        return self.stage(stages.Filter(condition))

    def filter_fn(self, function: Callable[[dict], bool]) -> Pipeline:
        return self.stage(closures.FilterRows(function))

    def map(self, columns: Mapping[str, str | Column]) -> Pipeline:
        for x in columns.values():
            if isinstance(x, str):
                stages.parse(x)
        return self.stage(stages.Map(tuple(columns.items())))

    def map_fn(self, columns: Mapping[str, str], function: Callable[[dict], object]) -> Pipeline:
        return self.stage(closures.MapRows(tuple(columns.items()), function))

    def select(self, columns: Sequence[str]) -> Pipeline:
        return self.stage(stages.Select(tuple(columns)))

    def drop(self, columns: Sequence[str]) -> Pipeline:
        return self.stage(stages.Drop(tuple(columns)))

    def limit(self, n: int) -> Pipeline:
        return self.stage(stages.Limit(n))

    def sort(self, columns: Sequence[str], descending: bool | Sequence[bool] = False) -> Pipeline:
        down = (descending,) * len(columns) if isinstance(descending, bool) else tuple(descending)
        if len(down) != len(columns):
            raise ConfigError("sort: as many directions as columns")
        return self.stage(stages.Sort(tuple(columns), down))

    def dedup(self, columns: Sequence[str] = ()) -> Pipeline:
        return self.stage(stages.Dedup(tuple(columns)))

    def group_by(self, keys: Sequence[str]) -> Pipeline:
        self._keys = list(keys)
        return self

    def agg(self, specs: Mapping[str, str] | Sequence[stages.AggSpec]) -> Pipeline:
        """``{"column": "function"}``, with the output name ``function_column``; ``{"name": "count_all"}`` names its own."""
        keys, self._keys = self._keys or [], None
        if isinstance(specs, Mapping):
            specs = [stages.AggSpec("count_all", None, c if c != "*" else None) if f == "count_all" else stages.AggSpec(f, c) for c, f in specs.items()]
        return self.stage(stages.Aggregate(tuple(keys), tuple(specs)))

    def aggregate(self, keys: Sequence[str], specs: Sequence[stages.AggSpec]) -> Pipeline:
        return self.stage(stages.Aggregate(tuple(keys), tuple(specs)))

    def join(self, right: DataFrame | Pipeline | str, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", strict_nulls: bool = False) -> Pipeline:
        """``right``: a DataFrame, another pipeline, or the path of a file of any format."""
        if isinstance(right, Pipeline):
            make = right.to_df
        elif isinstance(right, str):
            make = lambda: files.read(self.spark, right, self._policy)
        else:
            make = lambda: right
        return self.stage(stages.Join(make, tuple(left_keys), tuple(right_keys), how, strict_nulls))

    def join_csv(self, right: str, left_keys: Sequence[str], right_keys: Sequence[str], join_type: str = "inner") -> Pipeline:
        make = lambda: files.read_csv(self.spark, right, self._policy)
        return self.stage(stages.Join(make, tuple(left_keys), tuple(right_keys), join_type))

    def sample(self, fraction: float, key: str | Sequence[str], seed: int = 0) -> Pipeline:
        if not 0 <= fraction <= 1:
            raise ConfigError("sample: fraction must lie between 0 and 1")
        return self.stage(stages.Sample(fraction, (key,) if isinstance(key, str) else tuple(key), seed))

    def expect(
        self,
        *checks: Check,
        rows_at_least: int | None = None,
        rows_at_most: int | None = None,
        no_nulls: Sequence[str] = (),
        unique: Sequence[str] = (),
        ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
        one_of: Mapping[str, Sequence] | None = None,
        types: Mapping[str, str] | None = None,
    ) -> Pipeline:
        every = list(checks)
        every += [RowsAtLeast(rows_at_least)] if rows_at_least is not None else []
        every += [RowsAtMost(rows_at_most)] if rows_at_most is not None else []
        every += [NoNulls(c) for c in no_nulls] + [Unique(c) for c in unique]
        every += [Range(c, a, b) for c, (a, b) in (ranges or {}).items()]
        every += [OneOf(c, tuple(v)) for c, v in (one_of or {}).items()] + [HasType(c, t) for c, t in (types or {}).items()]
        if not every:
            raise ConfigError("expect: at least one check")
        return self.stage(stages.Expect(tuple(every)))

    def transform(self, function: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return self.stage(stages.Custom(function))

    # Settings.

    def on_error(self, policy: str) -> Pipeline:
        """For sources that are added after it: ``strict``, ``skip`` or ``quarantine:<path>``."""
        self._policy = files.Policy.parse(policy)
        return self

    def dead_letter(self, path: str) -> Pipeline:
        """Rows on which a closure fails go to a CSV file; the others go on."""
        self._dead_path = path
        return self

    def dead_letter_rows(self) -> int:
        return self._dead_rows

    def with_retry(self, attempts: int, base_delay_ms: int = 200, max_delay_ms: int = 10_000) -> Pipeline:
        self._retry = external.RetryPolicy(attempts, base_delay_ms, max_delay_ms)
        return self

    def on_progress(self, callback: Callable[[Event], None]) -> Pipeline:
        self._progress = callback
        return self

    def telemetry(self, on: bool = True) -> Pipeline:
        """Count the rows of every stage as the pipeline runs. Counting keeps filters from being pushed into the scan, so
        it is off for Parquet and DataFrames unless asked for, here or by a progress hook."""
        self._telemetry = on
        return self

    def stage_stats(self) -> list[StageStats]:
        return list(self._stats)

    # Sinks.

    def _to(self, name: str, write: Callable[[DataFrame], int | None]) -> Pipeline:
        self._sink = (name, write)
        return self

    def write_csv(self, path: str, single: bool = True) -> Pipeline:
        return self._to("csv", lambda df: sinks.write_csv(df, path, single))

    def write_jsonl(self, path: str, single: bool = True) -> Pipeline:
        return self._to("jsonl", lambda df: sinks.write_jsonl(df, path, single))

    def write_json(self, path: str, pretty: bool = False) -> Pipeline:
        return self._to("json", lambda df: sinks.write_json(df, path, pretty))

    def write_columnar(self, path: str, use_zstd: bool = True) -> Pipeline:
        return self._to("columnar", lambda df: columnar.write_columnar(df, path, use_zstd))

    def write_parquet(self, path: str) -> Pipeline:
        return self._to("parquet", lambda df: sinks.write_parquet(df, path))

    def write_sqlite(self, path: str, table: str) -> Pipeline:
        return self._to("sqlite", lambda df: external.write_sqlite(df, path, table) and 0)

    def write_postgres(self, conn: str, table: str, overwrite: bool = False) -> Pipeline:
        return self._to("postgres", lambda df: external.write_postgres(df, conn, table, overwrite))

    def _to_store(self, store: str, container: str, key: str) -> Pipeline:
        uri, kind = external.object_uri(store, container, key), files.detect(key)
        writers = {"jsonl": sinks.write_jsonl, "csv": sinks.write_csv}
        if kind == "parquet":
            return self._to(store, lambda df: sinks.write_parquet(df, uri))
        if kind not in writers:
            raise ConfigError(f"{store}: {kind} can't be written there as a folder; use csv, jsonl or parquet")
        return self._to(store, lambda df: writers[kind](df, uri, False))

    def write_s3(self, bucket: str, key: str) -> Pipeline:
        return self._to_store("s3", bucket, key)

    def write_gcs(self, bucket: str, key: str) -> Pipeline:
        return self._to_store("gcs", bucket, key)

    def write_azure(self, container: str, key: str) -> Pipeline:
        return self._to_store("azure", container, key)

    def write(self, path: str) -> Pipeline:
        """Any file, by its name's format."""
        match files.detect(path):
            case "jsonl":
                return self.write_jsonl(path)
            case "json":
                return self.write_json(path)
            case "columnar":
                return self.write_columnar(path)
            case "parquet":
                return self.write_parquet(path)
            case "http":
                raise ConfigError("http: can't be written to")
        return self.write_csv(path)

    # Results.

    def _compile(self, observed: list[tuple[str, Observation]] | None = None, dead: closures.DeadLetters | None = None) -> stages.Flow:
        if self._source is None:
            raise ConfigError("a pipeline needs a source")
        if self._keys is not None:
            raise ConfigError("group_by: agg must follow")
        _, read, text = self._source
        df = read()
        hidden = [c for c in df.columns if c.startswith(stages.HIDDEN)]
        if hidden or len(set(df.columns)) < len(df.columns):
            raise MillraceError(f"columns must have different names, none beginning with {stages.HIDDEN}: {', '.join(df.columns)}")
        flow = with_row_ids(df, text) if self._reads_order(0) else stages.Flow(df)
        flow = stages.replace(flow, strict_columns=self._strict_columns)

        def observe(flow: stages.Flow, name: str) -> stages.Flow:
            if observed is None:
                return flow
            o = Observation(f"millrace_{len(observed)}_{id(observed)}")
            observed.append((name, o))
            return stages.replace(flow, df=flow.df.observe(o, F.count(F.lit(1)).alias("rows")))

        flow = observe(flow, "source")
        for i, stage in enumerate(self._stages):
            if dead is not None and isinstance(stage, (closures.FilterRows, closures.MapRows)):
                stage = closures.replace(stage, dead=dead)
            flow = observe(stage.apply(flow, self._reads_order(i + 1)), stage.name)
        return flow

    def _reads_order(self, at: int) -> bool:
        """Whether a stage from ``at`` on reads the order that rows have before it."""
        for stage in self._stages[at:]:
            if stage.reads_order:
                return True
            if stage.ends_order:
                return False
        return False

    def to_df(self) -> DataFrame:
        """The lazy result."""
        return self._compile().result()

    def execute(self) -> dict:
        """Run into the sink (without one, discard): rows (of the source, where they are counted), batches (tasks' work
        isn't counted in batches: 1 for any run), bytes_in, bytes_out and elapsed seconds."""
        begun = time.time()
        on = self._telemetry if self._telemetry is not None else self._progress is not None or (self._source is not None and self._source[2])
        observed: list[tuple[str, Observation]] | None = [] if on else None
        dead = closures.DeadLetters() if self._dead_path is not None else None
        if self._dead_path is not None:
            try:
                Path(self._dead_path).write_bytes(b"")
            except OSError as e:
                raise IoError(f"dead letter file {self._dead_path}: {e}") from e
        df = self._compile(observed, dead).result()
        name, write = self._sink or ("null", lambda x: sinks.discard(x))
        try:
            size = write(df) or 0
        except MillraceError:
            raise
        except Exception as e:
            raise self._named(e) from e
        if dead is not None:
            self._write_dead(dead)
        elapsed = time.time() - begun
        counts = [(n, o.get["rows"]) for n, o in observed or []]
        self._stats = [StageStats(n, before, rows, 1, elapsed) for (_, before), (n, rows) in zip(counts, counts[1:], strict=False)]
        if counts:
            notify(self._progress, Event("source_batch", "source", counts[0][1], counts[0][1]))
            for s in self._stats:
                notify(self._progress, Event("stage_batch", s.name, s.rows_in, s.rows_out))
            notify(self._progress, Event("sink_batch", name, counts[-1][1], counts[-1][1]))
        rows = counts[0][1] if counts else None
        notify(self._progress, Event("done", name, rows or 0, counts[-1][1] if counts else 0))
        return {"rows": rows, "batches": 1, "bytes_in": 0, "bytes_out": size, "elapsed": elapsed}

    def _named(self, e: Exception) -> Exception:
        text = str(e)
        if "malformed row: " in text:
            path = text.split(": malformed row")[0].rsplit(" ", 1)[-1]
            return JsonError(f"{path}: malformed row") if files.detect(path) == "jsonl" else files.malformed_csv(path, e)
        return e

    def _write_dead(self, dead: closures.DeadLetters) -> None:
        """Rows stream through the driver, a partition at a time."""
        self._dead_rows = 0
        with open(self._dead_path, "w", encoding="utf-8") as out:
            for _, df in dead.frames:
                self._dead_rows += sinks.stream_csv(df, out)
        for df in dead.held:
            df.unpersist()

    def collect(self) -> list[dict]:
        """Rows as dicts; dates and timestamps as ISO text. Any sink is left alone."""
        try:
            df = self.to_df()
            text = [sinks.shown(df, plain_floats=False)[i] if stages.kind_of(f.dataType) in ("date", "timestamp") else stages.quoted(f.name) for i, f in enumerate(df.schema)]
            return [r.asDict() for r in df.select(*text).collect()]
        except (MillraceError, DataQualityError):
            raise
        except Exception as e:
            raise self._named(e) from e

    def to_pandas(self):
        return self.to_df().toPandas()

    def preview(self, n: int = 10) -> list[dict]:
        """The first n rows of the result; the sink is left alone."""
        flow = self._compile()
        return [r.asDict() for r in flow.result().limit(n).collect()]

    def explain(self, physical: bool = False) -> str:
        names = [s.name for s in self._stages]
        text = " -> ".join(["source", *names, "sink"])
        if physical:
            self.to_df().explain("formatted")
        return text

    def num_stages(self) -> int:
        return len(self._stages)

    def __repr__(self) -> str:
        return f"Pipeline({self.explain()})"
