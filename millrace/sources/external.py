"""Databases, HTTP and object stores. What needs a network is wired to Spark's own connectors."""

from __future__ import annotations

import ipaddress
import os
import random
import shutil
import sqlite3
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CloudError, ConfigError, DatabaseError, IoError
from ..types import kind_of, show_timestamp
from .files import Policy

BATCH = 10_000


@dataclass(frozen=True)
class RetryPolicy:
    """``attempts`` in all; waits double from ``base_ms`` up to ``max_ms``, each with jitter."""

    attempts: int = 1
    base_ms: int = 200
    max_ms: int = 10_000

    def run(self, action: Callable, transient: Callable[[Exception], bool]):
        for n in range(self.attempts):
            try:
                return action()
            except Exception as e:
                if n + 1 >= self.attempts or not transient(e):
                    raise
                time.sleep(min(self.max_ms, self.base_ms * 2**n) / 1000 * random.uniform(0.5, 1))


def _transient(e: Exception) -> bool:
    if isinstance(e, urllib.error.HTTPError):
        return e.code in (408, 429) or e.code >= 500
    return isinstance(e, (urllib.error.URLError, TimeoutError, ConnectionError))


def read_http(spark: SparkSession, url: str, policy: Policy = Policy(), retry: RetryPolicy = RetryPolicy(), max_body: int = 1 << 30) -> DataFrame:
    """A file behind a URL, fetched by the driver and read by its name's format, from ``spark.checkpoint.dir`` (which executors
    share) or, where that is unset, as in local mode, from a temporary folder."""
    from . import files

    def fetch() -> str:
        with urllib.request.urlopen(url, timeout=60) as reply:  # noqa: S310
            name = os.path.basename(urllib.parse.urlparse(url).path) or "body.csv"
            if reply.headers.get("Content-Encoding") == "gzip" and not name.endswith(".gz"):
                name += ".gz"
            path, size = os.path.join(tempfile.mkdtemp(prefix="millrace-"), name), 0
            with open(path, "wb") as out:
                while block := reply.read(1 << 20):
                    size += len(block)
                    if size > max_body:
                        raise IoError(f"{url}: body over {max_body} bytes")
                    out.write(block)
            return path

    try:
        path = retry.run(fetch, _transient)
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise IoError(f"{url}: {e}") from e
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return files.read(spark, f"file://{path}", policy)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(f"{shared}/millrace-http-{uuid.uuid4().hex}/{os.path.basename(path)}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, hadoop(f"file://{path}"), target)
    os.rmdir(os.path.dirname(path))
    return files.read(spark, target.toString(), policy)


def object_uri(store: str, container: str, key: str) -> str:
    """URI for Spark's connector of a store: s3, gcs, or azure (container is ``account/container`` there)."""
    if not container or not key:
        raise CloudError(f"{store}: container and key must not be empty")
    match store:
        case "s3":
            return f"s3a://{container.removeprefix('s3://').strip('/')}/{key.lstrip('/')}"
        case "gcs":
            return f"gs://{container.strip('/')}/{key.lstrip('/')}"
        case "azure":
            account, _, name = container.partition("/")
            if not name:
                raise CloudError("azure: container is account/container")
            return f"abfss://{name}@{account}.dfs.core.windows.net/{key.lstrip('/')}"
    raise ConfigError(f"unknown object store {store!r}; known: s3, gcs, azure")


def jdbc_options(conn: str, allow_plaintext: bool = False) -> dict[str, str]:
    """Options of Spark's JDBC source from ``postgres://user:password@host:port/database``.

    Without TLS only a loopback host is allowed, unless ``allow_plaintext``.
    """
    u = urllib.parse.urlparse(conn)
    if u.scheme not in ("postgres", "postgresql") or not u.hostname:
        raise DatabaseError("a connection is postgres://user:password@host:port/database")
    query = dict(urllib.parse.parse_qsl(u.query))
    secure = query.get("sslmode", "") in ("require", "verify-ca", "verify-full")
    try:
        loopback = u.hostname == "localhost" or ipaddress.ip_address(u.hostname).is_loopback
    except ValueError:
        loopback = False
    if not (secure or loopback or allow_plaintext):
        raise DatabaseError(f"{u.hostname}: plaintext is allowed to this machine only; ask for sslmode=require")
    tail = f"?{u.query}" if u.query else ""
    options = {"url": f"jdbc:postgresql://{u.hostname}:{u.port or 5432}{u.path}{tail}", "driver": "org.postgresql.Driver"}
    if u.username:
        options["user"] = urllib.parse.unquote(u.username)
    if u.password:
        options["password"] = urllib.parse.unquote(u.password)
    return options


def read_postgres(spark: SparkSession, conn: str, query: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """``partition``: (column, lowest, highest, number of tasks), to read in parallel."""
    reader = spark.read.format("jdbc").options(**jdbc_options(conn)).option("fetchsize", str(BATCH))
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, n = partition
    return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(n)).load()


def write_postgres(df: DataFrame, conn: str, table: str, overwrite: bool = False) -> None:
    df.write.format("jdbc").options(**jdbc_options(conn)).option("dbtable", table).option("batchsize", str(BATCH)).mode("overwrite" if overwrite else "append").save()


def read_sqlite(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Rows of a query. A SQLite file has one reader, the driver; types come from the values."""
    if not os.path.exists(path):
        raise IoError(f"{path}: no such file")
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            cursor = db.execute(query)
            names = [d[0] for d in cursor.description]
            rows = cursor.fetchall()
    except sqlite3.Error as e:
        raise DatabaseError(f"{path}: {e}") from e

    def kind(values: list) -> T.DataType:
        found = {type(v) for v in values if v is not None}
        if found <= {int}:
            return T.LongType()
        return T.DoubleType() if found <= {int, float} else T.StringType()

    kinds = [kind([r[i] for r in rows]) for i in range(len(names))]
    fix = {T.DoubleType(): float, T.StringType(): lambda v: v if isinstance(v, str) else str(v), T.LongType(): int}
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
    return spark.createDataFrame([tuple(None if v is None else fix[k](v) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)


def write_sqlite(df: DataFrame, path: str, table: str) -> int:
    """Rows are appended, in transactions of a batch; the table is made if it isn't there.

    SQLite has one writer. The rows are worked out by all executors into a folder beside the database (which, like any
    file that the driver writes, must lie where all of them can), and the driver copies it in batches.
    """
    names = {"int32": "INTEGER", "int64": "INTEGER", "bool": "INTEGER", "float32": "REAL", "float64": "REAL"}
    kinds = [kind_of(f.dataType) for f in df.schema]
    quoted = ['"' + c.replace('"', '""') + '"' for c in df.columns]
    target = '"' + table.replace('"', '""') + '"'
    shown = [
        show_timestamp(F.col(f"`{c}`")) if k == "timestamp" else F.col(f"`{c}`").cast("string") if k == "date" else F.col(f"`{c}`").cast("int") if k == "bool" else F.col(f"`{c}`")
        for c, k in zip(df.columns, kinds, strict=True)
    ]
    folder, n = tempfile.mkdtemp(prefix=".millrace-", dir=os.path.dirname(os.path.abspath(path))), 0
    try:
        df.select(*[c.alias(f"c{i}") for i, c in enumerate(shown)]).write.parquet(f"file://{folder}/rows")
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {target} ({', '.join(f'{c} {names.get(k, "TEXT")}' for c, k in zip(quoted, kinds, strict=True))})")
            put = f"INSERT INTO {target} ({', '.join(quoted)}) VALUES ({', '.join('?' * len(quoted))})"
            for part in sorted(p for p in os.listdir(f"{folder}/rows") if p.endswith(".parquet")):
                for batch in parquet.ParquetFile(f"{folder}/rows/{part}").iter_batches(BATCH):
                    db.executemany(put, zip(*[c.to_pylist() for c in batch.columns], strict=True))
                    db.commit()
                    n += batch.num_rows
    except sqlite3.Error as e:
        raise DatabaseError(f"{path}: {e}") from e
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return n
