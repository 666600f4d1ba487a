"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

# Libraries with thread pools of their own would fight over an executor's cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns under internal names: ``pick(df, id="doc_id")`` has the one column ``id``.

    Names are matched exactly, first match first, so extra columns of any name (repeated, or differing only in case)
    neither clash nor get in the way.
    """
    places = {}
    for new, old in columns.items():
        found = [i for i, name in enumerate(df.columns) if name == old]
        if not found:
            raise ValueError(f"no column {old!r}; there are {df.columns}")
        places[new] = found[0]
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{i}").alias(new) for new, i in places.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a compressed Parquet table in the shared folder: for wide rows, smaller than a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """Jobs inside send rows to Python workers at most ``most`` bytes at a time, unless the session has its own limit.

    Batches lie outside the heap on both sides, a set for each task; Spark's default is 64 MB. Results don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = key in spark.conf.getAll
    if not own:
        spark.conf.set(key, most)
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(key)


def keep_where(docs: DataFrame, text_col: str, test: Callable[[list], np.ndarray], rows: int = 256) -> DataFrame:
    """``docs``, all columns, without the rows for whose text ``test`` (of a list of texts) is false.

    Texts go through the worker once, in batches that are cut, ``rows`` at a time, without being copied.
    """
    names = docs.columns
    at = names.index(text_col)
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                yield part.filter(pa.array(test(part.column(at).to_pylist()), pa.bool_()))

    return flat.mapInArrow(run, flat.schema).toDF(*names)


def utf8_bytes(text: Column) -> Column:
    """Length in UTF-8 bytes as a long; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


LONG, DOUBLE, STRING, BINARY = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType()
