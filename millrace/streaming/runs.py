"""The stages of a pipeline on Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import UnsupportedStreaming
from ..operators import closures, stages

#: How each stage runs on a stream: as it is, or why not.
REFUSED = {
    stages.Sort: "sort needs all rows; aggregate first and sort the result",
    stages.Expect: "expect needs all rows; check batches with for_each_batch",
}


def stream_flow(pipeline, df: DataFrame) -> DataFrame:
    """The pipeline's stages on a streaming ``df``.

    filter, map, select, drop, sample and closures are stateless. dedup keeps the first row of a key to arrive; with a
    watermark on ``df`` its state is bounded. Aggregates need complete mode, or a watermark and a window. A join with a
    static right side may be inner or left. limit counts rows as they arrive. Anything else is refused by name.
    """
    if not df.isStreaming:
        raise UnsupportedStreaming("the DataFrame is not a stream")
    flow = stages.Flow(df)
    for s in pipeline._stages:
        why = REFUSED.get(type(s))
        if isinstance(s, stages.Join) and s.how in ("right", "full"):
            why = f"{s.how} join with a static side is not supported on a stream"
        if isinstance(s, (closures.FilterRows, closures.MapRows)) and s.dead is not None:
            why = "dead letters need a finite input"
        if why:
            raise UnsupportedStreaming(f"{s.name}: {why}")
        if isinstance(s, stages.Dedup):
            keys = list(s.columns) or flow.columns
            flow = stages.Flow(flow.df.dropDuplicates(keys))
        else:
            flow = s.apply(flow, False)
    return flow.result()


def read_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A folder (or glob) of files as a stream."""
    reader = spark.readStream.schema(schema).format(kind)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def for_each_batch(pipeline_of: Callable[[DataFrame], object], df: DataFrame, checkpoint: str, available: bool = True):
    """Runs ``pipeline_of(batch).execute()`` on every micro-batch, for stages that a stream doesn't have."""
    writer = df.writeStream.foreachBatch(lambda batch, _: pipeline_of(batch).execute() and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


def run_available(spark: SparkSession, schema: T.StructType, path: str, pipeline_of: Callable[[DataFrame], object], keys: Sequence[str] = (), kind: str = "parquet") -> DataFrame:
    """All files that are there now, as a stream with one pass (``availableNow``), gathered in a table in memory.

    Meant for results that are small, as aggregates are: ``keys`` names the grouping columns of one, else the result is
    appended.
    """
    stream = read_stream(spark, path, schema, kind)
    name = f"millrace_{uuid.uuid4().hex}"
    out = stream_flow(pipeline_of(stream), stream)
    writer = out.writeStream.format("memory").queryName(name).outputMode("complete" if keys else "append")
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="millrace-")
    q = writer.option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
