"""Native columnar chunk files, as a Spark data source in Python.

A file is a row of chunks, each described by itself: a header, then for each column its name, type, null flags (one byte
a row) and data, packed little-endian; text is row offsets and bytes. Parquet is the better choice for anything new.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import ColumnarError, IoError
from ..types import SPARK, kind_of

# Fixed values of the format.
MAGIC = b"TPTCOL1\x00"
VERSION = 1
FLAG_ZSTD = 1
BIG = 512
MAX_BUFFER = 512 * 1024 * 1024
MAX_COLUMNS = 65_536
CODES = ["int32", "int64", "float32", "float64", "utf8", "bool", "date", "timestamp"]
LAYOUT = {"int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8", "bool": "<u1", "date": "<i4", "timestamp": "<i8"}
ARROW = {
    "int32": pa.int32(), "int64": pa.int64(), "float32": pa.float32(), "float64": pa.float64(), "utf8": pa.string(), "bool": pa.bool_(),
    "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC"),
}
CHUNK_ROWS = 65_536


def encode_chunk(batch: pa.RecordBatch, kinds: list[str], compress: bool) -> bytes:
    buffers = []
    for column, kind in zip(batch.columns, kinds, strict=True):
        nulls = np.asarray(column.is_null()).astype(np.uint8).tobytes()
        if kind == "utf8":
            blobs = [(x or "").encode() for x in column.to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(b) for b in blobs], dtype=np.uint64))).astype("<u8")
            data, size = offsets.tobytes() + b"".join(blobs), len(blobs) * 8
        else:
            plain = column.cast(pa.int32()) if kind == "date" else column.cast(pa.int64()) if kind == "timestamp" else column.cast(pa.uint8()) if kind == "bool" else column
            data = plain.fill_null(0).to_numpy(zero_copy_only=False).astype(LAYOUT[kind]).tobytes()
            size = len(data)
        buffers.append((nulls, data, size))
    squeeze = compress and any(len(n) > BIG or size > BIG for n, _, size in buffers)
    packed = zstandard.ZstdCompressor(level=3)
    out = [MAGIC, struct.pack("<HHIQ", VERSION, FLAG_ZSTD if squeeze else 0, len(kinds), batch.num_rows)]
    for name, kind, (nulls, data, _) in zip(batch.schema.names, kinds, buffers, strict=True):
        raw = name.encode()
        out.append(struct.pack("<H", len(raw)) + raw + bytes([CODES.index(kind)]))
        for buffer in (nulls, data):
            stored = packed.compress(buffer) if squeeze and len(buffer) > BIG else buffer
            out.append(struct.pack("<QQ", len(buffer), len(stored)) + stored)
    return b"".join(out)


class _Cursor:
    def __init__(self, handle, path: str) -> None:
        self.handle, self.path = handle, path

    def take(self, n: int, what: str) -> bytes:
        data = self.handle.read(n)
        if len(data) < n:
            raise ColumnarError(f"{self.path}: truncated in {what}")
        return data

    def unpack(self, layout: str, what: str) -> tuple:
        return struct.unpack(layout, self.take(struct.calcsize(layout), what))

    def buffer(self, squeezed: bool, what: str, skip: bool = False) -> bytes:
        size, stored = self.unpack("<QQ", what)
        if size > MAX_BUFFER or stored > MAX_BUFFER:
            raise ColumnarError(f"{self.path}: {what} of {max(size, stored)} bytes is too large")
        raw = self.take(stored, what)
        if skip:
            return b""
        if squeezed and size > BIG:
            try:
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
            except zstandard.ZstdError as e:
                raise ColumnarError(f"{self.path}: {what}: {e}") from e
        if len(raw) != size:
            raise ColumnarError(f"{self.path}: {what} has {len(raw)} bytes for {size}")
        return raw


def chunks(path: str, data: bool = True) -> Iterator[tuple[list[str], list[str], int, list[tuple[bytes, bytes]], int]]:
    """(names, kinds, rows, buffers, place in the file) of each chunk; without ``data`` buffers are passed over."""
    with open(path, "rb") as f:
        while True:
            place = f.tell()
            magic = f.read(len(MAGIC))
            if not magic:
                return
            c = _Cursor(f, path)
            if magic != MAGIC:
                raise ColumnarError(f"{path}: not a chunk file")
            version, flags, columns, rows = c.unpack("<HHIQ", "header")
            if version != VERSION:
                raise ColumnarError(f"{path}: version {version} is unknown")
            if columns > MAX_COLUMNS:
                raise ColumnarError(f"{path}: {columns} columns are too many")
            names, kinds, buffers = [], [], []
            for _ in range(columns):
                (size,) = c.unpack("<H", "name length")
                names.append(c.take(size, "name").decode())
                (code,) = c.unpack("<B", "type")
                if code >= len(CODES):
                    raise ColumnarError(f"{path}: type {code} is unknown")
                kinds.append(CODES[code])
                buffers.append((c.buffer(bool(flags & FLAG_ZSTD), "nulls", not data), c.buffer(bool(flags & FLAG_ZSTD), "data", not data)))
            yield names, kinds, rows, buffers, place


def decode(kind: str, rows: int, nulls: bytes, data: bytes, path: str) -> pa.Array:
    if len(nulls) != rows:
        raise ColumnarError(f"{path}: {len(nulls)} null flags for {rows} rows")
    mask = np.frombuffer(nulls, np.uint8) != 0
    if kind == "utf8":
        head = (rows + 1) * 8
        if len(data) < head:
            raise ColumnarError(f"{path}: text without offsets")
        offsets = np.frombuffer(data[:head], "<u8").astype(np.int64)
        if (np.diff(offsets) < 0).any() or offsets[-1] > len(data) - head:
            raise ColumnarError(f"{path}: bad text offsets")
        blob = data[head:]
        return pa.array([None if m else blob[a:b].decode() for a, b, m in zip(offsets[:-1], offsets[1:], mask, strict=True)], pa.string())
    values = np.frombuffer(data, LAYOUT[kind])
    if len(values) != rows:
        raise ColumnarError(f"{path}: {len(values)} values for {rows} rows")
    if kind == "bool":
        values = values != 0
    plain = pa.array(values, mask=mask)
    return plain.cast(ARROW[kind]) if kind in ("date", "timestamp") else plain


class _Chunk(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        n = sum(1 for _ in chunks(self.path, data=False))
        return [_Chunk(self.path, i, self.per_task) for i in range(0, n, self.per_task)] or [_Chunk(self.path, 0, 0)]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        for i, (names, kinds, rows, buffers, _) in enumerate(chunks(partition.path)):
            if partition.first <= i < partition.first + partition.count:
                yield pa.RecordBatch.from_arrays([decode(k, rows, n, d, partition.path) for k, (n, d) in zip(kinds, buffers, strict=True)], names)


class _Done(WriterCommitMessage):
    def __init__(self, part: str) -> None:
        self.part = part


class _Writer(DataSourceWriter):
    """Each task writes a file of chunks beside ``path``; the driver joins them in the order of the tasks."""

    def __init__(self, path: str, schema: T.StructType, compress: bool) -> None:
        self.path, self.schema, self.compress = path, schema, compress

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        kinds = [kind_of(f.dataType) for f in self.schema]
        part = f"{self.path}.part-{TaskContext.get().partitionId():06d}"
        with open(part, "wb") as f:
            block: list = []
            for row in rows:
                block.append(row)
                if len(block) == CHUNK_ROWS:
                    f.write(self._encode(block, kinds))
                    block = []
            if block:
                f.write(self._encode(block, kinds))
        return _Done(part)

    def _encode(self, rows: list, kinds: list[str]) -> bytes:
        columns = [pa.array([r[i] for r in rows], ARROW[k]) for i, k in enumerate(kinds)]
        return encode_chunk(pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema]), kinds, self.compress)

    def commit(self, messages: list) -> None:
        parts = sorted(m.part for m in messages if m)
        with open(self.path, "wb") as out:
            for p in parts:
                with open(p, "rb") as f:
                    while block := f.read(1 << 20):
                        out.write(block)
                os.remove(p)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.part):
                os.remove(m.part)


class ChunkFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_columnar"

    def schema(self) -> T.StructType:
        for names, kinds, *_ in chunks(self.options["path"], data=False):
            return T.StructType([T.StructField(n, SPARK[k]) for n, k in zip(names, kinds, strict=True)])
        return T.StructType([])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("chunks_a_task", "4")))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, self.options.get("zstd", "true") == "true")


def read_columnar(spark: SparkSession, path: str) -> DataFrame:
    """The file must lie where the driver and all executors can open it."""
    if not os.path.exists(path):
        raise IoError(f"{path}: no such file")
    spark.dataSource.register(ChunkFiles)
    return spark.read.format("millrace_columnar").load(path)


def write_columnar(df: DataFrame, path: str, zstd: bool = True) -> None:
    df.sparkSession.dataSource.register(ChunkFiles)
    df.write.format("millrace_columnar").mode("overwrite").option("zstd", str(zstd).lower()).save(path)
