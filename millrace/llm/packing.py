"""Packing along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import WordIds, place
from .common import pick, small_batches, stored

#: Places of a hashed document vector, and ids that are counted at a time.
PLACES, STEP = 256, 1 << 16
#: Documents that are worked on at a time, and bytes of them.
BLOCK, BLOCK_BYTES = 512, 1 << 21


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``BLOCK`` rows and, in ``column``, ``BLOCK_BYTES``; a longer row is alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            most = BLOCK_BYTES + (ends[first - 1] if first else 0)
            last = min(first + BLOCK, max(first + 1, int(np.searchsorted(ends, most, "right"))))
            yield batch.slice(first, last - first)
            first = last


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points, rows of integers below 2 to the power of ``bits``.

    From the highest bit down, each orthant's reflection and exchange of axes is undone on all lower bits; the Gray code
    of what is left is the position.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            high = (x[d] >> b) & 1 == 1
            x[0] = np.where(high, x[0] ^ low, x[0])
            swap = np.where(high, 0, (x[0] ^ x[d]) & low)
            x[0] ^= swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


class Curve:
    """Token counts, hashed to signed places, made unit vectors and projected to ``dims`` axes of 2**``bits`` cells."""

    def __init__(self, dims: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.place = rng.integers(0, PLACES, 1 << 16)
        self.sign = rng.choice([-1.0, 1.0], 1 << 16)
        self.axes = rng.normal(size=(PLACES, dims))

    def keys(self, ids: list[np.ndarray]) -> np.ndarray:
        vectors = np.zeros((len(ids), PLACES))
        for vector, every in zip(vectors, ids, strict=True):
            for at in range(0, len(every), STEP):
                part = every[at : at + STEP]
                vector += np.bincount(self.place[part], self.sign[part], PLACES)
        norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        flat = vectors / np.where(norm > 0, norm, 1) @ self.axes
        cells = np.clip((flat + 3) / 6 * (1 << self.bits), 0, (1 << self.bits) - 1)
        return hilbert_keys(cells.astype(np.int64), self.bits)


def pack_documents(
    docs: DataFrame,
    tokenizer_name: str = "word_bpe_49k.json",
    capacity: int = 2048,
    end_id: int = 1,
    dims: int = 3,
    bits: int = 10,
    seed: int = 23,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All documents as pieces of sequences of at most ``capacity`` ids, neighbours on the curve side by side.

    Each document's ids (without added specials) end with ``end_id``. Documents are range-sorted by the Hilbert key of
    their hashed and projected token counts, then by id; each range is one stream of ids, cut at ``capacity``, so only
    the last sequence of a range has padding. Copies share a key and are divided among ranges by id. Texts are
    tokenised once; ids wait in a stored table of 16-bit numbers, so that ranges can be drawn from it. Workers hold
    blocks of rows that are bounded in bytes, so that long documents side by side need no more memory than others.

    Returns a row for each piece: doc_id, start (the document's ids before it), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset (in the sequence). A null or empty text is ``end_id`` alone; rows alike are
    packed one by one; an empty table gives an empty result; other columns are ignored.
    """
    path, curve = place(tokenizer_name), Curve(dims, bits, seed)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(path)
        for part in blocks(batches, "text"):
            ids = [x + end for x in encoder(part.column("text").to_pylist())]
            keys = curve.keys([np.frombuffer(x, "<u2") for x in ids])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys), pa.array(ids, pa.binary())], ["doc_id", "key", "ids"])

    with small_batches(docs.sparkSession):
        encoded = stored(rows.mapInArrow(encode, f"doc_id {kind}, key long, ids binary"))
    ranged = encoded.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = TaskContext.get().partitionId() << 40, 0
        for batch in blocks(batches, "ids"):
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for i, raw in enumerate(batch.column("ids")):
                ids = np.frombuffer(raw.as_py(), "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    offset = at % capacity
                    n = min(capacity - offset, len(ids) - start)
                    for k, v in zip(out, (i, start, n, ids[start : start + n].tobytes(), len(ids), base + at // capacity, offset), strict=True):
                        out[k].append(v)
                    start, at = start + n, at + n
            picked = batch.column("doc_id").take(pa.array(out.pop("row"), pa.int64()))
            kinds = {"ids": pa.binary()}
            yield pa.RecordBatch.from_arrays([picked, *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], ["doc_id", *out])

    return ranged.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the crc32 of the ids in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
