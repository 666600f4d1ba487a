"""Position of a row in [0, 1) by its key: a keyed sample keeps the rows below a fraction.

FNV-1a over the seed and the key's values, then the SplitMix64 finish; the top 53 bits are the position.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import kind_of

# Fixed values of the two hashes.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
SPLITMIX_GAMMA = 0x9E3779B97F4A7C15
SPLITMIX_1 = 0xBF58476D1CE4E5B9
SPLITMIX_2 = 0x94D049BB133111EB

#: Canonical type -> little-endian layout of a value.
LAYOUT = {"int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8", "bool": "<u1", "date": "<i4", "timestamp": "<i8"}


def _feed(state: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``state`` after the bytes of each row of ``data`` (row, byte)."""
    for i in range(data.shape[1]):
        state = (state ^ data[:, i].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return state


def _text(state: int, value: bytes) -> int:
    for b in value + b"\xff":
        state = ((state ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return state


def positions(columns: list[pd.Series], kinds: list[str], seed: int) -> np.ndarray:
    n = len(columns[0])
    with np.errstate(over="ignore"):
        start = np.full(n, FNV_OFFSET, np.uint64)
        state = _feed(start, np.tile(np.frombuffer(np.array([seed & 0xFFFFFFFFFFFFFFFF], "<u8").tobytes(), np.uint8), (n, 1)))
        for values, kind in zip(columns, kinds, strict=True):
            gone = values.isna().to_numpy()
            after = _feed(state, np.zeros((n, 1), np.uint8))
            if kind == "utf8":
                fed = np.array([0 if g else _text(int(s), v.encode()) for s, v, g in zip(state.tolist(), values, gone, strict=True)], np.uint64)
            else:
                raw = np.ascontiguousarray(values.where(~values.isna(), 0).to_numpy().astype(LAYOUT[kind]))
                fed = _feed(state, raw.view(np.uint8).reshape(n, -1))
            state = np.where(gone, after, fed)
        z = state + np.uint64(SPLITMIX_GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX_2)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def position(df, keys: list[str], seed: int) -> Column:
    """The column of positions; Arrow batches, numpy inside. Key types matter: 32- and 64-bit integers differ."""
    kinds = [kind_of(df.schema[k].dataType) for k in keys]
    ready = []
    for k, kind in zip(keys, kinds, strict=True):
        c = F.col(f"`{k}`")
        if kind == "date":
            c = F.unix_date(c)
        elif kind == "timestamp":
            c = F.unix_micros(c.cast("timestamp"))
        elif kind == "bool":
            c = c.cast("tinyint")
        elif kind == "float64":
            c = c.cast("double")
        ready.append(c)

    @F.pandas_udf("double")
    def udf(*columns: pd.Series) -> pd.Series:
        return pd.Series(positions(list(columns), kinds, seed))

    return udf(*ready)
