"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, keep_where, pick, stored

#: What is counted in a text's bytes: each is a share of all bytes.
BYTES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": [0x20, *range(0x09, 0x0E)],
    "newline": [0x0A],
    "stop": b".,;:",
    "shout": b"!?",
    "symbol": b"#*$%&|<>@^~_=+/\\",
    "bracket": b"()[]{}\"'`",
    "beyond": range(0x80, 0x100),
}
NAMES = [*BYTES, "entropy", "log_words", "word_length", "longest_word", "short_words", "different_words", "top_word", "runs", "different_lines", "words_a_line", "top_line", "ended_words"]
#: Partial sums that a task adds up at a time.
FAN = 16
#: Labelled ids up to which they are broadcast, 8 bytes each.
MOST_BROADCAST = 2_000_000


def statistics(text: str | None) -> np.ndarray:
    """Numbers in the order of NAMES; all are finite, also for a text that is null, empty or one long word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(NAMES))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    out[: len(BYTES)] = [share[list(x)].sum() for x in BYTES.values()]
    seen = share[share > 0]
    words = raw.split()
    n = len(words)
    rest = [-(seen * np.log2(seen)).sum() / 8, np.log1p(n) / 10]
    if n:
        sizes = np.fromiter(map(len, words), np.int64, n)
        often = Counter(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        rest += [
            sizes.mean() / 10,
            np.log1p(sizes.max()) / 10,
            (sizes <= 3).mean(),
            len(often) / n,
            max(often.values()) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)) / 10,
            max(Counter(lines).values()) / len(lines),
            sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        ]
    out[len(BYTES) : len(BYTES) + len(rest)] = rest
    return out


class Scorer:
    """cos(x W + b) with standardised x and Gaussian W approximates a Gaussian kernel; ridge weights; a calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, width: int, bandwidth: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(size=(len(mean), width)) / bandwidth
        self.phase = rng.uniform(0, 2 * np.pi, width)
        self.beta = np.zeros(width + 1)
        self.raw, self.cured = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.waves + self.phase
        return np.concatenate((np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(x), 1))), axis=1)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated: 0.98 of the isotonic value, and 0.02 of a logistic one that breaks its ties."""
        raw = self.ridge(x)
        return np.clip(0.98 * np.interp(raw, self.raw, self.cured) + 0.02 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -50, 50))), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values``, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def smoothed(positive: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rates of a histogram's bins, never falling: pooled first, then each pooled block takes one row of the base rate.

    That row keeps a block of few rows from being certain. As it can turn two neighbours round, what comes out is pooled
    again, by the blocks' own weights.
    """
    rate = positive.sum() / counts.sum()
    pooled = isotonic(positive / counts, counts)
    _, block = np.unique(pooled, return_inverse=True)
    weight = np.bincount(block, counts)[block]
    return isotonic((pooled * weight + rate) / (weight + 1), counts)


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` numbers that ``partial(x, y)`` gives for each batch: one vector for each partition.

    ``FAN`` neighbours are added at a time, until at most as many are left for the driver: no task holds more than that.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += partial(matrix(batch.column("stats")), batch.column("y").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_pydict({"g": pa.array([TaskContext.get().partitionId()], pa.int64()), "v": [total.tobytes()]})

    def fold(table):
        total = np.zeros(size)
        for v in table.column("v"):
            total += np.frombuffer(v.as_py())
        return pa.table({"g": table.column("g")[:1], "v": [total.tobytes()]})

    parts, n = rows.mapInArrow(each, "g long, v binary"), rows.rdd.getNumPartitions()
    while n > FAN:
        parts = parts.withColumn("g", F.expr(f"g div {FAN}")).groupBy("g").applyInArrow(fold, "g long, v binary")
        n = -(-n // FAN)
    return sum((np.frombuffer(r.v) for r in parts.select("v").collect()), np.zeros(size))


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, len(NAMES))


def document_statistics(rows: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row of ``rows`` (doc_id, text); stats holds 64-bit floats."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(stats, pa.binary())], ["doc_id", "stats"])

    return rows.mapInArrow(run, f"doc_id {kind}, stats binary")


def fit(labelled: DataFrame, width: int = 256, bandwidth: float = 4.0, ridge: float = 1e-3, bins: int = 512, seed: int = 3) -> Scorer | None:
    """From (stats, y), y 0 or 1: three passes, each a sum over partitions; None if there are no rows.

    Means and deviations; the normal equations of ``width`` cosines and a constant; a histogram of the fitted scores in
    ``bins`` equal steps from -0.5 to 1.5, from which the isotonic calibration is pooled.
    """
    k = len(NAMES)
    moments = _summed(labelled, lambda x, y: np.concatenate(([len(y)], x.sum(axis=0), (x * x).sum(axis=0))), 1 + 2 * k)
    n = moments[0]
    if not n:
        return None
    mean = moments[1 : k + 1] / n
    model = Scorer(mean, np.sqrt(np.maximum(moments[k + 1 :] / n - mean**2, 0)) + 1e-6, width, bandwidth, seed)

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    d = width + 1
    sums = _summed(labelled, equations, d * d + d)
    model.beta = np.linalg.solve(sums[: d * d].reshape(d, d) + ridge * n / d * np.eye(d), sums[d * d :])

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.ridge(x) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate((np.bincount(at, minlength=bins), np.bincount(at, y, minlength=bins)))

    counts = _summed(labelled, histogram, 2 * bins)
    full = np.flatnonzero(counts[:bins])
    model.raw = (full + 0.5) / bins * 2 - 0.5
    model.cured = smoothed(counts[bins:][full], counts[:bins][full])
    return model


def learn(rows: DataFrame, labels: DataFrame, label_col: str, hold_out: tuple[int, int]) -> Scorer | None:
    """A scorer from the (doc_id, stats) of ``rows`` that have a label and aren't held out."""
    known = pick(labels, label_id="doc_id", y=label_col).where("y in (0, 1)").select("label_id", F.col("y").cast("double").alias("y"))
    usable = rows.where(crc_remainder(F.col("doc_id"), hold_out[0]) != hold_out[1]).join(known, F.col("doc_id") == F.col("label_id"))
    return fit(stored(usable.select("stats", "y")))


def apply(rows: DataFrame, model: Scorer | None) -> DataFrame:
    """(doc_id, score) from (doc_id, stats)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("stats"))
            score = shared.value.score(x) if shared.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    hold_out: tuple[int, int] = (5, 0),
    cut: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: 0 to 1, higher where label 1 is likelier.

    Learns from rows whose crc32(id as text) mod ``hold_out[0]`` is not ``hold_out[1]`` and whose label is 0 or 1, by
    statistics of the text alone, all of them, whole. Statistics are worked out once and stored. Null and empty texts
    have the statistics 0 and a score like any other. Without labels every score is 0.5. Ids repeated in either table
    count as often as they are paired in the fit; each input row has one row in the result.
    """
    rows = stored(document_statistics(pick(docs, doc_id=id_col, text=text_col)))
    scored = apply(rows, learn(rows, labels, label_col, hold_out))
    held_out = crc_remainder(F.col("doc_id"), hold_out[0]) == hold_out[1]
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    hold_out: tuple[int, int] = (5, 0),
    cut: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``docs``, all columns, without the rows that score below ``cut``; learning as in :func:`score_quality`.

    Statistics of the labelled rows are worked out first, those of all rows as they are scored, so no text is moved.
    """
    ids = pick(labels, label_id="doc_id", y=label_col).where("y in (0, 1)").select("label_id").distinct()
    rows = pick(docs, doc_id=id_col, text=text_col)
    few = ids.count() <= MOST_BROADCAST
    labelled = rows.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("label_id"), "left_semi")
    model = learn(stored(document_statistics(labelled)), labels, label_col, hold_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list) -> np.ndarray:
        if shared.value is None:
            return np.full(len(texts), cut <= 0.5)
        return shared.value.score(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))) >= cut

    return keep_where(docs, text_col, good)
